"""Registered queries over statute lines, sections and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.functions.running import task_parts
from folioflow.functions.text import token_estimate
from folioflow.operators import chunk, sections
from folioflow.sources.files import staged

VERSION = "2024.01"

# The line patterns once more, for the fixtures and the second engine.
SHORT_HEADING = r"^\s*([0-9]{1,3}[A-Z]{0,2})[.]\s+(.{0,200})$"
LONG_HEADING = r"^\s*Section\s+([0-9]{1,3}[A-Z]{0,2})[.]\s+(.{0,200})$"
CHAPTER_LINE = r"^\s*CHAPTER\s+([IVXLCDM]+|[0-9]+)\s*$"


def doc_lines(spark, sf):
    """Document lines; the documents of one source are the pages of a group."""
    docs = fx.table(spark, sf, "documents").select("source", F.col("doc_id").alias("page_no"), "text")
    return sections.split_lines(docs)


def doc_repeats(spark, sf):
    return sections.repeating_lines(doc_lines(spark, sf), "source", "page_no")


def act_repeats(spark, sf):
    # As many lines as items.
    parts = task_parts(fx.table(spark, sf, "lineitem"))
    return sections.repeating_lines(fx.act_lines(spark, sf), "act_id", "page_no", parts=parts)


def cleaned_documents(spark, sf):
    lines = doc_lines(spark, sf)
    pages = sections.clean_pages(lines, doc_repeats(spark, sf), "source", ["source", "page_no"])
    return pages.select("source", "page_no", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def cleaned_acts(spark, sf):
    lines = fx.act_lines(spark, sf)
    return sections.clean_lines(lines, act_repeats(spark, sf), "act_id")


def toc_variants(spark, sf):
    """Acts with two, one and no chapter-one heading, and without a marker."""
    return fx.act_lines(spark, sf).filter(
        "not (act_id % 3 = 1 and line_no = 8) and not (act_id % 3 = 2 and line_no in (2, 8)) and not (act_id % 6 = 0 and line_no = 1)"
    )


def body_lines(spark, sf):
    body, _ = sections.skip_toc(toc_variants(spark, sf))
    return body.select("act_id", "line_no")


def toc_warnings(spark, sf):
    _, warnings = sections.skip_toc(toc_variants(spark, sf))
    return warnings


def verbose_variants(spark, sf):
    lines = fx.act_lines(spark, sf)
    longer = (F.col("act_id") % 2 == 0) & F.col("line").rlike(SHORT_HEADING)
    return lines.withColumn("line", F.when(longer, F.concat(F.lit("Section "), "line")).otherwise(F.col("line")))


def heading_styles(spark, sf):
    return sections.choose_heading_style(verbose_variants(spark, sf))


def raw_sections(spark, sf):
    """Sections with running titles and footnotes still in, to exercise the clean-up."""
    body, _ = sections.skip_toc(staged(verbose_variants(spark, sf), "act-lines"))
    return sections.split_sections(body)


def section_rows(spark, sf):
    return raw_sections(spark, sf).drop("chapter", "chapter_number")


def section_chapters(spark, sf):
    return raw_sections(spark, sf).select("act_id", "line_no", "chapter_number", "chapter")


def long_sections(spark, sf):
    kept, _ = sections.drop_short(raw_sections(spark, sf))
    return staged(kept, "act-sections")


def monotonic(spark, sf):
    return sections.monotonic_sections(long_sections(spark, sf)).select("act_id", "line_no", "number")


def gaps(spark, sf):
    return sections.section_gaps(long_sections(spark, sf))


def parsed_acts(spark, sf):
    out = sections.parse_act_lines(staged(fx.act_lines(spark, sf), "act-lines"))
    return out.select("act_id", "line_no", "number", "heading", "chapter_number", F.md5("body").alias("body_md5"))


def text_sections(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("heading"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )


def section_chunks(spark, sf):
    chunks = chunk.chunk_sections(text_sections(spark, sf))
    return chunks.select("doc_id", "sub_index", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("text_md5"))


def paragraph_docs(spark, sf):
    """Document lines as paragraphs; every tenth document is one long paragraph."""
    texts = F.when(F.col("doc_id") % 10 == 0, F.array(F.replace("text", F.lit("\n"), F.lit("\n\n")))).otherwise(
        F.split("text", "\n")
    )
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.transform(texts, lambda t, i: F.struct(i.alias("paragraph_index"), t.alias("text"))).alias("paragraphs"),
    )


def packed(spark, sf):
    return chunk.pack_paragraphs(paragraph_docs(spark, sf))


def paragraph_chunks(spark, sf):
    return packed(spark, sf).select(
        "doc_id",
        "start_index",
        "end_index",
        "piece",
        F.length("chunk_text").alias("n_chars"),
        F.md5("chunk_text").alias("text_md5"),
    )


def chunk_ids(spark, sf):
    by_section = chunk.chunk_sections(text_sections(spark, sf))
    by_section = chunk.with_chunk_ids(
        by_section, chunk.section_chunk_id(F.lit("corpus"), F.col("doc_id"), F.col("sub_index")), VERSION
    )
    by_paragraph = packed(spark, sf)
    by_paragraph = chunk.with_chunk_ids(
        by_paragraph,
        chunk.paragraph_chunk_id(F.col("doc_id"), F.col("start_index"), F.col("end_index"), F.col("piece")),
        VERSION,
    )
    columns = ["chunk_id", "corpus_version", "char_count", "approx_token_count"]
    return (
        chunk.with_token_estimate(by_section).select(*columns).unionByName(chunk.with_token_estimate(by_paragraph).select(*columns))
    )


def token_estimates(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", token_estimate(F.col("text")).alias("approx_token_count"))


def report(spark, sf):
    docs = fx.table(spark, sf, "documents").selectExpr(
        "doc_id", "case when lang = 'en' then 'act' else 'judgment' end as source_type", "doc_id % 13 = 0 as failed"
    )
    # Documents without any text are added, which have no chunks.
    without = docs.filter("doc_id % 11 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    return chunk.chunk_report(docs.unionByName(without), packed(spark, sf))


PAGE_NO = "regexp_matches(line, '^\\s*\\d+\\s*$')"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
DOC_LINES = """dl as (select source, doc_id as page_no, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)"""


def repeats_sql(source: str, group: str) -> str:
    return f"""rep as (select {group}, {STRIP.format('line')} as line, count(distinct page_no) as n_pages from {source}
  where not {PAGE_NO} and {STRIP.format('line')} <> '' group by 1, 2 having count(distinct page_no) >= 3)"""


SQUEEZED = "case when {s} = '' then '' else regexp_replace(regexp_replace(line, '[ \\t]+', ' ', 'g'), '\\s+$', '') end".format(s=STRIP.format("line"))


def clean_sql(source: str, group: str) -> str:
    return f"""cl as (select * replace ({SQUEEZED} as line) from {source} l where not {PAGE_NO}
  and not exists (select 1 from rep r where r.{group} = l.{group} and r.line = {STRIP.format('l.line')}))"""


TOC_VARIANT = """tv as (select * from act_lines where not (act_id % 3 = 1 and line_no = 8) and not (act_id % 3 = 2 and line_no in (2, 8)) and not (act_id % 6 = 0 and line_no = 1))"""
VERBOSE = f"""vb as (select * replace (case when act_id % 2 = 0 and regexp_matches(line, '{SHORT_HEADING}') then 'Section ' || line else line end as line) from act_lines)"""


def toc_sql(source: str) -> str:
    return f"""mk as (select act_id, min(line_no) as m from {source} where regexp_matches(line, '(?i)ARRANGEMENT\\s+OF\\s+(SECTIONS|CLAUSES)') group by 1),
 fc as (select mk.act_id, count(l.line_no) as n, max(l.line_no) as last from mk left join {source} l on l.act_id = mk.act_id and l.line_no > mk.m and regexp_matches(l.line, '^\\s*CHAPTER\\s+(I|1)\\s*$') group by 1),
 body as (select l.* from {source} l left join fc on fc.act_id = l.act_id and fc.n >= 2 where fc.act_id is null or l.line_no >= fc.last)"""


SECTION_CTES = f"""st as (select act_id, count(*) filter (regexp_matches(line, '{SHORT_HEADING}')) as ns, count(*) filter (regexp_matches(line, '{LONG_HEADING}')) as nv from body group by 1),
 mh as (select b.*, nullif(case when nv > ns then regexp_extract(line, '{LONG_HEADING}', 1) else regexp_extract(line, '{SHORT_HEADING}', 1) end, '') as number,
   case when nv > ns then regexp_extract(line, '{LONG_HEADING}', 2) else regexp_extract(line, '{SHORT_HEADING}', 2) end as hd,
   nullif(regexp_extract(line, '{CHAPTER_LINE}', 1), '') as ch, lead(line) over (partition by b.act_id order by line_no) as nxt from body b join st on st.act_id = b.act_id),
 ow as (select *, max(case when number is not null then line_no end) over (partition by act_id order by line_no) as own,
   max(case when ch is not null then line_no end) over (partition by act_id order by line_no rows between unbounded preceding and 1 preceding) as chl from mh),
 pp as (select act_id, own, page_no, coalesce(string_agg(line, chr(10) order by line_no) filter (number is null), '') as part from ow where own is not null group by 1, 2, 3),
 bd as (select act_id, own, regexp_replace(regexp_replace(string_agg(part, chr(10) || chr(10) order by page_no), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as body from pp group by 1, 2),
 sec as (select h.act_id, h.line_no, h.number, rtrim(trim(h.hd), '.') as heading, c.ch as chapter_number, trim(c.nxt) as chapter, bd.body
   from ow h join bd on bd.act_id = h.act_id and bd.own = h.line_no left join ow c on c.act_id = h.act_id and c.line_no = h.chl where h.number is not null),
 ls as (select *, try_cast(case when regexp_matches(number, '^\\d+$') then number end as int) as num from sec where length(body) >= 20)"""

MONOTONIC = """mo as (select *, max(num) over (partition by act_id order by line_no rows between unbounded preceding and 1 preceding) as top from ls)"""


def pack_sql(hard: bool) -> str:
    """Greedy packing as a recursive walk over ``p(doc, i, t)``."""
    alone = "length(p.t) > 2500" if hard else "false"
    fits = f"open >= 0 and open + 2 + length(p.t) <= 2000 and not {alone}"
    return f"""r(doc, i, chunk, open) as (
  select doc, i, 0, case when {alone} then -1 else length(t) end from p where i = 1
  union all select p.doc, p.i, case when {fits} then chunk else chunk + 1 end, case when {alone} then -1 when {fits} then open + 2 + length(p.t) else length(p.t) end
   from r join p on p.doc = r.doc and p.i = r.i + 1)"""


D1_CTES = f"""s as (select doc_id, case when doc_id % 3 <> 0 then source end as heading, {STRIP.format("replace(text, chr(10), chr(10) || chr(10))")} as text from documents),
 parts as (select doc_id, text, heading, unnest(case when length(text) <= 2500 then [text] else list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') end) as t,
   generate_subscripts(case when length(text) <= 2500 then [text] else list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') end, 1) as i from s where text <> ''),
 p as (select doc_id as doc, i, t from parts),
 {pack_sql(False)},
 pieces as (select r.doc, r.chunk, string_agg(p.t, chr(10) || chr(10) order by p.i) as piece, max(r.chunk) over (partition by r.doc) + 1 as n from r join p on p.doc = r.doc and p.i = r.i group by r.doc, r.chunk),
 d1 as (select doc as doc_id, chunk as sub_index, case when chunk = 0 and coalesce(s.heading, '') <> '' then s.heading || chr(10) || chr(10) else '' end || piece as chunk_text from pieces join s on s.doc_id = doc where length(piece) >= 100 or n = 1)"""

# The pieces of oversize paragraphs are packed by a second walk.
D2_CTES = f"""raw as (select doc_id, case when doc_id % 10 = 0 then [replace(text, chr(10), chr(10) || chr(10))] else string_split(text, chr(10)) end as ps from documents),
 pl as (select doc_id, unnest(list_transform(ps, lambda x: {STRIP.format('x')})) as t, unnest(range(len(ps))) as idx from raw),
 p as (select doc_id as doc, idx, t, row_number() over (partition by doc_id order by idx) as i from pl where t <> ''),
 {pack_sql(True)},
 ck as (select r.doc, r.chunk, min(p.idx) as start_index, max(p.idx) as end_index, count(*) as n, string_agg(p.t, chr(10) || chr(10) order by p.i) as text from r join p on p.doc = r.doc and p.i = r.i group by 1, 2),
 ov as (select *, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') as bs from ck where n = 1 and length(text) > 2500),
 q as (select doc, chunk, unnest(bs) as t, unnest(range(1, len(bs) + 1)) as i from ov),
 w(doc, chunk, i, piece, open) as (select doc, chunk, i, 0, length(t) from q where i = 1
  union all select q.doc, q.chunk, q.i, case when open + 2 + length(q.t) <= 2000 then piece else piece + 1 end, case when open + 2 + length(q.t) <= 2000 then open + 2 + length(q.t) else length(q.t) end
   from w join q on q.doc = w.doc and q.chunk = w.chunk and q.i = w.i + 1),
 d2 as (select doc as doc_id, start_index, end_index, 0 as piece, text as chunk_text from ck where not (n = 1 and length(text) > 2500)
  union all select w.doc, any_value(ck.start_index), any_value(ck.end_index), w.piece, string_agg(q.t, chr(10) || chr(10) order by q.i)
   from w join q on q.doc = w.doc and q.chunk = w.chunk and q.i = w.i join ck on ck.doc = w.doc and ck.chunk = w.chunk group by w.doc, w.chunk, w.piece)"""

PLANS = {
    "c4_repeating_lines": (doc_repeats, f"with {DOC_LINES}, {repeats_sql('dl', 'source')} select * from rep"),
    "c4_repeating_act_lines": (act_repeats, fx.duck("act_lines", body=f"with {repeats_sql('act_lines', 'act_id')} select * from rep")),
    "c5_clean_pages": (
        cleaned_documents,
        f"""with {DOC_LINES}, {repeats_sql('dl', 'source')}, {clean_sql('dl', 'source')},
 t as (select source, page_no, string_agg(line, chr(10) order by line_no) as text from cl group by 1, 2)
 select source, page_no, cast(length(text) as int) as n_chars, md5(text) as text_md5 from t""",
    ),
    "c5_clean_lines": (
        cleaned_acts,
        fx.duck("act_lines", body=f"with {repeats_sql('act_lines', 'act_id')}, {clean_sql('act_lines', 'act_id')} select act_id, line_no, page_no, line from cl"),
    ),
    "c6_skip_toc": (body_lines, fx.duck("act_lines", body=f"with {TOC_VARIANT}, {toc_sql('tv')} select act_id, line_no from body")),
    "c6_toc_warnings": (
        toc_warnings,
        fx.duck("act_lines", body=f"""with {TOC_VARIANT}, {toc_sql('tv')}
 select act_id, case when n = 1 then 'one_chapter_heading_after_contents' else 'no_chapter_heading_after_contents' end as warning from fc where n < 2"""),
    ),
    "c7_heading_style": (
        heading_styles,
        fx.duck("act_lines", body=f"""with {VERBOSE}, s as (select act_id, count(*) filter (regexp_matches(line, '{SHORT_HEADING}')) as n_standard,
  count(*) filter (regexp_matches(line, '{LONG_HEADING}')) as n_verbose from vb group by 1)
 select *, case when n_verbose > n_standard then 'verbose' else 'standard' end as style from s"""),
    ),
    "c8_split_sections": (
        section_rows,
        fx.duck("act_lines", body=f"with {VERBOSE}, {toc_sql('vb')}, {SECTION_CTES} select act_id, line_no, number, heading, body from sec"),
    ),
    "c9_carry_chapter": (
        section_chapters,
        fx.duck("act_lines", body=f"with {VERBOSE}, {toc_sql('vb')}, {SECTION_CTES} select act_id, line_no, chapter_number, chapter from sec"),
    ),
    "c10_monotonic_sections": (
        monotonic,
        fx.duck("act_lines", body=f"with {VERBOSE}, {toc_sql('vb')}, {SECTION_CTES}, {MONOTONIC} select act_id, line_no, number from mo where num is null or top is null or num > top"),
    ),
    "c11_section_gaps": (
        gaps,
        fx.duck("act_lines", body=f"""with {VERBOSE}, {toc_sql('vb')}, {SECTION_CTES},
 g as (select *, lag(num) over (partition by act_id order by line_no) as prev from ls where num is not null)
 select act_id, line_no, prev as from_number, num as to_number from g where num - prev > 5"""),
    ),
    "c8_parse_act_lines": (
        parsed_acts,
        fx.duck("act_lines", body=f"""with {repeats_sql('act_lines', 'act_id')}, {clean_sql('act_lines', 'act_id')}, {toc_sql('cl')}, {SECTION_CTES}, {MONOTONIC}
 select act_id, line_no, number, heading, chapter_number, md5(body) as body_md5 from mo where num is null or top is null or num > top"""),
    ),
    "d1_chunk_sections": (
        section_chunks,
        f"with recursive {D1_CTES} select doc_id, sub_index, cast(length(chunk_text) as int) as n_chars, md5(chunk_text) as text_md5 from d1",
    ),
    "d2_pack_paragraphs": (
        paragraph_chunks,
        f"""with recursive {D2_CTES} select doc_id, cast(start_index as int) as start_index, cast(end_index as int) as end_index, piece,
 cast(length(chunk_text) as int) as n_chars, md5(chunk_text) as text_md5 from d2""",
    ),
    "d3_chunk_ids": (
        chunk_ids,
        None,
    ),
    "d4_token_estimate": (
        token_estimates,
        "select doc_id, cast(greatest(1, round_even(length(text) / 4.0, 0)) as int) as approx_token_count from documents",
    ),
    "d5_chunk_report": (
        report,
        f"""with recursive {D2_CTES}, c as (select doc_id, count(*) as n from d2 group by 1),
 j as (select case when lang = 'en' then 'act' else 'judgment' end as source_type, d.doc_id % 13 = 0 as failed, coalesce(n, 0) as n from documents d left join c on c.doc_id = d.doc_id
   union all select case when lang = 'en' then 'act' else 'judgment' end, doc_id % 13 = 0, 0 from documents where doc_id % 11 = 0)
 select source_type, count(*) as records_in, count(*) filter (failed) as records_failed, cast(coalesce(sum(n) filter (not failed), 0) as bigint) as chunks_out, count(*) filter (not failed and n = 0) as zero_chunk_docs from j group by 1""",
    ),
}
# Ids and sizes of both chunk kinds, from the same two walks.
PLANS["d3_chunk_ids"] = (
    chunk_ids,
    f"""with recursive {D1_CTES}, {D2_CTES.replace('p as (', 'p2 as (').replace(' p.', ' p2.').replace('(p.', '(p2.').replace(' p on', ' p2 on').replace('from p where', 'from p2 where').replace('r(doc', 'r2(doc').replace('from r join', 'from r2 as r join').replace('raw as', 'raw as')},
 u as (select 'corpus:s' || doc_id || ':' || sub_index as chunk_id, chunk_text from d1
  union all select 'j:' || doc_id || ':p' || start_index || '-p' || end_index || case when piece > 0 then ':' || piece else '' end, chunk_text from d2)
 select chunk_id, '{VERSION}' as corpus_version, cast(length(chunk_text) as int) as char_count, cast(greatest(1, round_even(length(chunk_text) / 4.0, 0)) as int) as approx_token_count from u""",
)
