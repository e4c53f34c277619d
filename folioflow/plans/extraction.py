"""Registered queries over page text and metadata, prompts and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.operators import citations, extract
from folioflow.sources.files import staged

DOMAIN = "cases.example.com"


def parsed_pages(spark, sf):
    return extract.parse_pages(fx.table(spark, sf, "pages"))


def paragraphs(spark, sf):
    return extract.extract_paragraphs(parsed_pages(spark, sf))


def page_warnings(spark, sf):
    return extract.parse_warnings(parsed_pages(spark, sf))


def assembled(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", "url", "html")
    # Blank pages are added, which come out without a usable paragraph.
    blank = pages.filter("page_id % 41 = 0").selectExpr("-1 - page_id as page_id", "url", "'<html><body></body></html>' as html")
    pages = pages.unionByName(blank)
    parsed = extract.parse_pages(pages)
    usable = extract.extract_paragraphs(parsed)
    entries = pages.select("page_id", "url")
    documents, failed = extract.assemble_documents(usable, extract.parse_warnings(parsed), entries)
    done = documents.select(
        "page_id",
        F.lit("ok").alias("state"),
        F.size("paragraphs").alias("n_paragraphs"),
        F.md5(F.array_join(F.col("paragraphs.text"), "\n")).alias("text_md5"),
        F.size("parse_warnings").alias("n_warnings"),
    )
    return done.unionByName(
        failed.select(
            "page_id",
            F.lit("failed").alias("state"),
            F.lit(0).alias("n_paragraphs"),
            F.lit(None).cast("string").alias("text_md5"),
            F.lit(None).cast("int").alias("n_warnings"),
        )
    )


def document_excerpts(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<p class='x'>"), "text", F.lit("</p>")).alias("text"))
    return extract.excerpts(docs).select("doc_id", "excerpt", "failure")


def court_pages(spark, sf):
    html = F.col("html")
    marked = (
        F.when(F.col("page_id") % 4 == 0, F.replace(html, F.lit("<h1>"), F.lit("<h2>Order of the Sessions Judge</h2><h1>")))
        .when(F.col("page_id") % 4 == 1, F.replace(html, F.lit("<h1>"), F.lit("<h2>High Court</h2><h3 class='docsource_main'>Delhi  Court</h3><h1>")))
        .when(F.col("page_id") % 4 == 2, F.replace(html, F.lit("<title>"), F.lit("<title>Supreme Court ")))
        .otherwise(html)
    )
    return fx.table(spark, sf, "pages").select("page_id", marked.alias("html"))


def courts(spark, sf):
    return extract.extract_court(extract.parse_pages(court_pages(spark, sf)))


CITED = """case doc_id % 9
   when 0 then concat('AIR 1998 SC 123 ', text)
   when 1 then concat(text, ' (2011) 4 SCC 55')
   when 2 then concat('see ( 2007 ) 12 scc 641 and AIR 1998 SC 123 ', text)
   when 3 then concat('ref MANU/SC/1234/2009 ', text)
   when 4 then concat(text, ' 1987 Cri. LJ 1500, AIR 1999 SC 7')
   when 5 then concat('1975 CriLJ 22 ', text)
   when 6 then concat('(2003) 5 SCC (Cri) 99 ', text)
   else text end as text"""
NAMED = "case when doc_id % 2 = 0 then concat('case_', cast(doc_id as {t}), '_on_12_march_', cast(1950 + doc_id % 70 as {t}), '.html') else 'case.html' end as filename"


def citations_found(spark, sf):
    docs = fx.table(spark, sf, "documents").selectExpr("doc_id", CITED, NAMED.format(t="string"))
    return extract.extract_citation(docs).drop("text", "filename")


# References within a line, and some that go on in later ones.
REFERRING = """case line_no % 50 when 7 then concat(line, ' s. 309 and 310 BNS, §999') when 9 then concat(line, ' under Section')
   when 10 then concat('379 and ', line, ' or 305') when 11 then concat('  BNS ', line, ' 306 of the') when 12 then concat('Indian Penal Code. ', line)
   when 20 then concat(line, ' under section') when 21 then '  ' when 22 then concat('397 of ', line, ' 311') when 23 then '' when 24 then 'of the Bharatiya' when 25 then null
   when 26 then concat('Nyaya Sanhita ', line, ' sec') when 27 then '398' when 28 then concat('IPC ', line) else line end as line"""


def dominant(spark, sf):
    # Read for the edges of blocks, the lines and the acts.
    lines = staged(fx.act_lines(spark, sf).selectExpr("act_id", "line_no", REFERRING), "act-lines")
    # Every act has a companion without any line.
    acts = lines.select(F.explode(F.array("act_id", -1 - F.col("act_id"))).alias("act_id"))
    refs = extract.section_references(lines, "act_id", "line_no")
    return extract.dominant_section(refs, acts, "act_id", "line_no")


LINKED = """case page_id % 6
   when 1 then concat('<meta property="og:url" content="http://cases.example.com/doc/1', cast(page_id as {t}), '/">', html)
   when 2 then concat('<link rel="canonical" href="https://cases.example.com/doc/2', cast(page_id as {t}), '/">', html)
   when 3 then concat('<!-- saved from url=(0041)https://cases.example.com/doc/3', cast(page_id as {t}), '/ -->', html)
   when 4 then concat(html, '<a href="https://cases.example.com/doc/4', cast(page_id as {t}), '/">x</a>')
   else html end as html"""


def urls(spark, sf):
    pages = fx.table(spark, sf, "pages").selectExpr(
        "page_id", LINKED.format(t="string"), "case when page_id % 6 = 0 then page_id + 5000 end as known_id"
    )
    return extract.canonical_url(pages, DOMAIN).select("page_id", "canonical_url", "url_confidence")


def summary(spark, sf):
    both = citations_found(spark, sf).join(urls(spark, sf).withColumnRenamed("page_id", "doc_id"), "doc_id", "left")
    return extract.confidence_summary(
        both, {"citation": "citation_confidence", "year": "year_confidence", "url": "url_confidence"}
    )


def relevance(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return extract.relevance_scores(labelled, docs, "doc_id").select("doc_id", "relevance_score", "status")


HIT_META = [
    "case when doc_id % 3 = 0 then 'act' when doc_id % 3 = 1 then 'judgment' end as source_type",
    "case when doc_id % 2 = 0 then concat('ACT', cast(doc_id % 7 as {t})) end as short_name",
    "concat('act_', cast(doc_id % 7 as {t})) as act_id",
    "cast(300 + doc_id % 100 as {t}) as section_number",
    "case when doc_id % 4 = 0 then lang end as section_heading",
    "case when doc_id % 5 <> 0 then concat('Case ', cast(doc_id as {t})) end as case_name",
    "case when doc_id % 4 <> 1 then concat('AIR ', cast(doc_id as {t})) end as citation",
    "case when doc_id % 8 <> 0 then source end as court",
    "case when doc_id % 9 <> 0 then cast(1900 + doc_id % 100 as int) end as year",
    "case when doc_id % 7 <> 0 then concat('https://files.example/', cast(doc_id as {t})) end as source_url",
    "case doc_id % 5 when 0 then '' when 1 then concat('https://cases.example/doc/', cast(doc_id as {t})) end as indian_kanoon_url",
    "case when doc_id % 6 <> 2 then concat('case_', cast(doc_id as {t}), '.pdf') end as pdf_filename",
]


def hits(spark, sf):
    """Five ranked sources for every answer."""
    docs = fx.table(spark, sf, "documents").selectExpr(
        "doc_id as chunk_id", "text", *[c.format(t="string") for c in HIT_META]
    )
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    wanted = fx.answers(spark, sf).selectExpr("query_id", "explode(sequence(1, 5)) as rank")
    wanted = wanted.withColumn("chunk_id", (F.col("query_id") * 7 + F.col("rank") * 17) % n_docs)
    return wanted.join(docs, "chunk_id")


def prompts(spark, sf):
    queries = fx.answers(spark, sf).selectExpr("query_id", "concat('why ', cast(query_id as string)) as query")
    bare = spark.range(1).selectExpr("cast(-1 as bigint) as query_id", "'nothing' as query")
    out = citations.build_prompts(hits(spark, sf), queries.unionByName(bare))
    return out.select("query_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def verified(spark, sf):
    out = citations.verify_citations(fx.answers(spark, sf))
    return out.select(
        "query_id",
        F.array_join("cited", ",").alias("cited"),
        F.array_join(F.col("used").cast("array<string>"), ",").alias("used"),
        F.array_join("stripped", ",").alias("stripped"),
        "clean_text",
    )


def cards(spark, sf):
    return citations.citation_cards(citations.verify_citations(fx.answers(spark, sf)), hits(spark, sf))


PARAGRAPHS_SQL = """arts as (select page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as a from pages),
 ps as (select page_id, unnest(string_split(a, '<p>')[2:]) as x, unnest(range(1, len(string_split(a, '<p>')))) as i from arts),
 tx as (select page_id, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) as text from ps),
 par as (select page_id, cast(row_number() over (partition by page_id order by i) - 1 as int) as paragraph_index, text from tx where length(text) >= 30),
 cnt as (select p.page_id, count(par.page_id) as n from pages p left join par on par.page_id = p.page_id group by 1)"""


# The patterns once more, for the second engine.
CITATIONS = (
    r"(?i)[(]\s*([0-9]{4})\s*[)]\s*[0-9]+\s*SCC\s*[0-9]+",
    r"(?i)AIR\s+([0-9]{4})\s+SC\s+[0-9]+",
    r"(?i)[(]\s*([0-9]{4})\s*[)]\s*[0-9]+\s*SCC\s*[(]Cri[)]\s*[0-9]+",
    r"(?i)([0-9]{4})\s*Cri[.]?\s*LJ\s*[0-9]+",
    r"(?i)MANU/[A-Z]{2}/[0-9]+/([0-9]{4})",
)
YEAR_IN_NAME = "(?i)_on_(?:[0-9]+_)?[a-z]+_([0-9]{4})[.]html?$"
SECTION = (
    r"(?i)(?:section|sec[.]?|s[.]|§)\s*([0-9]{1,4})"
    r"|\b([0-9]{1,4})\s*(?:IPC|BNS|of\s+the\s+(?:Indian\s+Penal\s+Code|Bharatiya\s+Nyaya\s+Sanhita))"
)


def first_match_sql(text: str, group: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{p}', {group}), '')" for p in CITATIONS) + ")"


CITATION_CTES = f"""d as (select doc_id, {CITED}, {NAMED.format(t='varchar')} from documents),
 m as (select doc_id, {first_match_sql('substr(text, 1, 3000)', 0)} as hc, {first_match_sql('substr(text, 1, 3000)', 1)} as hy,
   {first_match_sql('text', 0)} as bc, {first_match_sql('text', 1)} as bym, nullif(regexp_extract(filename, '{YEAR_IN_NAME}', 1), '') as ny from d),
 cit as (select doc_id, coalesce(hc, bc) as citation, case when hc is not null then 'high' when bc is not null then 'medium' else 'low' end as citation_confidence,
   cast(coalesce(case when hc is not null then hy else bym end, ny) as int) as year,
   case when hc is not null then 'high' when bc is not null or ny is not null then 'medium' else 'low' end as year_confidence from m)"""
URL_SQL = """select page_id, case page_id % 6 when 0 then 'https://cases.example.com/doc/' || (page_id + 5000) || '/'
  when 1 then 'http://cases.example.com/doc/1' || page_id || '/' when 2 then 'https://cases.example.com/doc/2' || page_id || '/'
  when 3 then 'https://cases.example.com/doc/3' || page_id || '/' when 4 then 'https://cases.example.com/doc/4' || page_id || '/' end as canonical_url,
 case when page_id % 6 in (0, 1, 2, 3) then 'high' when page_id % 6 = 4 then 'medium' else 'low' end as url_confidence from pages"""
HITS_SQL = f"""h as (select a.query_id, r.rank, d.doc_id as chunk_id, d.text, {', '.join(HIT_META).format(t='varchar')}
  from answers a, unnest([1, 2, 3, 4, 5]) r(rank) join documents d on d.doc_id = (a.query_id * 7 + r.rank * 17) % (select count(*) from documents))"""
VERIFY_SQL = """c as (select query_id, answer_text, n_sources, list_transform(regexp_extract_all(answer_text, '\\[(\\d+)\\]', 1), lambda x: cast(x as int)) as cited from answers),
 e as (select query_id, unnest(cited) as n, unnest(range(len(cited))) as i from c),
 f as (select query_id, n, min(i) as i from e group by 1, 2),
 u as (select query_id, string_agg(cast(n as varchar), ',' order by i) as used from f where n between 1 and 5 group by 1),
 us as (select query_id, n as marker, cast(row_number() over (partition by query_id order by i) as int) as card_index from f where n between 1 and 5),
 w as (select query_id, string_agg(cast(n as varchar), ',' order by n) as stripped from f where n not between 1 and 5 group by 1)"""

PLANS = {
    "c1_extract_paragraphs": (paragraphs, f"with {PARAGRAPHS_SQL} select * from par"),
    "c1_parse_warnings": (
        page_warnings,
        f"""with {PARAGRAPHS_SQL} select page_id, 'no container found; used the whole body' as warning from cnt
 union all select page_id, 'only ' || n || ' paragraph(s)' from cnt where n < 3 union all select page_id, 'no paragraphs' from cnt where n = 0""",
    ),
    "c2_assemble_documents": (
        assembled,
        f"""with {PARAGRAPHS_SQL}, g as (select page_id, count(*) as n, md5(string_agg(text, chr(10) order by paragraph_index)) as text_md5 from par group by 1)
 select p.page_id, case when g.n is null then 'failed' else 'ok' end as state, cast(coalesce(g.n, 0) as int) as n_paragraphs, text_md5,
  case when g.n is not null then cast(1 + (c.n < 3)::int + (c.n = 0)::int as int) end as n_warnings
 from pages p left join g on g.page_id = p.page_id left join cnt c on c.page_id = p.page_id
 union all select -1 - page_id, 'failed', 0, null, null from pages where page_id % 41 = 0""",
    ),
    "c3_excerpt": (
        document_excerpts,
        """with t as (select doc_id, trim(regexp_replace(regexp_replace('<p class=''x''>' || text || '</p>', '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as t from documents),
 x as (select doc_id, case when length(t) <= 3000 then t when contains(substr(t, 1, 3000), ' ') then regexp_extract(substr(t, 1, 3000), '^(.*) [^ ]*$', 1) || ' ...' else substr(t, 1, 3000) || ' ...' end as excerpt from t)
 select doc_id, excerpt, case when length(excerpt) < 200 then 'only ' || length(excerpt) || ' characters of text' end as failure from x""",
    ),
    "c12_extract_court": (
        courts,
        """select page_id, case page_id % 4 when 0 then 'Order of the Sessions Judge' when 1 then 'Delhi Court' when 2 then 'Supreme Court (inferred from title)' end as court,
 case page_id % 4 when 0 then 'medium' when 1 then 'high' else 'low' end as confidence from pages""",
    ),
    "c13_extract_citation": (citations_found, f"with {CITATION_CTES} select * from cit"),
    "c14_dominant_section": (
        dominant,
        fx.duck("act_lines", body=f"""with x as (select act_id, line_no, {REFERRING} from act_lines),
 t as (select act_id, string_agg(line, chr(10) order by line_no) as body from x group by 1),
 l as (select act_id, regexp_extract_all(body, '{SECTION}') as ms from t),
 y as (select act_id, cast(regexp_extract(unnest(ms), '[0-9]{{1,4}}') as int) as section, unnest(range(len(ms))) as nth from l),
 g as (select act_id, section, count(*) as mentions, min(nth) as f from y where section between 378 and 402 or section between 303 and 313 group by 1, 2),
 r as (select *, row_number() over (partition by act_id order by mentions desc, f) as rk, lead(mentions) over (partition by act_id order by mentions desc, f) as nextm from g)
 select a.act_id, cast(section as varchar) || case when section between 303 and 313 then ' BNS' else ' IPC' end as primary_section, mentions, nextm as runner_up,
  case when section is null then 'low' when nextm is null or mentions >= 3 * nextm then 'high' else 'medium' end as confidence
 from (select act_id from act_lines union select -1 - act_id from act_lines) a left join r on r.act_id = a.act_id and rk = 1"""),
    ),
    "c15_canonical_url": (urls, URL_SQL),
    "c16_confidence_summary": (
        summary,
        f"""with {CITATION_CTES}, ur as ({URL_SQL}),
 l as (select 'citation' as field, citation_confidence as c from cit union all select 'year', year_confidence from cit
   union all select 'url', url_confidence from cit left join ur on ur.page_id = cit.doc_id)
 select field, count(*) filter (c = 'high') as high, count(*) filter (c = 'medium') as medium, count(*) filter (c = 'low') as low from l group by 1""",
    ),
    "c17_relevance_model": (
        relevance,
        """with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as term from documents),
 tf as (select doc_id, term, count(*) as tf from w group by 1, 2),
 c as (select term, coalesce(sum(tf) filter (quality = 1), 0) as pos, coalesce(sum(tf) filter (quality = 0), 0) as neg from tf join labels using (doc_id) group by 1),
 n as (select sum(pos) as pos, sum(neg) as neg, count(*) as terms from c),
 prior as (select ln((count(*) filter (quality = 1) + 1.0) / (count(*) filter (quality = 0) + 1.0)) as odds from labels join documents using (doc_id)),
 s as (select doc_id, sum(tf * (ln((c.pos + 1.0) / (n.pos + n.terms)) - ln((c.neg + 1.0) / (n.neg + n.terms)))) as odds from tf join c using (term), n group by 1),
 p as (select d.doc_id, round(1 / (1 + exp(-greatest(least(prior.odds + coalesce(s.odds, 0), 30), -30))), 6) as relevance_score from documents d cross join prior left join s using (doc_id))
 select *, case when relevance_score >= 0.6 then 'approved' when relevance_score >= 0.4 then 'needs-review' else 'rejected' end as status from p""",
    ),
    "h1_build_prompts": (
        prompts,
        fx.duck("answers", body=f"""with {HITS_SQL},
 b as (select query_id, rank, case
   when source_type = 'act' then '[' || rank || '] ' || coalesce(short_name, act_id) || ' §' || section_number || case when section_heading is not null then ' — ' || section_heading else '' end
   when source_type = 'judgment' then '[' || rank || '] ' || coalesce(case_name, 'Unknown case') || case when concat_ws(', ', citation, court, cast(year as varchar)) <> '' then ' (' || concat_ws(', ', citation, court, cast(year as varchar)) || ')' else '' end
   else '[' || rank || ']' end || chr(10) || text as block from h),
 p as (select query_id, 'SOURCES:' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by rank) || chr(10) || chr(10) || 'QUESTION: why ' || query_id as prompt from b group by 1
  union all select -1, 'QUESTION: nothing' || chr(10) || chr(10) || '(No relevant sources were found.)')
 select query_id, cast(length(prompt) as int) as n_chars, md5(prompt) as prompt_md5 from p"""),
    ),
    "h2_verify_citations": (
        verified,
        fx.duck("answers", body=f"""with {VERIFY_SQL}
 select c.query_id, array_to_string(cited, ',') as cited, coalesce(used, '') as used, coalesce(stripped, '') as stripped,
  case when stripped is null then answer_text else regexp_replace(regexp_replace(regexp_replace(answer_text, '\\[0*(?:' || replace(stripped, ',', '|') || ')\\]', '', 'g'), ' {{2,}}', ' ', 'g'), ' ([.,;:!?])', '\\1', 'g') end as clean_text
 from c left join u on u.query_id = c.query_id left join w on w.query_id = c.query_id"""),
    ),
    "h3_citation_cards": (
        cards,
        fx.duck("answers", body=f"""with {HITS_SQL}, {VERIFY_SQL}
 select us.query_id, us.card_index, us.marker, h.chunk_id, coalesce(source_type, 'act') as source_type,
  case when coalesce(source_type, 'act') = 'act' then coalesce(short_name, act_id) || ' §' || section_number else coalesce(h.citation, case_name, '') end as citation,
  case when length(text) > 300 then substr(text, 1, 300) || '…' else text end as excerpt,
  case when source_type = 'judgment' and indian_kanoon_url <> '' then indian_kanoon_url else source_url end as source_url,
  case when source_type = 'judgment' then pdf_filename end as pdf_url,
  case when source_type = 'judgment' then court end as court, case when source_type = 'judgment' then year end as year
 from us join h on h.query_id = us.query_id and h.rank = us.marker"""),
    ),
}
