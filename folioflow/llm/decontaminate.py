"""Benchmark decontamination with a distributed positional inverted index.

Windows of ``WINDOW`` consecutive item words (a shorter item is one window) are
looked up in the documents.  Every text is cut into words once.  Within the
array a Bloom filter keeps the words that the benchmark has at all, and what is
written is the forward index: a row for each document with its number of words
and (position, word) of the kept ones.  A window consists of such words only, so
everything else comes from this table.

Each window is found through its ``RAREST`` rarest terms, counted over all
documents.  The positional index has the postings (term, document, position) of
those terms, each with the kept words up to a window's length around it.
Posting lists are shifted by the term's offset in the window and intersected:
starts on which all lists agree are phrase candidates, confirmed word by word
against the words around the rarest term.  Where the other rare terms stand up to
``SLACK`` words off their place, those words give a proximity match.

Postings are cut out of the arrays before they become rows, so no row holds more
than the neighbourhood of one word, whatever the length of a text.  They are
keyed by document and start: a passage that a third of all documents share is
spread over all tasks.  Where the benchmark is larger than ``BROADCAST_CHARS`` the
same joins are left to Spark to shuffle.

Rows are told apart by id and a hash of the text, so null and repeated ids and
repeated rows get their own results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import lower_ascii, staged, table, text_or_empty

# Fixed values of the contract: words, window length and the contaminated share, 1 in 20.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHARE = 20
RAREST = 2
SLACK = 4
BROADCAST_CHARS = 8_000_000


# Words of 64 bits in a Bloom filter: 16 bits a term, 1 MB at most.
FILTER_WORDS = 1 << 17
KEY = ["_id", "_hash"]
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def words(col: str) -> Column:
    """The words of a text with A-Z lower-cased; in plain ASCII that is what ``lower`` does."""
    text = text_or_empty(col)
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def bloom(terms: DataFrame) -> Callable[[Column], Column]:
    """A test for words that all of ``terms`` pass and few others; two bits a term.

    The filter is gathered by word in Spark and becomes a literal of the plan.
    """
    n = max(1, terms.count())
    size = min(FILTER_WORDS, 1 << max(0, (n - 1).bit_length() - 2))

    def places(term: Column) -> list[Column]:
        h = F.xxhash64(term)
        return [h.bitwiseAND(F.lit(64 * size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(64 * size - 1))]

    set_ = terms.select(F.explode(F.array(*places(F.col("term")))).alias("bit"))
    rows = set_.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value")).collect()
    bits = [0] * size
    for row in rows:
        bits[row.at] = row.value
    # Folded into one array when the plan is made.
    filled = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")

    def passes(term: Column) -> Column:
        tests = [F.getbit(filled[F.shiftright(p, 6).cast("int")], p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places(term)]
        return tests[0] & tests[1]

    return passes


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(words, item_ids as strings, sorted) for every distinct window; items without words have none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(text_col).alias("words"))
    items = items.filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    cut = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = cut.select("item_id", F.slice("words", F.col("at") + 1, F.lit(width)).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("item_ids"))


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_id": F.col(id_col), "_hash": F.xxhash64(text_or_empty(text_col))})


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def forward_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, n_words, kept) for every row: the words that may be ``terms``, as (at, word) in their order."""
    known = bloom(terms)
    cut = row_keys(docs, id_col, text_col).select(*KEY, words(text_col).alias("words"))
    # The position goes in ahead of the filter, so the array is walked once for each.
    placed = F.transform("words", lambda w, at: F.when(known(w), F.struct(at.alias("at"), w.alias("word"))))
    return staged(cut.select(*KEY, F.size("words").cast("long").alias("n_words"), F.filter(placed, lambda x: x.isNotNull()).alias("kept")), "decon-forward")


def rarest_terms(windows: DataFrame, forward: DataFrame, small: bool, rarest: int = RAREST) -> DataFrame:
    """(wid, words, rank, offset, term): the window's rarest distinct terms by their count in all documents."""
    offsets = windows.select("wid", "words", F.posexplode("words").alias("offset", "term"))
    # One row a term and task leaves the scan; the few terms of the filter that no window has drop out in the join.
    counts = forward.select(F.explode("kept.word").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts.join(_small(offsets.select("term").distinct(), small), "term", "left_semi"), "decon-counts")
    # One offset per term: its first in the window.
    first = offsets.groupBy("wid", "term").agg(F.min("offset").alias("offset"), F.first("words").alias("words"))
    ranked = first.join(_small(counts, small), "term", "left").groupBy("wid").agg(
        F.first("words").alias("words"),
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))), 1, rarest).alias("rare"),
    )
    # A window with an absent term occurs nowhere.
    ranked = ranked.filter(F.col("rare")[0]["n"] > 0)
    others = F.transform(F.slice("rare", 2, rarest), lambda t: F.struct(t["term"].alias("term"), t["offset"].alias("offset")))
    listed = ranked.select("wid", "words", F.size("rare").alias("terms"), others.alias("others"), F.posexplode("rare").alias("rank", "t"))
    # Only the rarest term's entry needs the window's words and its other terms.
    own = lambda c: F.when(F.col("rank") == 0, F.col(c)).alias(c)
    return listed.select("wid", "terms", "rank", "t.term", "t.offset", F.size("words").alias("n"), own("words"), own("others"))


def positional_index(forward: DataFrame, lookups: DataFrame, small: bool, width: int = WINDOW) -> DataFrame:
    """Postings (term, _id, _hash, at, around) of the looked-up terms; ``around`` holds the kept words near by.

    Kept words are at least as close in the array as in the text, so ``reach``
    entries to either side hold all words that are ``reach`` words away.
    """
    terms = lookups.groupBy("term").agg((F.min("rank") == 0).alias("is_rarest"))
    wanted, reach = bloom(terms.select("term")), width - 1 + SLACK

    def posting(x: Column, i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        near = F.slice("kept", first + 1, i + reach + 1 - first)
        return F.when(wanted(x["word"]), F.struct(x["word"].alias("term"), x["at"].alias("at"), near.alias("around")))

    cut = F.filter(F.transform("kept", posting), lambda x: x.isNotNull())
    rows = forward.select(*KEY, F.explode_outer(cut).alias("p")).filter("p is not null").select(*KEY, "p.*")
    found = rows.join(_small(terms, small), "term")
    return staged(found.select("term", *KEY, "at", F.when(F.col("is_rarest"), F.col("around")).alias("around")), "decon-postings")


def shifted(postings: DataFrame, lookups: DataFrame, small: bool) -> DataFrame:
    """Posting lists shifted by the offsets: where each window would start."""
    rows = postings.join(_small(lookups, small), "term").withColumn("start", F.col("at") - F.col("offset"))
    return rows.filter("start >= 0")


def phrase_matches(postings: DataFrame, lookups: DataFrame, small: bool) -> DataFrame:
    """Exact matches (_id, _hash, wid, start, n): all shifted lists agree and every word is the same."""
    rows = shifted(postings, lookups, small)
    here = F.filter("around", lambda x: (x["at"] >= F.col("start")) & (x["at"] < F.col("start") + F.col("n")))
    same = here["word"] == F.col("words")
    return (
        # A start that the words refute needs no partners.
        rows.withColumn("_same", F.when(F.col("rank") == 0, same))
        .filter("_same is null or _same")
        .groupBy("_id", "_hash", "wid", "start")
        .agg(
            F.first("n").alias("n"), F.first("terms").alias("terms"), F.bit_or(F.expr("shiftleft(1, rank)")).alias("lists"),
            F.max("_same").alias("same"),
        )
        .filter((F.bit_count("lists") == F.col("terms")) & F.col("same"))
        .select("_id", "_hash", "wid", "start", "n")
    )


def proximity_matches(postings: DataFrame, lookups: DataFrame, small: bool, slack: int = SLACK) -> DataFrame:
    """(_id, _hash, wid) where the other rare terms stand within ``slack`` words of where a phrase would have them."""
    rows = shifted(postings.filter("around is not null"), lookups.filter("rank = 0"), small)

    def stands(other: Column) -> Column:
        place = F.col("start") + other["offset"]
        return F.exists("around", lambda x: (x["word"] == other["term"]) & F.abs(x["at"] - place).between(0, slack))

    return rows.filter(F.forall("others", stands)).select("_id", "_hash", "wid").distinct()


def findings(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
) -> DataFrame:
    """One row for each distinct (id, text), as _id and _hash, with the columns of ``contamination`` and _rows, how often it comes."""
    windows = benchmark_windows(benchmark, item_col, item_text_col, width)
    # Numbers once written stay the same for every later read.
    windows = staged(windows.withColumn("wid", F.monotonically_increasing_id()), "decon-windows")
    chars = windows.agg(F.sum(F.octet_length(F.array_join("words", " ")))).first()[0] or 0
    small = chars <= BROADCAST_CHARS
    forward = forward_index(docs, windows.select(F.explode("words").alias("term")).distinct(), id_col, text_col)
    lookups = staged(rarest_terms(windows, forward, small), "decon-lookups")
    postings = positional_index(forward, lookups, small, width)
    exact = staged(phrase_matches(postings, lookups, small), "decon-phrases")
    # Covered words: starts in order, each adds what reaches beyond the ones before.
    spans = exact.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        "spans", zero,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["end"] - F.greatest(s["to"], x["start"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")
        ),
    )["n"]
    to_items = _small(windows.select("wid", F.explode("item_ids").alias("item")), small)
    items = exact.select(*KEY, "wid").distinct().join(to_items, "wid").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    near = proximity_matches(postings, lookups, small).join(to_items, "wid").groupBy(*KEY).agg(F.count_distinct("item").alias("near"))
    # One grouping brings the parts together; grouping keys of null are equal.
    facts = ("n_words", "_rows", "hit", "items", "near")
    parts = (
        forward.groupBy(*KEY).agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("_rows")),
        spans.select(*KEY, covered.cast("long").alias("hit")),
        items,
        near,
    )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    found = whole.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in facts])
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    values = (
        F.col("n_words"), n_hit,
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256),
        (n_hit > 0) & (SHARE * n_hit >= F.col("n_words")),
        F.coalesce("near", F.lit(0).cast("long")),
    )
    return found.select(*KEY, "_rows", *[v.alias(name) for v, name in zip(values, RESULTS, strict=True)])


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Null ids meet themselves and nothing else."""
    return left["_id"].eqNullSafe(right["_id"]) & (left["_hash"] == right["_hash"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "", **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, n_near (items near by the proximity rule).

    Null texts have no words and are clean.  A null item id counts as an item
    with an empty id.  Empty tables are fine on either side.  Repeated rows and
    ids each get what their text has; a very long text is one row of the forward
    index, of its benchmark words only.  Own columns of ``docs`` named like results
    are replaced; ``prefix`` goes before the results' names.
    """
    docs = docs.drop(*[prefix + c for c in RESULTS])
    found = findings(docs, benchmark, id_col, text_col, **options).drop("_rows")
    marked = row_keys(docs, id_col, text_col)
    joined = marked.join(found, same_row(marked, found), "left")
    return joined.select(*docs.columns, *[found[c].alias(prefix + c) for c in RESULTS])


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    found = staged(findings(docs, benchmark, id_col, text_col, **options).filter("contaminated").select(*KEY), "decon-contaminated")
    marked = row_keys(docs, id_col, text_col)
    return marked.join(found, same_row(marked, found), "left_anti").select(*docs.columns)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = findings(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    # A row for each row of the table; ids and counts are all that is left to repeat.
    rows = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return rows.select(F.col("_id").alias("doc_id"), *RESULTS)


OP10_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i + 1 : i + 13], ' ') as win
  from b, unnest(range(greatest(len(w) - 12, 1))) r(i) where len(w) > 0
), sizes as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as win
  from d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) r(i)
), m as (
  select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw using (win, n)
), h as (
  select doc_id, count(distinct i + k)::bigint as n_hit from m, unnest(range(n)) r(k) group by doc_id
), it as (
  select doc_id, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from m group by doc_id
), tok as (
  select doc_id, w[i + 1] as term, i from d, unnest(range(len(w))) r(i)
), offs as (
  select win, t as term, min(k - 1) as off
  from (select win, unnest(string_split(win, ' ')) as t, generate_subscripts(string_split(win, ' '), 1) as k from (select distinct win from bw))
  group by 1, 2
), freq as (select term, count(*) as n from tok where term in (select term from offs) group by term),
ranked as (
  select * from (
    select win, offs.term, off, coalesce(n, 0) as n,
      row_number() over o as rank, count(*) over (partition by win) as terms, min(coalesce(n, 0)) over (partition by win) as least
    from offs left join freq using (term) window o as (partition by win order by coalesce(n, 0), offs.term, off)
  ) where rank <= 2 and least > 0
), p as (select doc_id, win, terms, rank, i - off as start from tok join ranked using (term)),
near as (
  select distinct a.doc_id, a.win from p a left join p b on b.doc_id = a.doc_id and b.win = a.win and b.rank = 2
  where a.rank = 1 and a.start >= 0 and (a.terms = 1 or abs(b.start - a.start) <= 4)
), ni as (select doc_id, count(distinct item_id)::bigint as n_near from near join bw using (win) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_near, 0) as n_near, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join it using (doc_id) left join ni using (doc_id)
"""
