"""Scoring of retrieval, citations and rejections against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.ranking import nearest_rank
from folioflow.functions.text import collapse

CATEGORIES = ("ingredient", "sentencing_bail", "ipc_bns_mapping", "out_of_scope")


def _pieces_of(n: int):
    """All substrings of ``n`` characters of a word that has as many."""

    def cut(word: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - n + 1)
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    return cut


def _at_least(n: int):
    return lambda word: F.length(word) >= n


def contains_passage(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` of documents that contain a passage verbatim.

    A passage with words inside it is looked up by its longest inner word
    among the words of the documents.  Without one its first or last word may
    be part of a longer word of the document, so its longest word is looked up
    among the pieces of the documents' words, cut only to the lengths that such
    passages have.  A passage without any word is searched for everywhere.
    """
    pieces = F.split(F.lower("passage"), "[^a-z0-9_]+")
    longest = lambda words: F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    inner = longest(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))))
    anchors = passages.filter("passage is not null").select("query_id", inner.alias("word"), longest(pieces).alias("piece"))
    anchors = anchors.select(
        "query_id",
        F.when(F.col("word").isNotNull(), "word").when(F.col("piece") != "", "piece").otherwise("any").alias("kind"),
        F.coalesce("word", "piece").alias("term"),
    )
    # Lengths of the pieces of short passages: a handful of small numbers.
    lengths = [r[0] for r in anchors.filter("kind = 'piece'").select(F.length("term")).distinct().collect()]
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+"))
    tagged = lambda kind, terms: F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    terms = F.concat(tagged("word", words), tagged("any", F.array(F.lit(""))))
    for n in lengths:
        long = F.filter(words, _at_least(n))
        terms = F.concat(terms, tagged("piece", F.array_distinct(F.flatten(F.transform(long, _pieces_of(n))))))
    named = docs.select("doc_id", F.explode_outer(terms).alias("t")).select("doc_id", "t.kind", "t.term")
    pairs = named.join(anchors, ["kind", "term"]).select("query_id", "doc_id")
    located = docs.select("doc_id", "text").join(pairs, "doc_id").join(passages, "query_id")
    return located.filter(F.contains("text", F.col("passage"))).select("query_id", "doc_id")


def validate_eval(questions: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per question and broken rule of the golden set.

    ``questions(id, category, expected_sections, expected_cases,
    expected_themes, expected_to_reject)``; ``cases(case_name)``.
    """
    reject = F.col("expected_to_reject")
    empty = (F.size("expected_sections") == 0) & (F.size("expected_cases") == 0) & (F.size("expected_themes") == 0)
    rules = {
        "category": ~F.col("category").isin(*CATEGORIES),
        "reject_with_expectations": reject & ~empty,
        "no_expected_section": ~reject & (F.size("expected_sections") == 0),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    per_row = questions.select("id", F.explode(broken).alias("rule"))
    repeated = questions.groupBy("id").count().filter("count > 1").select("id", F.lit("id_not_unique").alias("rule"))
    named = questions.select("id", F.explode("expected_cases").alias("case_name"))
    unknown = named.join(cases.select("case_name").distinct(), "case_name", "left_anti")
    unknown = unknown.select("id", F.lit("unknown_case").alias("rule")).distinct()
    return per_row.unionByName(repeated).unionByName(unknown)


def recall_at_k(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, n_expected, n_found, recall)``: expected items among the first ``k`` hits.

    ``hits(query_id, item, rank)``, ``expected(query_id, item)``.
    """
    wanted = expected.select("query_id", "item").distinct()
    top = hits.filter(F.col("rank") <= k).select("query_id", "item").distinct().withColumn("__hit", F.lit(1))
    scored = wanted.join(top, ["query_id", "item"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_expected"), F.count("__hit").alias("n_found")
    )
    return scored.withColumn("recall", F.col("n_found") / F.col("n_expected"))


def name_key(col: Column) -> Column:
    """Name form for matching: lower case, no punctuation, single blanks."""
    return collapse(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", " "))


def citation_pr(cited: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision and recall of cited names per query, names matched by ``name_key``.

    Precision is null without citations, recall is null without expectations.
    """
    c = cited.select("query_id", name_key(F.col("name")).alias("key")).distinct().withColumn("__c", F.lit(1))
    e = expected.select("query_id", name_key(F.col("name")).alias("key")).distinct().withColumn("__e", F.lit(1))
    both = c.join(e, ["query_id", "key"], "full_outer").groupBy("query_id").agg(
        F.count("__c").alias("n_cited"),
        F.count("__e").alias("n_expected"),
        F.count_if(F.col("__c").isNotNull() & F.col("__e").isNotNull()).alias("n_right"),
    )
    return both.select(
        "*",
        F.when(F.col("n_cited") > 0, F.col("n_right") / F.col("n_cited")).alias("precision"),
        F.when(F.col("n_expected") > 0, F.col("n_right") / F.col("n_expected")).alias("recall"),
    )


def rejection_accuracy(outcomes: DataFrame) -> DataFrame:
    """Share of right accept/reject decisions, with both kinds of error."""
    want, got = F.col("expected_to_reject"), F.col("rejected")
    return outcomes.agg(
        F.count("*").alias("n"),
        F.count_if(want & ~got).alias("wrongly_answered"),
        F.count_if(~want & got).alias("wrongly_rejected"),
        F.avg((want == got).cast("double")).alias("rejection_accuracy"),
    )


def category_report(scored: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean metrics and latency percentiles per category, plus a ``composite`` row.

    The composite is the plain mean over categories, whatever their size.
    """
    means = scored.groupBy("category").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])
    ranks = nearest_rank(scored, "latency_ms", (50, 95, 99), by=["category"])
    latency = ranks.groupBy("category").agg(
        *[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}_latency_ms") for p in (50, 95, 99)]
    )
    report = means.join(latency, "category", "left")
    composite = means.agg(F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in metrics]).select(
        F.lit("composite").alias("category"),
        "n",
        *metrics,
        *[F.lit(None).cast("double").alias(f"p{p}_latency_ms") for p in (50, 95, 99)],
    )
    return report.unionByName(composite)
