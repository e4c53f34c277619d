"""Prompts from hits, citation verification and citation cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCERPT_CHARS = 300
MARKER = r"\[(\d+)\]"


def source_header(number: Column) -> Column:
    """Header line of a numbered source, by type.

    Acts show short name, section and heading; judgments show the case with
    citation, court and year in brackets.
    """
    tag = F.concat(F.lit("["), number.cast("string"), F.lit("]"))
    act = F.concat(
        tag,
        F.lit(" "),
        F.coalesce(F.nullif(F.col("short_name"), F.lit("")), F.col("act_id"), F.lit("?")),
        F.lit(" §"),
        F.coalesce("section_number", F.lit("?")),
        F.when(F.coalesce("section_heading", F.lit("")) != "", F.concat(F.lit(" — "), "section_heading")).otherwise(""),
    )
    bits = F.filter(
        F.array(F.col("citation"), F.col("court"), F.col("year").cast("string")), lambda b: b.isNotNull() & (b != "")
    )
    judgment = F.concat(
        tag,
        F.lit(" "),
        F.coalesce("case_name", F.lit("Unknown case")),
        F.when(F.size(bits) > 0, F.concat(F.lit(" ("), F.array_join(bits, ", "), F.lit(")"))).otherwise(""),
    )
    return F.when(F.col("source_type") == "act", act).when(F.col("source_type") == "judgment", judgment).otherwise(tag)


def build_prompts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: numbered sources in rank order, then the question.

    ``hits(query_id, rank, text, metadata columns)`` are the few final hits of
    each query.
    """
    block = F.concat(source_header(F.col("rank")), F.lit("\n"), "text")
    blocks = hits.select("query_id", "rank", block.alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    joined = queries.select("query_id", "query").join(
        blocks.groupBy("query_id").agg(F.array_join(ordered["block"], "\n\n").alias("__sources")), "query_id", "left"
    )
    question = F.concat(F.lit("QUESTION: "), "query")
    with_sources = F.concat(F.lit("SOURCES:\n\n"), F.col("__sources"), F.lit("\n\n"), question)
    without = F.concat(question, F.lit("\n\n(No relevant sources were found.)"))
    return joined.select("query_id", F.coalesce(with_sources, without).alias("prompt"))


def verify_citations(answers: DataFrame) -> DataFrame:
    """Check ``[n]`` markers of ``answers(query_id, answer_text, n_sources)``.

    Adds ``cited`` (all markers in order), ``used`` (valid numbers in
    first-cited order), ``stripped`` (invalid numbers, sorted) and
    ``clean_text``: invalid markers removed, and only then double blanks and
    blanks before punctuation tidied.  Numbers are kept as digit strings
    without leading zeros, so no marker overflows.
    """
    digits = F.transform(
        F.regexp_extract_all("answer_text", F.lit(MARKER), F.lit(1)),
        lambda d: F.regexp_replace(d, "^0+(?=[0-9])", ""),
    )
    staged = answers.withColumn("__digits", digits)
    total = F.col("n_sources").cast("bigint")

    def is_valid(d: Column) -> Column:
        number = d.try_cast("bigint")
        return F.coalesce(number.between(F.lit(1), total), F.lit(False))

    used = F.transform(F.array_distinct(F.filter("__digits", is_valid)), lambda d: d.cast("int"))
    wrong = F.array_distinct(F.filter("__digits", lambda d: ~is_valid(d)))
    by_size = F.transform(wrong, lambda d: F.struct(F.length(d).alias("n"), d.alias("d")))
    staged = staged.select(
        "*", used.alias("used"), F.array_sort(by_size)["d"].alias("stripped")
    )
    pattern = F.concat(F.lit(r"\[0*(?:"), F.array_join("stripped", "|"), F.lit(r")\]"))
    removed = F.regexp_replace(F.col("answer_text"), pattern, F.lit(""))
    tidy = F.regexp_replace(F.regexp_replace(removed, " {2,}", " "), " ([.,;:!?])", "$1")
    return staged.select(
        *answers.columns,
        F.col("__digits").alias("cited"),
        "used",
        "stripped",
        F.when(F.size("stripped") > 0, tidy).otherwise(F.col("answer_text")).alias("clean_text"),
    )


def citation_cards(verified: DataFrame, hits: DataFrame) -> DataFrame:
    """One card per used source.

    ``card_index`` is the place in first-cited order, ``marker`` the number
    left in the text; they differ when citations are sparse.
    """
    used = verified.select("query_id", F.posexplode("used").alias("__pos", "marker"))
    joined = used.join(hits.withColumnRenamed("rank", "marker"), ["query_id", "marker"])
    is_act = F.coalesce("source_type", F.lit("act")) == "act"
    act_label = F.trim(
        F.concat(
            F.coalesce(F.nullif(F.col("short_name"), F.lit("")), F.col("act_id"), F.lit("")),
            F.lit(" §"),
            F.coalesce("section_number", F.lit("")),
        )
    )
    case_label = F.coalesce(F.nullif(F.col("citation"), F.lit("")), F.col("case_name"), F.lit(""))
    known = F.col("source_type").isin("act", "judgment")
    return joined.select(
        "query_id",
        (F.col("__pos") + 1).alias("card_index"),
        "marker",
        "chunk_id",
        F.when(known, F.col("source_type")).otherwise("act").alias("source_type"),
        F.when(is_act, act_label).otherwise(case_label).alias("citation"),
        F.when(F.length("text") > EXCERPT_CHARS, F.concat(F.substring("text", 1, EXCERPT_CHARS), F.lit("…")))
        .otherwise(F.col("text"))
        .alias("excerpt"),
        # A case's page comes before the address it was collected from; acts have no separate file.
        F.when(is_act, F.col("source_url")).otherwise(F.coalesce(F.nullif(F.col("indian_kanoon_url"), F.lit("")), F.col("source_url"))).alias("source_url"),
        F.when(is_act, F.lit(None)).otherwise(F.col("pdf_filename")).alias("pdf_url"),
        F.when(is_act, F.lit(None)).otherwise(F.col("court")).alias("court"),
        F.when(is_act, F.lit(None)).otherwise(F.col("year")).alias("year"),
    )
