"""Search index tables: postings, vector table, metadata, consistency checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.ranking import duplicate_keys, first_by_key, latest_by_key
from folioflow.functions.text import tokens


@dataclass(frozen=True)
class InvertedIndex:
    """``postings(term, chunk_id, tf, dl)``, ``terms(term, df)``, one-row ``stats(n_docs, avg_len)``, ``docs(chunk_id, dl)``."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    docs: DataFrame


def tokenize(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text)))


def build_postings(chunks: DataFrame) -> InvertedIndex:
    """Inverted index of ``chunks(chunk_id, text)``.

    The document length travels with each posting, so scoring needs no join
    back to the chunks.
    """
    docs = tokenize(chunks.select("chunk_id", "text")).select("chunk_id", "tokens", F.size("tokens").alias("dl"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))
    # The outer form: below the plain one Catalyst would tokenize again in a filter.
    words = docs.select("chunk_id", "dl", F.explode_outer("tokens").alias("term")).filter("term is not null")
    # A chunk's tokens sit in one map task, so partial aggregation already
    # gives one row per (term, chunk).
    postings = words.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return InvertedIndex(postings, postings.groupBy("term").agg(F.count("*").alias("df")), stats, docs.select("chunk_id", "dl"))


def build_vector_table(chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Join chunks and vectors on ``chunk_id``.

    Both inputs carry an ``ordinal``.  Of repeated chunks the first counts, of
    repeated vectors the last.  Returns the table, the repeated chunk ids and
    the chunks without a vector.
    """
    first = first_by_key(chunks, ["chunk_id"], ["ordinal"]).drop("ordinal")
    usable = embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    last = latest_by_key(usable, ["chunk_id"], ["ordinal"]).drop("ordinal")
    return first.join(last, "chunk_id"), duplicate_keys(chunks, "chunk_id"), first.join(last, "chunk_id", "left_anti")


def flatten_metadata(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """``metadata`` struct to a string map without nulls.

    Arrays are joined by commas; version, character and token counts are added.
    """
    fields = chunks.schema[metadata].dataType.fields
    names, values = [], []
    for field in fields:
        col = F.col(metadata)[field.name]
        is_array = field.dataType.typeName() == "array"
        values.append(F.array_join(col.cast("array<string>"), ",") if is_array else col.cast("string"))
        names.append(F.lit(field.name))
    for name in ("corpus_version", "char_count", "approx_token_count"):
        names.append(F.lit(name))
        values.append(F.col(name).cast("string"))
    pairs = F.map_from_arrays(F.array(*names), F.array(*values))
    return chunks.withColumn(metadata, F.map_filter(pairs, lambda _, v: v.isNotNull()))


def verify_indexes(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings ``(severity, finding, n)`` over the ids of the vector table and the text index's ``docs``.

    Ids only in the vector table are an error, ids only in the text index are
    pending vectors, an empty index fails.
    """
    vec_ids, text_ids = vectors.select("chunk_id").distinct(), docs.filter("dl > 0").select("chunk_id").distinct()
    both = vec_ids.withColumn("__v", F.lit(1)).join(text_ids.withColumn("__t", F.lit(1)), "chunk_id", "full_outer")
    counts = both.agg(
        F.count_if(F.col("__t").isNull()).alias("only_vectors"),
        F.count_if(F.col("__v").isNull()).alias("only_text"),
        F.count("__v").alias("in_vectors"),
        F.count("__t").alias("in_text"),
    )
    findings = F.array(
        F.struct(
            F.when(F.col("only_vectors") > 0, "error").otherwise("ok").alias("severity"),
            F.lit("only_in_vectors").alias("finding"),
            F.col("only_vectors").alias("n"),
        ),
        F.struct(
            F.when(F.col("only_text") > 0, "info").otherwise("ok").alias("severity"),
            F.lit("only_in_text").alias("finding"),
            F.col("only_text").alias("n"),
        ),
        F.struct(
            F.when(F.col("in_vectors") == 0, "error").otherwise("ok").alias("severity"),
            F.lit("vector_rows").alias("finding"),
            F.col("in_vectors").alias("n"),
        ),
        F.struct(
            F.when(F.col("in_text") == 0, "error").otherwise("ok").alias("severity"),
            F.lit("text_rows").alias("finding"),
            F.col("in_text").alias("n"),
        ),
    )
    types = vectors.groupBy(F.coalesce("source_type", F.lit("?")).alias("source_type")).agg(F.count("*").alias("n"))
    return counts.select(F.inline(findings)).unionByName(
        types.select(F.lit("ok").alias("severity"), F.concat(F.lit("type:"), "source_type").alias("finding"), "n")
    )


def smoke_check(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Pass per query when any expected section number shows in its hits.

    ``hits(query_id, chunk_id, reference)`` holds free text naming sections;
    ``expected(query_id, sections)`` an array.  Numbers have one to three digits.
    """
    numbers = hits.select(
        "query_id", F.explode(F.regexp_extract_all("reference", F.lit(r"\b(\d{1,3})\b"), F.lit(1))).alias("section")
    ).distinct()
    wanted = expected.select("query_id", F.explode("sections").alias("section")).distinct()
    found = wanted.join(numbers, ["query_id", "section"]).groupBy("query_id").agg(F.count("*").alias("n_found"))
    return expected.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.coalesce(F.col("n_found") > 0, F.lit(False)).alias("passed"),
    )
