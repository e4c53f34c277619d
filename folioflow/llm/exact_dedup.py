"""Exact duplicates by skew-safe combining of digest groups.

Three stages, each of which groups by the whole normalised text next to its
digest, so two texts are only ever merged when they are equal character by
character:

1. every map task combines its own rows (the partial aggregate),
2. what the tasks keep meets in salted digest groups, so a text that a third
   of all rows share is dealt over ``salts`` tasks,
3. the salt winners, at most ``salts`` rows a text, are combined globally.

A document then finds its group by digest.  Groups of a thousandth of all rows or
more, of which there are at most a thousand, are looked up from a broadcast and
their rows dealt out evenly; no key of the shuffle has more rows than that.  Should two different texts share a
digest, stage 3 marks them and the lookup also compares the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SPACES, staged, table, text_or_empty

SALTS = 16
# A group of this share of all rows is hot; so there are at most HOT of them.
HOT = 1000


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    salts: int = SALTS, digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 for every row.

    Null texts count as empty.  Of equal texts the smallest id stays (a null id
    only where the whole group has none); rows that repeat that id all count as
    kept, see ``deduplicated`` for one row each.  Columns of ``docs`` with the
    names of the results are replaced.  Empty tables give empty results.
    """
    spark = docs.sparkSession
    results = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*[c for c in docs.columns if c in results])
    keyed = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm")).withColumn("_digest", digest(F.col("_norm")))
    salt = (F.spark_partition_id() % F.lit(salts)).alias("_salt")
    salted = keyed.groupBy("_digest", salt, "_norm").agg(F.min("_id").alias("_min"), F.count(F.lit(1)).alias("_n"))
    winners = salted.groupBy("_digest", "_norm").agg(F.min("_min").alias("keep_id"), F.sum("_n").alias("group_size"))
    found = staged(winners.select("_digest", "keep_id", "group_size", F.length("_norm").alias("_length")), "exact-groups")
    clashing = found.groupBy("_digest").count().filter("count > 1")
    shown = docs.withColumn("_norm", normalised(text_col)).withColumn("_digest", digest(F.col("_norm")))
    if clashing.isEmpty():
        total = found.agg(F.sum("group_size")).first()[0] or 0
        hot = found.filter(F.col("group_size") * HOT >= total).select(F.col("_digest").alias("_hot"), F.col("keep_id").alias("_hot_id"), F.col("group_size").alias("_hot_size"))
        known = shown.join(F.broadcast(hot), F.col("_digest") == F.col("_hot"), "left")
        # Rows of hot groups need no partner any more: keys that no group has.
        spread = F.when(F.col("_hot").isNotNull(), F.concat(F.lit("-"), F.xxhash64(F.col(id_col)).cast("string"))).otherwise(F.col("_digest"))
        cold = found.select(F.col("_digest").alias("_key"), "keep_id", "group_size")
        joined = known.withColumn("_key", spread).join(cold, "_key", "left")
        joined = joined.withColumns({"keep_id": F.when(F.col("_hot").isNotNull(), F.col("_hot_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("_hot_size", "group_size")})
    else:
        joined = shown.join(winners, ["_digest", "_norm"], "left")
    kept = F.coalesce(F.col(id_col) == F.col("keep_id"), F.col("keep_id").isNull())
    text_sha = F.col("_digest") if digest is sha256 else F.sha2("_norm", 256)
    return joined.select(
        *docs.columns, "keep_id", F.col("group_size").cast("long").alias("group_size"),
        kept.alias("kept"), text_sha.alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per distinct text, with its own columns; of rows that repeat id and text any one stays."""
    marked = exact_groups(docs, id_col, text_col).filter("kept")
    return marked.dropDuplicates(["keep_id", "text_sha256"]).select(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g using (norm)
"""
