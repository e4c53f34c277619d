"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import configure, stage_path

# The white space and the word characters of the contracts.
SPACES = r"[\x20\x09-\x0D]+"
NON_SPACES = r"[^\x20\x09-\x0D]+"
# A word that may still hold A-Z; positions are the same as after lower-casing.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Shuffle files of a finished stage write are not needed again.
STAGE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = configure(df.sparkSession)
    path = stage_path(spark, name)
    before = {key: spark.conf.get(key, None) for key in STAGE_CONF}
    for key, value in STAGE_CONF.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


SUM_BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` reads it for every element of an array.

    A column that is only named is put in place of its name when the plan is
    made, so a lambda that reads it would compute it for each element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of the first 0, 1, 2, ... values of an array.

    Appending to an array copies it, so sums are made within blocks and shifted
    by the sums of the blocks before: about ``SUM_BLOCK`` copies a value.
    """
    none = F.array().cast("array<int>")

    def appended(sums: Column, value: Column) -> Column:
        return F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + value))

    def in_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SUM_BLOCK).cast("int"))
        starts = F.filter(starts, lambda b: (b >= 0) & (b * SUM_BLOCK < F.size(v)))
        return F.transform(starts, lambda b: F.aggregate(F.slice(v, b * SUM_BLOCK + 1, SUM_BLOCK), none, appended))

    def shifted(within: Column) -> Column:
        totals = F.transform(within, lambda block: F.element_at(block, -1))
        before = F.concat(F.array(F.lit(0)), F.aggregate(totals, none, appended))
        moved = F.zip_with(within, F.slice(before, 1, F.size(within)), lambda block, more: F.transform(block, lambda s: s + more))
        return F.concat(F.array(F.lit(0)), F.flatten(moved))

    return let(let(values, in_blocks), shifted)
