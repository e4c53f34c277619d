"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v) that is not the least of its component.

    Each round replaces the edges by links to smaller nodes; it needs a minimum
    per node (combined ahead of the shuffle) and a join, whose large keys AQE
    splits.  Rounds are staged, so none repeats the ones before.  The number of
    rounds grows with the logarithm of the longest path.
    """
    e = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = staged(e.distinct(), "cc")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        before, state = state, _state(e)
        if before == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
