"""A query is copied to a bounded number of rings, also where no pair can be pruned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import nearest


def test_few_copies_of_a_query(spark):
    rng = np.random.default_rng(7)
    entries = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 64)) + 0.5)]
    left = spark.createDataFrame(entries, "chunk_id long, embedding array<double>")
    right = left.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pairs = nearest.reached_blocks(left, right, 0.92)
    copies = pairs.select("cell", "ring", F.explode("q_ids").alias("q")).distinct().count()
    assert copies <= 30 * 1500
    # The only entry above the threshold is the query itself.
    found = nearest.nearest_above(left, right, 0.92).collect()
    assert len(found) == 1500 and all(r.query_id == r.chunk_id for r in found)
