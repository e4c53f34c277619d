"""Helpers of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.llm import common


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(common, "SUM_BLOCK", 4)
    rows = [(i, [((j * 7 + i) % 11) - 3 for j in range(i)]) for i in range(18)]
    df = spark.createDataFrame(rows, "id int, v array<int>").select("id", "v", common.running_sums(F.col("v")).alias("s"))
    for row in df.collect():
        assert row.s == [sum(row.v[:i]) for i in range(len(row.v) + 1)]
