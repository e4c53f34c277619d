"""Metric pruning is exact and spares pairs; hashed search finds what it should."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import nearest
from folioflow.plans import retrieval


def frames(spark, entries, queries):
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(entries)], "chunk_id long, embedding array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, query_vec array<double>")
    return left.repartition(3), right.repartition(2)


def clustered(seed, groups=12, size=40, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.concatenate([c + noise * rng.standard_normal((size, dim)) for c in centres])


def plain(entries, queries, threshold):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.round(unit(queries) @ unit(entries).T, 6)
    best = score.argmax(axis=1)
    return {(q, int(e)) for q, e in enumerate(best) if score[q, e] > threshold}


@pytest.mark.parametrize("threshold", [0.92, 0.3, 0.999])
def test_pruning_is_exact(spark, monkeypatch, threshold):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    entries, queries = clustered(1), np.concatenate([clustered(1, size=5, noise=0.1), np.random.default_rng(2).standard_normal((30, 16))])
    entries = np.concatenate([entries, entries[:50], np.zeros((1, 16)), -entries[:3]])
    left, right = frames(spark, entries, np.concatenate([queries, entries[:5], np.zeros((1, 16))]))
    got = {(r.query_id, r.chunk_id) for r in nearest.nearest_above(left, right, threshold).collect()}
    assert got == plain(entries, np.concatenate([queries, entries[:5], np.zeros((1, 16))]), threshold)
    assert nearest.nearest_above(left.limit(0), right, threshold).count() == 0
    assert nearest.nearest_above(left, right.limit(0), threshold).count() == 0


def test_most_pairs_are_never_compared(spark):
    left, right = frames(spark, clustered(3, groups=40), clustered(3, groups=40))
    pairs = nearest.reached_blocks(left, right, 0.92)
    compared = pairs.agg(F.sum(F.size("q_ids") * F.size("e_ids"))).first()[0]
    assert compared < 0.15 * 1600**2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lsh_recall(spark):
    row = retrieval.lsh_recall(spark, "/root/testdata/sf0.01").first()
    assert row.expected == 200 and row.recall >= 0.95
    left, right = frames(spark, clustered(4, groups=30), clustered(4, groups=30, size=2))
    asked = nearest.signatures(right, "query_id", "query_vec", 8, 12, 1)
    candidates = nearest.signatures(left, "chunk_id", "embedding", 8, 12, 1).join(asked, ["table", "bucket"]).select("query_id", "chunk_id").distinct()
    assert candidates.count() < 0.3 * left.count() * right.count()
    assert nearest.lsh_topk(left.limit(0), right, 3).count() == 0


def test_lsh_makes_no_row_per_pair(spark):
    """Its result is that of the joined bucket tables, from at most ``k`` rows per query and task."""
    left, right = frames(spark, clustered(5, groups=30), clustered(5, groups=30, size=2))
    keys = ["table", "bucket"]
    tables = [nearest.signatures(df, key, vec, 8, 12, 1) for df, key, vec in ((left, "chunk_id", "embedding"), (right, "query_id", "query_vec"))]
    pairs = {tuple(r) for r in tables[0].join(tables[1], keys).select("query_id", "chunk_id").distinct().collect()}
    found = nearest.lsh_topk(left, right, 1000, tables=8, bits=12)
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == pairs
    assert "[table" not in found._jdf.queryExecution().executedPlan().toString()
    few = {(r.query_id, r["rank"]): r.score for r in nearest.lsh_topk(left, right, 3, tables=8, bits=12).collect()}
    assert few == {(r.query_id, r["rank"]): r.score for r in found.filter("rank <= 3").collect()}
