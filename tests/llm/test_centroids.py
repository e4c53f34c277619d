"""Centroid clustering: against plain comparison of everything, saved distances, awkward rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from folioflow.llm.centroids import Searcher, State, clusters, moved, op11_centroids, squared


def nearest(vectors, centroids):
    d = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d


@pytest.mark.parametrize("k", [1, 2, 3, 17])
def test_search_is_exact(k):
    rng = np.random.default_rng(k)
    for spread in (2, 40, 10**6):  # few values make many ties
        vectors = rng.integers(-spread, spread + 1, (300, 5))
        vectors[::3] = vectors[0]
        centroids = vectors[rng.integers(0, 300, k)]
        state = Searcher(centroids).first(vectors)
        for _ in range(6):
            own, d = nearest(vectors, centroids)
            assert (state.cluster == own).all()
            if k > 1:
                rest = d.astype(float)
                rest[np.arange(300), own] = np.inf
                assert (state.lower <= np.sqrt(rest.min(axis=1))).all()
                assert (state.upper >= np.sqrt(d.min(axis=1)) * (1 - 1e-12)).all()
            new = centroids + rng.integers(-spread // 4 - 1, spread // 4 + 2, centroids.shape)
            moved(state, np.sqrt(((new - centroids).astype(float) ** 2).sum(axis=1)))
            centroids = new
            Searcher(centroids).settle(vectors, state)


def test_far_pairs_are_not_compared():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (64, 16))
    vectors = np.concatenate([c + rng.integers(-20, 21, (50, 16)) for c in centroids])
    searcher = Searcher(centroids)
    state = searcher.first(vectors)
    assert (state.cluster == nearest(vectors, centroids)[0]).all()
    searcher.compared = 0
    moved(state, np.full(64, 3.0))
    searcher.settle(vectors, state)
    assert searcher.compared == 0
    state = State(state.cluster, state.second, np.full(len(vectors), np.inf), np.zeros(len(vectors)))
    searcher.settle(vectors, state)
    assert searcher.compared < 6 * len(vectors)


def test_distances_beyond_64_bits():
    far = np.array([[2**31, 0], [1, 1]])
    assert squared(far, np.array([0, 0])).tolist() == [2**62, 2]
    with pytest.raises(OverflowError):
        squared(far, np.array([-(2**31), 0]))


def plain(rows, dimensions, k, rounds):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    chosen = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in chosen]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return sorted((str(i), *reversed(assign(v))) for i, v in kept), centroids


@pytest.mark.parametrize("k", [1, 4, 60])
def test_rows(spark, k):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 3) / 16]) for i in range(40)]
    rows += [(i % 2, [0.25, -0.5, 0.0]) for i in range(30)] + [(None, [0.1, 0.2, 0.3]), (None, [-0.1, -0.2, 0.3])]
    rows += [(90, None), (91, []), (92, [1.0, 2.0]), (93, [1.0, None, 2.0]), (94, [1.0, float("nan"), 0.0]), (95, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    found, centroids = clusters(df.repartition(3), dimensions=3, k=k)
    want, want_centroids = plain(rows, 3, k, 3)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert centroids.tolist() == want_centroids
    empty, none = clusters(df.filter("vec_id > 90"), dimensions=3, k=k)
    assert empty.columns == found.columns and empty.count() == 0 and len(none) == 0


def test_query_on_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11_centroids(spark, str(tmp_path)).count() == 0
