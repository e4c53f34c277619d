"""Distributed forms against plain sequential models on random input."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioflow.functions import ranking
from folioflow.functions.running import running
from folioflow.operators import bm25, chunk, index, loganalytics, retrieve, sections


def test_running_matches_sequential(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randint(0, 50)])) for k in range(4) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    measures = {
        "total": ("sum", F.col("v"), True),
        "before": ("sum", F.col("v"), False),
        "top": ("max", F.col("v"), False),
        "seen": ("last", F.col("v"), True),
    }
    got = {
        (r.k, r.i): (r.total, r.before, r.top, r.seen)
        for r in running(df, ["k"], ["i"], F.floor(F.col("i") / 7), measures).collect()
    }
    back = {(r.k, r.i): r.nxt for r in running(df, ["k"], ["i"], F.floor(F.col("i") / 7), {"nxt": ("last", F.col("v"), False)}, reverse=True).collect()}
    for key in range(4):
        total, top, seen = 0, None, None
        mine = [(i, v) for k, i, v in rows if k == key]
        for n, (i, v) in enumerate(mine):
            before, top_before = total, top
            if v is not None:
                total, seen = total + v, v
                top = v if top is None else max(top, v)
            assert got[(key, i)] == (total, before, top_before, seen)
            assert back[(key, i)] == next((w for _, w in mine[n + 1 :] if w is not None), None)


def nearest(values, p):
    """The value that has at most as many smaller ones as its rank says, and with its equals more."""
    rank, counts, below = round(p / 100 * (len(values) - 1)), Counter(values), 0
    for value in sorted(counts):
        below += counts[value]
        if rank < below:
            return value


@pytest.mark.parametrize("buckets", [4096, 2, 3])
def test_nearest_rank(spark, monkeypatch, buckets):
    """Few buckets take many rounds."""
    monkeypatch.setattr(ranking, "BUCKETS", buckets)
    rng = random.Random(2)
    rows = []
    for size in (1, 2, 20, 21, 800):
        rows += [(size, float(rng.randint(0, 30))) for _ in range(size)]
    rows += [(None, v) for v in (7.0, -7.0, 5e-324, 0.0, -0.25)] + [(5, float("nan")), (5, None)]
    groups = {g: [v for h, v in rows if h == g and v is not None and v == v] for g in {g for g, _ in rows}}
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r.g, r.percent): r.value for r in ranking.nearest_rank(df, "v", (0, 50, 95, 100), ["g"]).collect()}
    assert got == {(g, p): nearest(values, p) for g, values in groups.items() for p in (0, 50, 95, 100) if values}
    whole = {r.percent: r.value for r in ranking.nearest_rank(df, "v", (50, 95)).collect()}
    assert whole == {p: nearest([v for values in groups.values() for v in values], p) for p in (50, 95)}
    assert ranking.nearest_rank(df.filter("v < -100"), "v", (50,)).count() == 0


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("double", [1.5e308, -1.5e308, float("inf"), float("-inf"), 5e-324, 1e-300, 1e300, 0.0, 1.0] + [2.0**i for i in range(-1000, 1000, 50)]),
        ("double", [1.0 + i * 2.0**-52 for i in range(50)] + [3.0] * 300),
        ("long", [2**62 + i for i in range(20)] + [2**53, 2**53 + 1] * 9),
        ("decimal(20,2)", [Decimal(i) / 4 for i in range(200)]),
    ],
)
def test_ranks_of_any_spread(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    percents = (0, 10, 33, 50, 77, 100)
    assert {r.percent: r.value for r in ranking.nearest_rank(df, "v", percents).collect()} == {p: nearest(values, p) for p in percents}


def replay(rows, client_limit, cap, calls):
    """The gates one request after the other."""
    used, served, called, out = {}, {}, {}, {}
    for day, ts, rid, client, rejected, hit in sorted(rows, key=lambda r: (r[1], r[2])):
        if used.get((day, client), 0) >= client_limit:
            out[rid] = "client_quota"
        elif served.get(day, 0) >= cap:
            out[rid] = "global_cap"
        elif called.get(day, 0) >= calls:
            out[rid] = "model_budget"
        else:
            out[rid] = None
            served[day] = served.get(day, 0) + 1
            if not rejected:
                used[(day, client)] = used.get((day, client), 0) + 1
                if not hit:
                    called[day] = called.get(day, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_admission_matches_replay(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for rid in range(600):
        ts = start + dt.timedelta(minutes=rng.randint(0, 3 * 24 * 60 - 1))
        # One client makes a third of all requests.
        client = "hot" if rng.random() < 0.34 else f"c{rng.randint(0, 40)}"
        rows.append((ts.date(), ts, rid, client, rng.random() < 0.2, rng.random() < 0.3))
    df = spark.createDataFrame(rows, "log_date date, ts timestamp, request_id int, hashed_ip string, rejected boolean, cache_hit boolean")
    limits = rng.randint(2, 6), rng.randint(40, 120), rng.randint(20, 70)
    got = {r.request_id: r.refused_by for r in loganalytics.admission(df, *limits).collect()}
    assert got == replay(rows, *limits)


def greedy(lengths, target, hard):
    """Chunk starts of the packing rule, one part after the other."""
    starts, open_len = [], None
    for i, n in enumerate(lengths):
        alone = hard is not None and n > hard
        if open_len is not None and not alone and open_len + 2 + n <= target:
            open_len += 2 + n
        else:
            starts.append(i)
            open_len = None if alone else n
    return [(a, b - a) for a, b in zip(starts, starts[1:] + [len(lengths)])]


@pytest.mark.parametrize("hard", [None, 2500])
def test_pack_matches_greedy(spark, hard):
    rng = random.Random(3)
    cases = [[rng.choice([1, 99, 100, 700, 998, 999, 1000, 1999, 2000, 2001, 2500, 2501, 3000]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<int>")
    for row in df.select("i", chunk.pack(F.col("n"), hard=hard).alias("p")).collect():
        assert [tuple(x) for x in row.p] == greedy(cases[row.i], 2000, hard)


def test_monotonic_and_gaps_match_sequential(spark):
    rng = random.Random(4)
    rows = []
    for act in range(20):
        for line in range(40):
            n = str(rng.randint(1, 60)) + ("A" if rng.random() < 0.2 else "")
            rows.append((act, line * 3, n))
    df = spark.createDataFrame(rows, "act_id int, line_no int, number string")
    kept = {(r.act_id, r.line_no) for r in sections.monotonic_sections(df).collect()}
    jumps = {(r.act_id, r.line_no, r.from_number, r.to_number) for r in sections.section_gaps(df).collect()}
    want_kept, want_jumps = set(), set()
    for act in range(20):
        top = last = None
        for a, line, n in rows:
            if a != act:
                continue
            if not n.isdigit():
                want_kept.add((a, line))
                continue
            if last is not None and int(n) - last > 5:
                want_jumps.add((a, line, last, int(n)))
            last = int(n)
            if top is None or last > top:
                top = last
                want_kept.add((a, line))
    assert kept == want_kept and jumps == want_jumps


def as_rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


def plain_bm25(docs, queries, k):
    words = {i: [w for w in re.split("[^a-z0-9_]+", (t or "").lower()) if len(w) >= 2] for i, t in docs}
    df, n = Counter(w for ws in words.values() for w in set(ws)), len(words)
    mean = sum(map(len, words.values())) / n if n else 0
    out = []
    for q, text in queries:
        terms = Counter(w for w in re.split("[^a-z0-9_]+", text.lower()) if len(w) >= 2)
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            score = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w, c in terms.items() if tf[w])
            if round(score, 6) > 0:
                scores.append((-round(score, 6), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_bm25_blocks_and_bounds(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(300)] + [(400, None), (401, "")]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(25)] + [(90, "?"), (91, "zzunknown")]
    want = plain_bm25(docs, queries, 4)
    chunk_table = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    query_table = spark.createDataFrame(queries, "query_id long, query string").repartition(2)
    monkeypatch.setattr(bm25, "SEGMENT_TOKENS", 500)
    for per_block in (1, 256):
        got = bm25.bm25_topk(chunk_table, query_table, 4, queries_per_block=per_block)
        assert [(q, r, i) for q, r, i, _ in as_rows(got)] == [(q, r, i) for q, r, i, _ in want]
        assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(as_rows(got), want, strict=True))
    assert bm25.bm25_topk(chunk_table.limit(0), query_table).count() == 0
    assert bm25.bm25_topk(chunk_table, query_table.limit(0)).count() == 0


def test_bm25_skips_blocks():
    """A rare word lifts the floor; blocks with only common words are never opened."""
    texts = [["the", "of"] * 10 for _ in range(640)]
    texts[100] = ["the", "rare"]
    texts[101] = ["rare"]
    terms, lists = bm25.segment_columns(pa.array(texts), 64)
    scorer = bm25.BlockScorer(pa.array(["the", "rare"]), np.array([0, 0]), np.array([0, 1]), np.array([0.01, 5.0]), 1, 2, 20.0)
    scorer.add(np.arange(640), terms, lists, 64)
    assert (scorer.blocks, scorer.skipped) == (10, 9)
    assert sorted(scorer.running.best[0][1].tolist()) == [100, 101]
    scorer.add(np.arange(640) + 1000, *bm25.segment_columns(pa.array([["other"]] * 640), 64), 64)
    assert scorer.skipped == 19


def test_bm25_plans_without_collecting(spark, sf, monkeypatch):
    from folioflow import fixtures as fx
    from folioflow.plans.retrieval import chunks

    def forbidden(*_):
        raise AssertionError("collected while planning")

    for name in ("toArrow", "collect", "toPandas"):
        monkeypatch.setattr(type(chunks(spark, sf)), name, forbidden)
    bm25.bm25_topk(chunks(spark, sf), fx.text_queries(spark, sf), 3)


def test_tokens_of_batches_are_the_expressions(spark):
    from folioflow.functions.text import search_text, token_lists, tokens

    rng = random.Random(3)
    marks = ["a", "B", "z9", "_", "0", " ", " ", "\n", "-", "§", "é", "ß", "\u0130", "\u212a", "\u4e2d", "\U0001f600", "x" * 40]
    texts = [None, "", "a", "ab", "a b", "§", "a§", "\u212ab", "", "ends in one x", "y begins", "zz", None]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    rows = frame.select(search_text(F.col("text")).alias("text"), tokens(F.col("text")).alias("tokens")).collect()
    expected = [r.tokens or [] for r in rows]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array([r.text for r in rows], kind)
        assert token_lists(column).to_pylist() == expected
        assert token_lists(column[7:95]).to_pylist() == expected[7:95]
        assert token_lists(column[:0]).to_pylist() == []
    assert token_lists(pa.array([None, None], pa.string())).to_pylist() == [[], []]
    # Texts pass to the batches; no array of tokens is made ahead of them.
    made = bm25.build_segments(frame.select(F.col("n").alias("chunk_id"), "text"))
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {n: terms for r in made.collect() for n, terms in zip(r.chunk_ids, [[] for _ in r.chunk_ids])}
    for r in made.collect():
        term = [t for t, n in zip(r.terms, r.df) for _ in range(n)]
        for t, at, tf in zip(term, r.post_chunk, r.post_tf):
            got[r.chunk_ids[at]] += [t] * tf
    assert [sorted(got[n]) for n in range(len(texts))] == [sorted(t) for t in expected]


def test_bm25_segments_stay_where_they_lie(spark, monkeypatch):
    """Queries from many partitions make full blocks, segments go on over Arrow batches and are not shuffled, further rounds change nothing."""
    docs = [(i, f"common w{i % 7} w{i % 11} only{i}") for i in range(300)]
    queries = [(i, f"common w{i % 5} only{i * 3}") for i in range(40)]
    chunk_table = spark.createDataFrame(docs, "chunk_id long, text string").coalesce(1)
    query_table = spark.createDataFrame(queries, "query_id long, query string").repartition(6)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")
    try:
        index_of = bm25.segment_index(chunk_table)
    finally:
        spark.conf.set(key, before)
    assert sorted(len(r.chunk_ids) for r in index_of.segments.select("chunk_ids").collect()) == [300]
    assert bm25.query_blocks(query_table, index_of).count() == 1
    found = bm25.bm25_topk(index_of, query_table, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(part" not in plan and "BroadcastNestedLoopJoin" in plan
    want = as_rows(found)
    monkeypatch.setattr(bm25, "ROUND", 2)
    assert as_rows(bm25.bm25_topk(index_of, query_table, 3, queries_per_block=3)) == want
    assert [(q, r, i) for q, r, i, _ in want] == [(q, r, i) for q, r, i, _ in plain_bm25(docs, queries, 3)]


def test_vector_blocks(spark, sf):
    from folioflow import fixtures as fx
    from folioflow.plans.retrieval import vectors

    queries = fx.vec_queries(spark, sf)
    small = as_rows(retrieve.vector_topk(vectors(spark, sf), queries, fx.DIM, 5))
    for block in (1, 7, 4096):
        assert small == as_rows(retrieve.vector_topk(vectors(spark, sf), queries, fx.DIM, 5, block=block))


def test_rejected_vectors(spark):
    nan = float("nan")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [nan, 1.0]), (5, [0.0, 2.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(10, [1.0]), (11, [1.0, 0.0])], "query_id long, query_vec array<double>")
    for block in (1, 5):
        rows = retrieve.vector_topk(vectors, queries, 2, block=block).collect()
        assert [(r.query_id, r.chunk_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(11, 1, 1.0), (11, 5, 0.0)]
    found = {(r.side, r.id): r.reason for r in retrieve.rejected_vectors(vectors, queries, 2).collect()}
    assert found == {("chunk", 2): "dimension", ("chunk", 3): "missing", ("chunk", 4): "not_finite", ("query", 10): "dimension"}


def test_index_round_trip(spark, sf, tmp_path):
    from folioflow import fixtures as fx
    from folioflow.plans.retrieval import chunks

    docs, queries = chunks(spark, sf), fx.text_queries(spark, sf)
    bm25.write_segments(docs, str(tmp_path))
    bm25.build_segments(docs.coalesce(1), 8).write.options(**bm25.SEGMENT_FILES).parquet(f"{tmp_path}/many/segments")
    stored = bm25.read_segments(spark, str(tmp_path))
    # A reader decodes a whole row group at once.
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("many/segments/*.parquet")]
    assert sum(f.num_rows for f in files) > 8 and max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 4
    assert as_rows(bm25.bm25_topk(stored, queries, 3)) == as_rows(bm25.bm25_topk(docs, queries, 3))
    built = index.build_postings(docs)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(stored.postings) == rows(built.postings.select("term", "chunk_id", "tf", "dl"))
    assert rows(stored.docs) == rows(built.docs)
    assert rows(stored.terms) == rows(built.terms)
