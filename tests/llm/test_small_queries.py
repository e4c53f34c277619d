"""Mixing, chat formatting and URL rules on small hand-made tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from folioflow.llm.chat import PLANTED_TEXT, format_conversations, loss_text, read_back
from folioflow.llm.mixing import mixed, repetitions, source_targets
from folioflow.llm.url_filter import build_cascade, judge_urls, listed_by, rules_frame

DOCS = "doc_id long, text string, source string, copy_no int"


def level_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share, stop, share the excess again: written as the contract says it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in names if s not in stopped)
        share = {s: rest * weight[s] / open_ for s in names if s not in stopped} if open_ else {}
        more = {s for s, t in share.items() if t >= cap * sizes[s]}
        if not more:
            return {**share, **{s: cap * sizes[s] for s in stopped}}
        stopped |= more


def test_targets(spark):
    sizes = {"b": 10, "a": 1000, "é": 5000, None: 3, "c": 0, "z": 700, "Z": 1}
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = source_targets(spark.createDataFrame(rows, "source string, size long"))
    want = level_targets(sizes)
    for row in got.collect():
        assert abs(row.target - want[row.source]) < 1e-6
        assert row.target <= 3 * row.source_size


def test_mix(spark):
    words = lambda i: " ".join(["w"] * (1 + i % 40))
    rows = [(i, words(i), "hot" if i % 3 else f"s{i % 5}", 7) for i in range(3000)]
    rows += [(-1, None, None, 7), (-2, "", "hot", 7), (None, "a b", "hot", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = repetitions(docs).cache()
    assert plan.count() == len(rows)
    assert plan.agg(F.max("copies")).first()[0] <= 3
    for row in plan.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect():
        assert abs(row.n - row.t) <= 0.02 * row.t + 40
    out = mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "copy_no"]
    again = repetitions(docs).agg(F.sum("copies")).first()[0]
    assert out.count() == again == plan.agg(F.sum("copies")).first()[0]


def test_mix_probability(spark):
    """One-document sources: the share of extra copies is the fraction; one source: every stretch has its share."""
    docs = spark.createDataFrame([(i, "w w", f"s{i:04}", 0) for i in range(3000)], DOCS)
    for row in repetitions(docs).groupBy("target").agg(F.count("*").alias("n"), F.avg("copies").alias("mean")).collect():
        rate = row.target / 2
        part = rate - int(rate)
        assert abs(row["mean"] - rate) < 4 * (part * (1 - part) / row.n) ** 0.5 + 1e-9
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 2 else "b", 0) for i in range(2000)], DOCS)
    for row in repetitions(docs).groupBy("source", "size").agg(F.first("target").alias("t"), F.first("source_size").alias("s"), F.count("*").alias("n"), F.sum("copies").alias("c")).collect():
        assert abs(row.c - row.n * row.t / row.s) <= 1


def test_mix_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert repetitions(docs).count() == 0 and mixed(docs).count() == 0
    no_words = spark.createDataFrame([(1, None, "a", 0), (2, " ", None, 0)], DOCS)
    assert [r.copies for r in repetitions(no_words).collect()] == [0, 0]


TURNS = [
    (1, 2, "user", "b"), (1, 1, "user", "### x: a"), (1, 3, "assistant", "\\</turn>\\\\"), (1, 4, "assistant", "### user: </turn>"),
    (2, 0, "assistant", None), (3, None, None, "x"), (3, 1, "a: \\b###", "</turn"), (4, 0, "user", ""), (4, 1, "assistant", "é" * 50_000),
    (-7, 0, "user", PLANTED_TEXT), (-7, 1, "assistant", PLANTED_TEXT), (None, 1, "user", "n"), (5, 1, "user", "t"), (5, 1, "user", "t"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    out = read_back(format_conversations(turns)).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    rows = {r.conv_id: r for r in out.collect()}
    assert len(rows) == 7
    for conv, row in rows.items():
        own = sorted(((t[1] if t[1] is not None else -1), t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in own]
        assert row.loss == "".join(x for _, r, x in own if r == "assistant")
    # Adjacent turns of one role share a heading.
    assert rows[1].formatted.count("### user: ") == 1 + rows[1].formatted.count("\\### user: ")


RULES = [("allow", "com", "/"), ("block", "x.com", "/en"), ("allow", "a.x.com", "/en"), ("block", "net", "/"), ("block", "", "/")]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    urls = [None, "", "x.com/en", "http://X.com/en/1?q#f", "http://a.x.com/en", "http://b.a.x.com/en#", "https://q.net", "https://q.net/",
            "http://ax.com/english", "http://x.com?/en", "http:///en", "ftp://É.NET/ü?x", "http://x.com/" + "y" * 100_000, "a://b://c.com/"]
    urls += [f"http://h{i}.x.com/en/{i}" for i in range(2000)] + [f"http://h{i}.example.org/de" for i in range(2000)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = rules_frame(spark, RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.pmod(F.xxhash64("key"), F.lit(7)) == 0)
    levels = build_cascade(listed, universe, deeper_bits=2.0)
    assert len(levels) > 1
    wrong = universe.filter(listed_by(levels, F.col("key")) != (F.pmod(F.xxhash64("key"), F.lit(7)) == 0))
    assert wrong.count() == 0


def test_turn_digest(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    row = read_back(format_conversations(turns)).first()
    assert row.formatted == "### user: a</turn>"
    assert hashlib.sha256(b"user\na\n").hexdigest() == hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in row.turns).encode()).hexdigest()
