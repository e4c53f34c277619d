"""Repeated strings against a dictionary of all windows, for short and real lengths and both group paths."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import suffix_dedup
from folioflow.llm.suffix_dedup import anchors, refine, sliding, without_repeats


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    windows = Counter(b[x : x + length] for _, b in texts for x in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for x in range(len(b) - length + 1):
            if windows[b[x : x + length]] > 1:
                gone[x : x + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(length, seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, hot = prose(length * 2), prose(length + 5)
    rows = [prose(rng.randrange(0, length * 3)) for _ in range(20)]
    rows += [prose(rng.randrange(0, 40)) + passage[a : a + length + b] + prose(30) for a, b in ((0, 0), (3, 5), (1, -9), (length // 2, 7), (0, length))]
    rows += [prose(rng.randrange(0, length)) + hot + prose(9) for _ in range(30)]
    rows += [passage + prose(5) + passage, "ab" * length, "a" * (length + 3), "a" * (length - 1), None, "", "x", "x"]
    rows += [rows[1] + rows[2] + rows[3]] * 2 + [rows[4] + "!"]
    near = prose(length * 4)
    rows += [near[:k] + "#" + near[k:] for k in range(0, length * 4, length // 3)]
    return [(i if i % 13 else None, t) for i, t in enumerate(rows)] + [(77, rows[5]), (77, rows[5])]


@pytest.mark.parametrize(("length", "gram", "group"), [(24, 5, 32_768), (24, 5, 3), (400, 64, 32_768)])
def test_repeats(spark, monkeypatch, length, gram, group):
    monkeypatch.setattr(suffix_dedup, "HOLD", 16)
    rows = corpus(length, length + group)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int").repartition(4)
    got = without_repeats(docs, length=length, gram=gram, group=group)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, length)


def test_long_text(spark, monkeypatch):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefg ") for _ in range(300_000))
    rows = [(1, long), (2, "x" + long[1000:1900]), (3, long[299_000:])]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in without_repeats(docs).collect()), key=repr) == brute(rows, 400)


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = without_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (row.n_bytes, row.n_removed, row.kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(2)
    for symbols in (2, 50):
        data = rng.integers(0, symbols, 3000).astype(np.uint8)
        for chunk in (1 << 20, 500):
            suffix_dedup.CHUNK = chunk
            where, hashes, *_ = anchors(data, 100, 10)
            flags = np.zeros(len(data), bool)
            flags[where] = True
            assert all(flags[x : x + 91].any() for x in range(len(data) - 99))
            assert len({data[w : w + 10].tobytes() for w in where}) == len(set(hashes.tolist()))
    suffix_dedup.CHUNK = 1 << 20


def test_sliding_and_refine():
    values = np.array([5, 1, 4, 2, 8, 3, 9, 7])
    for width in range(1, 9):
        assert sliding(values, width, np.minimum).tolist() == [min(values[i : i + width]) for i in range(9 - width)]
    words = [b"abc", b"abd", b"ab", b"xbc", b"abc"]
    symbols = np.zeros((5, 3), np.uint8)
    for i, w in enumerate(words):
        symbols[i, : len(w)] = list(w)
    steps = refine(np.zeros(5, np.int64), symbols, np.array([len(w) for w in words]))
    for n, classes in enumerate(steps):
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if len(a) >= n and len(b) >= n:
                    assert (classes[i] == classes[j]) == (a[:n] == b[:n])
