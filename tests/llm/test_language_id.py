"""Language ID: vectors against a plain count, held-out accuracy, rejection and awkward rows."""

from __future__ import annotations

import base64
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.llm import language_id
from folioflow.llm.arrow_text import flat
from folioflow.llm.language_id import accepted, fit, held_out, op9_language_id, predict, trigram_counts


def plain_counts(text, dimensions):
    folded = bytes(b if b >= 128 or chr(b).islower() else (b + 32 if chr(b).isupper() else 32) for b in text.encode())
    cells = Counter()
    for i in range(len(folded) - 2):
        a, b, c = folded[i : i + 3]
        cells[((((a << 16 | b << 8 | c) * 2654435761) % 2**32) >> 16) % dimensions] += 1
    return cells


def test_counts(monkeypatch):
    texts = ["", "a", "ab", "abc", "É! x Yz " * 50, "abcdefgh" * 9]
    want = [plain_counts(t, 512) for t in texts]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        got = trigram_counts(*flat(pa.array(["skip", *texts]).slice(1)), 512)
        assert [{i: n for i, n in enumerate(row) if n} for row in got] == [dict(w) for w in want]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in rows)


def plain_model(rows, dimensions, clusters):
    """Weights, centroids and the nearest of them, one text and one cell after the other."""
    counted = [(label, plain_counts(f" {text} ", dimensions)) for label, text in rows]
    present = Counter(cell for _, c in counted for cell in c)
    idf = [math.log((1 + len(rows)) / (1 + present[cell])) + 0.05 for cell in range(dimensions)]

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    def weighed(c):
        return unit([(1 + math.log(c[cell])) * idf[cell] if c[cell] else 0.0 for cell in range(dimensions)])

    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    mean = lambda vs: [sum(x) / len(vs) for x in zip(*vs, strict=True)]
    centres = []
    for language in sorted({label for label, _ in rows}):
        own = [weighed(c) for label, c in sorted(counted, key=lambda r: (r[0], np.array([r[1][i] for i in range(dimensions)], np.uint16).tobytes())) if label == language]
        middle = mean(own)
        chosen = [max(range(len(own)), key=lambda i: dot(own[i], middle))]
        while len(chosen) < min(clusters, len(own)):
            chosen.append(min(range(len(own)), key=lambda i: max(dot(own[i], own[j]) for j in chosen)))
        found = [own[i] for i in chosen]
        for _ in range(language_id.ROUNDS):
            groups = [[] for _ in found]
            for v in own:
                groups[max(range(len(found)), key=lambda k: dot(v, found[k]))].append(v)
            found = [unit(mean(g)) if g else c for g, c in zip(groups, found, strict=True)]
        centres += [(language, c) for c in found]
    return lambda text: max(((dot(weighed(plain_counts(f" {text} ", dimensions)), c), language) for language, c in centres), key=lambda x: x[0])


def test_against_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 600 and lang is not null").orderBy("doc_id").limit(80)
    rows = docs.collect()
    model = fit(docs, dimensions=256, clusters=2)
    nearest = plain_model([(r.lang, r.text) for r in rows], 256, 2)
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    for r in rows:
        score, language = nearest(r.text)
        assert abs(got[r.doc_id].score - score) < 1e-4
        assert got[r.doc_id].lang_pred in (language, "und")


def test_awkward_rows(spark):
    en, de = "the and of to in is that it was for " * 3, "der und die zu den das nicht von sie ist " * 3
    rows = [(i, en + str(i), "en", "s") for i in range(40)] + [(i + 100, de + str(i), "de", "s") for i in range(40)]
    rows += [(500, None, "en", "s"), (501, "", None, "s"), (502, "123 !?", "de", "s"), (503, "the of " * 200_000, None, None),
             (504, "Жщюйъ фыв ёпрст цхч шщ", None, "s"), (None, "the and", "en", "s"), (505, "x", "en", "s"), (505, "x", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = fit(docs)
    assert model.languages == ("de", "en")
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    assert (got[500].lang_pred, got[501].lang_pred, got[502].lang_pred) == ("und", "und", "und")
    assert got[500].rejected and got[504].rejected and not got[503].rejected
    assert got[503].lang_pred == "en" and got[105].lang_pred == "de"
    kept = accepted(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id in (500, 501, 502, 504)").count() == 0
    assert kept.filter("doc_id = 505").count() == 2


def noise(n):
    """Texts of ``n`` characters without a language."""
    rng = random.Random(n)
    draw = lambda first, last: "".join(chr(rng.randint(first, last)) for _ in range(n))
    words = lambda first, last: "".join(" " if rng.random() < 0.17 else c for c in draw(first, last))
    return {"latin": words(0x61, 0x7A), "base64": base64.b64encode(rng.randbytes(n)).decode()[:n], "cjk": draw(0x4E00, 0x9FA5),
            "hangul": draw(0xAC00, 0xD7A3), "cyrillic": words(0x430, 0x44F), "arabic": words(0x621, 0x649), "greek": words(0x3B1, 0x3C9)}


def test_noise_of_any_length_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(f"{name} {n}", text) for n in (1000, 3000, 10_000, 50_000) for name, text in noise(n).items()]
    real = [r.text for r in docs.filter("length(text) > 500").orderBy("doc_id").limit(400).collect()]
    rows += [(f"text {n}", " ".join(real[:n])) for n in (1, 10, 100, 400)]
    got = predict(spark.createDataFrame(rows, "name string, text string"), fit(docs.filter(~held_out()))).collect()
    assert [r.name for r in got if not r.rejected] == ["text 1", "text 10", "text 100", "text 400"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert accepted(docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    row = predict(unlabelled, fit(unlabelled)).first()
    assert row.lang_pred == "und" and row.rejected


def test_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("id") < 10, "a").otherwise("b").alias("lang"))
    rows = language_id.training_sample(docs, "doc_id", "text", "lang", 40).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in rows} == {"a": 10, "b": 30}


def test_fit_holds_little_on_the_driver(spark):
    """6 bytes a cell stay, as counts and weights; more than 14 at once is a copy of all of them."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(20)), "ab"[i % 2]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * 1500 * language_id.DIMENSIONS
