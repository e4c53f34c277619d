"""Contamination against a word-by-word search, on both join paths, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from folioflow.llm import decontaminate
from folioflow.llm.decontaminate import contamination, uncontaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item_id, item in items:
        item = words(item)
        n = min(len(item), 13)
        for at in range(len(item) - n + 1) if item else ():
            for start in range(len(doc) - n + 1):
                if doc[start : start + n] == item[at : at + n]:
                    hit.update(range(start, start + n))
                    found.add("" if item_id is None else str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(doc), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(doc)


def tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "été", "the"] * 4
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([13, 14, 20, 40]))) for i in range(8)]
    items += [(20, "The, w1"), (21, None), (22, ""), (23, "!!"), (24, "ÉTÉ"), (None, "w2 w3 w4"), (25, items[0][1]), (25, items[1][1]), (26, "nowhere seen")]
    docs = [(i, prose(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100 + i, prose(10) + " " + items[i % 8][1].upper().replace("ÉTÉ", "Été") + ", " + prose(5)) for i in range(20)]
    docs += [(200 + i, prose(i) + " " + " ".join(items[i % 8][1].split()[:12]) + " x " + prose(3)) for i in range(8)]
    docs += [(300, None), (301, ""), (302, "w0 " * 30_000), (None, items[2][1]), (None, "w2 w3 w4"), (303, items[3][1]), (303, items[3][1]), (303, "other w1")]
    return docs, items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_CHARS, -1])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", limit)
    docs, items = tables()
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, term string")
    rows = contamination(frame, bench).collect()
    got = sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows)
    assert got == sorted(repr((i, *brute(t, items))) for i, t in docs)
    # A phrase is near as well.
    assert all(r.n_near >= r.n_items for r in rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x d e f g h i j k l m n"), (2, "a b c " + "x " * 40 + "d e f g h i j k l m n"), (3, "b c d e f g h i j k l m")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    rows = {r.doc_id: r for r in contamination(docs, bench, width=20).collect()}
    assert rows[1].n_hit == rows[2].n_hit == 0
    # The rarest terms are a and n: one word too many in between is near, forty are not, neither is none at all.
    assert [rows[i].n_near for i in (1, 2, 3)] == [1, 0, 0]


def test_string_ids(spark):
    text = "one two three four five"
    docs = spark.createDataFrame([(None, text), ("null", text), ("x", text), ("x", text), (None, "six"), ("null", "")], "doc_id string, text string")
    bench = spark.createDataFrame([("q", "two three four")], "item_id string, text string")
    rows = contamination(docs, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in rows) == sorted([("None", 5, 3), ("null", 5, 3), ("x", 5, 3), ("x", 5, 3), ("None", 1, 0), ("null", 0, 0)])
    kept = uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("None", "six"), ("null", "")]


def test_no_row_holds_a_whole_text(spark, monkeypatch):
    """Beyond the broadcast the shuffled postings are bounded by the window, not by the text."""
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", -1)
    item = " ".join(f"w{i}" for i in range(20))
    text = "w0 w1 w2 " * 10_000 + item
    docs = spark.createDataFrame([(1, text), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    seen = []
    index = decontaminate.positional_index
    monkeypatch.setattr(decontaminate, "positional_index", lambda *a: seen.append(index(*a)) or seen[-1])
    rows = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[2].n_hit) == (30_020, 20, 20)
    assert seen[0].selectExpr("max(size(around))").first()[0] <= 2 * (12 + 4) + 1


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contamination(docs, bench).collect()] == [False, False]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
