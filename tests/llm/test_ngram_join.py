"""The chosen-path join against all pairs by sets of word tuples."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import ngram_join, shingles
from folioflow.llm.arrow_text import flat
from folioflow.llm.components import components
from folioflow.llm.ngram_join import MOST_DIFFERENT, runs_for, shared_counts, similar_classes, without_near_copies

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """class and link count per row number, from an inverted list of shingles."""
    sets = [grams(t) for _, t in rows]
    holders, links, parent = defaultdict(list), defaultdict(set), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        shared = defaultdict(int)
        for g in own:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if n / (len(own) + len(sets[j]) - n) >= 0.8:
                links[i].add(j), links[j].add(i)
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (row_id, _) in enumerate(rows):
        ids[find(i)] += [row_id] if row_id is not None else []
    return sorted(repr((r, min(ids[find(i)], default=None), len(links[i]), len(sets[i]))) for i, (r, _) in enumerate(rows))


def corpus():
    rng = random.Random(3)
    prose = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(n)]
    rows = []
    for _ in range(12):
        base = prose(rng.choice([6, 30, 120, 400]))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(99))
            rows.append(" ".join(copy))
    passage = " ".join(prose(60))
    rows += [passage + " " + " ".join(prose(120)) for _ in range(90)]
    hot = prose(200)
    for i in range(120):
        copy = list(hot)
        copy[i] = f"edit{i}"
        rows.append(" ".join(copy))
    rows += [rows[0], rows[0], rows[3].upper().replace(" ", ", "), None, "", "!!", "one", "one", "two words", "Été élan, ça! va très bien"]
    rows += ["lorem " * 60_000, "lorem " * 70_000]
    rng.shuffle(rows)
    return [(i * 3 if i % 17 else None, t) for i, t in enumerate(rows)] + [(6, rows[2]), (6, rows[2])]


@pytest.mark.parametrize(("bucket", "block"), [(64, 512), (4, 16)])
def test_join(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int").repartition(5)
    got = similar_classes(docs).collect()
    want = brute(rows)
    empty = [r for r in rows if not grams(r[1])]
    assert sorted(repr((r.doc_id, r.class_id, r.n_links, r.n_shingles)) for r in got if r.n_shingles) == sorted(
        w for w in want if not w.endswith(" 0)")
    )
    assert sorted(repr((r.doc_id, r.class_id)) for r in got if not r.n_shingles) == sorted(repr((i, i)) for i, _ in empty)


def test_near_copies_go(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(5, base), (2, base + " more"), (9, "other text here for us"), (4, None), (7, None)], "doc_id long, text string")
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 9]
    assert without_near_copies(docs.limit(0)).count() == 0
    assert similar_classes(docs.filter("text is null")).count() == 2


def test_near_copies_go_by_row(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    alone = [(None, text("a")), (None, text("b")), (5, text("c")), (None, None), (None, None), (5, "?!")]
    rows = [*alone, (5, text("d")), (None, text("d") + " more"), (2, text("e")), (5, text("e") + " more"), (8, text("f")), (8, text("f"))]
    twins = [[(None, text("g")), (None, text("g") + " more")], [(6, text("h")), (6, text("h") + " more"), (None, text("h"))]]
    docs = spark.createDataFrame(rows + twins[0] + twins[1], "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in without_near_copies(docs).collect())
    leaders = [next(r for r in group if r in kept) for group in twins]
    assert kept == Counter([*alone, (5, text("d")), (2, text("e")), (8, text("f")), *leaders])
    assert leaders[1][0] == 6


def test_pieces(monkeypatch):
    texts = ["", "a b c d e f", "ab" * 300 + " x y", "É é z", "q r s t u v w x y z " * 20]
    whole = shingles.shingle_sets(*flat(pa.array(texts)), 5)
    monkeypatch.setattr(shingles, "PIECE", 16)
    pieces = shingles.shingle_sets(*flat(pa.array(texts)), 5)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert [len(s) for s in whole] == [len(grams(t)) for t in texts]


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 30, 30, 50)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = shared_counts(sets)
    assert all(w is None or w == got[i, j] for i, row in enumerate(want) for j, w in enumerate(row))


def test_recall_bound():
    runs = runs_for(0.999999, 0.8, 3)
    assert (1 - 0.8**3) ** runs <= 1e-6 < (1 - 0.8**3) ** (runs - 1)
    # Sketches of a pair at the threshold differ in more cells with a chance below one in a million.
    from math import comb

    p = 0.2 * 0.75
    assert sum(comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(MOST_DIFFERENT + 1, 129)) < 1e-6


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7), (None, 3), (200, 201), (200, 202), (199, 202)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 103: 100, 200: 199, 201: 199, 202: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
