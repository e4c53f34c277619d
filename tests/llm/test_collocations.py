"""Collocations: awkward rows and small blocks against a plain count, arithmetic beyond 64 bits."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from folioflow.llm import collocations as module
from folioflow.llm.collocations import collocations, frequent_buckets

UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top, percent=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    for lang in n:
        own = {p: a for (of, p), a in f.items() if of == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in own.items():
            inside = any(100 * b >= percent * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items())
            if not inside:
                score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [1 << 22, 64])
@pytest.mark.parametrize("bits", [16, 6])
def test_rows(spark, monkeypatch, block, bits):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(bits)
    words = "The of new YORK city é 日本 a-b \x00 , . ! \n \t".split(" ")
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("  ", "fr"), ("one", "fr"), ("new york " * 3000, "en"), ("x" * 5000, "en"), (rows[0])] * 2
    docs = spark.createDataFrame([(*r, 0) for r in rows], "text string, lang string, rank long")
    for least, top in ((3, 50), (30, 5)):
        got = collocations(docs.repartition(5), least=least, top=top, filter_bits=bits)
        assert rows_of(got) == plain(rows, least, top)
    assert collocations(docs.limit(0), filter_bits=bits).count() == 0


def bits_of(bitmap):
    return sum(bin(int(b) & (2**64 - 1)).count("1") for b in bitmap)


def test_filter_holds_every_frequent_phrase(spark):
    docs = spark.createDataFrame([("a b " * 20, "en"), ("c d", "en"), ("a b", "de")], "text string, lang string").repartition(3)
    pairs = frequent_buckets(docs, 2, [], 20, 16)
    assert bits_of(pairs) == 1  # a b of en; b a is 19 times there
    assert pairs.nbytes == 2**16 // 8
    pairs = frequent_buckets(docs, 2, [], 19, 16)
    assert bits_of(pairs) == 2
    assert bits_of(frequent_buckets(docs, 3, [pairs], 19, 16)) == 2 and bits_of(frequent_buckets(docs, 3, [pairs], 20, 16)) == 0
