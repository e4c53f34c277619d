"""BPE: ids and texts against the tokenizers library, a plain merge loop, awkward rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm.bpe import WordBpe, decoded, encoded, merged, op13_bpe, spec_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return WordBpe(spec_of(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
    assert own.decode(packed) == library.decode(ids, skip_special_tokens=False), repr(text)


def plain(symbols, pairs):
    while True:
        found = [(pairs[k][0], i) for i in range(len(symbols) - 1) if (k := symbols[i] << 32 | symbols[i + 1]) in pairs]
        if not found:
            return symbols
        _, i = min(found)
        symbols = [*symbols[:i], pairs[symbols[i] << 32 | symbols[i + 1]][1], *symbols[i + 2 :]]


def test_merge_order():
    rng = random.Random(3)
    for _ in range(400):
        pairs, ids = {}, list(range(4))
        for rank in range(rng.randrange(30)):
            key = rng.choice(ids) << 32 | rng.choice(ids)
            if key not in pairs:
                pairs[key] = (rank, len(ids))
                ids.append(len(ids))
        word = [rng.randrange(4) for _ in range(rng.randrange(40))]
        assert merged(list(word), pairs) == plain(word, pairs)


CASES = [
    "", " ", "\n\t ", "Hello, WORLD! it's we'll 'S 'T don't I'M", "a<|endoftext|>b <|startoftext|><|endoftext|> <|EndOfText|> <|endof",
    "ΑΣ Σ ΣΑΣ. İstanbul ẞ ŉ", "é 각 Å ﬁ", "x\x1cy\x1d \x1e\x1f \x85 \xa0  　﻿​", "½ ² ٣ 12345 1,000.5e-7",
    "日本語の文章 한국어 текст العربية हिन्दी 👍🏽👩‍👩‍👧", "\x00\x01\x7f", "ab" * 3000, "a" * 5000, "-" * 3000 + "'s" * 500, "ܱ꣪\U0001e2ee\U00010f4d ạ̇", "Ᲊ Ƛ \U00010d50",
]


@pytest.mark.parametrize("text", CASES)
def test_against_the_library(own, library, text):
    same(own, library, text)


def test_every_character(own, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rng = random.Random(5)
    rng.shuffle(points)
    for at in range(0, len(points), 997):
        same(own, library, "".join(chr(c) + ("x", " ", "1", "")[c % 4] for c in points[at : at + 997]))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(*FIXED, text)


FIXED = (WordBpe(spec_of(PATH)), Tokenizer.from_file(PATH))


def test_rows(spark):
    rows = [(1, None, 5), (2, "", None), (3, "Some text, twice", 1), (3, "Some text, twice", 1), (None, "x " * 200_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = decoded(encoded(docs, PATH), PATH)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]
    found = got.collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 200_000), (1, 0), (2, 0), (3, 4), (3, 4)]
    assert {r.decoded for r in found if r.doc_id == 3} == {"some</w> text</w> ,</w> twice</w>"}
    assert decoded(encoded(docs.limit(0), PATH), PATH).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {}
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in op13_bpe(spark, sf).collect()} == want
