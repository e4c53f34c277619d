"""Exact dedup against a plain dictionary, with colliding digests and awkward rows."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm.exact_dedup import deduplicated, exact_groups

ROWS = [
    (5, "a  b", "x"), (3, "a\tb", "x"), (9, "a b", "y"), (4, "a b ", None), (1, None, "n"), (2, "", "n"),
    (6, "  ", "n"), (7, "x" * 200_000, "l"), (8, "x" * 200_000, "l"), (10, "a b", "u"), (11, "z", "z"), (11, "z", "z"), (None, "only", "q"),
]


def brute(rows):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")])
def test_groups(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string").repartition(3)
    args = {} if digest is None else {"digest": digest}
    got = exact_groups(docs, **args).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS)


def test_deduplicated(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    got = deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r[0] for r in got.collect()), key=repr) == sorted([3, 4, 1, 6, 7, 10, 11, None], key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).count() == 0
    assert deduplicated(docs).count() == 0
