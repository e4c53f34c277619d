"""Vector expressions, the offline hashing embedder and exact top-k scoring."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared at this many decimals, then by id, so that float noise
# from a different summation order never decides a rank.
SCORE_DIGITS = 6
HASH_DIM = 64


def squared_norm(vec: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(vec, zero, lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(vec: Column) -> Column:
    """Unit-length vector of doubles; a zero vector stays as it is."""
    norm = F.sqrt(squared_norm(vec))
    return F.transform(vec, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


@lru_cache(maxsize=200_000)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:4], 16)


def hash_embed(texts: list[str], dim: int = HASH_DIM) -> np.ndarray:
    """Deterministic stand-in for a model: hashed token counts, one row per text.

    All texts are cut at once and each distinct word is hashed once.
    """
    column = pa.array(texts, pa.large_string())
    # The one letter whose lower case is two characters, as ``lower`` has it elsewhere.
    lowered = pc.utf8_lower(pc.replace_substring(column, "\u0130", "i\u0307"))
    words = pc.split_pattern_regex(pc.replace_substring(lowered, "§", "section "), "[^a-z0-9_]+")
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    buckets = np.array([_bucket(w) % dim if len(w) >= 2 else -1 for w in names], np.int64)
    found = buckets[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    keep = found >= 0
    return np.bincount(rows[keep] * dim + found[keep], minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = np.asarray(matrix, dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=matrix.copy(), where=norms > 0)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


class RunningTopK:
    """Best ``k`` ids per query over the batches one task sees."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n_queries
        # The k-th best score of each query, which a new hit has to reach.
        self.floor = np.zeros(n_queries)

    def add(self, ids: np.ndarray, scores: np.ndarray, only_positive: bool = False, rows: np.ndarray | None = None) -> None:
        """Merge rounded ``scores`` (queries by ids); ``rows`` names the queries if they are not all."""
        scores = np.round(scores, SCORE_DIGITS)
        rows = np.arange(len(scores)) if rows is None else rows
        able = np.flatnonzero(scores.max(axis=1, initial=0) >= self.floor[rows])
        for q, row in zip(rows[able], scores[able]):
            found, found_ids = row, ids
            if only_positive:
                matched = np.flatnonzero(row > 0)
                if not len(matched):
                    continue
                found, found_ids = row[matched], ids[matched]
            keep = best_of(found, found_ids, self.k)
            found, found_ids = found[keep], found_ids[keep]
            if self.best[q] is not None:
                found = np.concatenate([self.best[q][0], found])
                found_ids = np.concatenate([self.best[q][1], found_ids])
                keep = best_of(found, found_ids, self.k)
                found, found_ids = found[keep], found_ids[keep]
            self.best[q] = (found, found_ids)
            if len(found) == self.k:
                self.floor[q] = found[-1]


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of unit-length queries with vectors, negatives as 0."""
    return np.maximum(queries @ unit_rows(vectors).T, 0.0)
