"""Embedding tables: content keys, cache split, batched inference, coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import content_hash
from folioflow.functions.vectors import hash_embed, l2_normalize, unit_rows

BATCH_SIZE = 50

EmbedFn = Callable[[list[str]], np.ndarray]


def with_content_hash(df: DataFrame, model: str, task: str, text: str = "text") -> DataFrame:
    return df.withColumn("content_hash", content_hash(model, task, F.col(text)))


def split_cached(
    chunks: DataFrame, cache: DataFrame, order: Column | None = None, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chunks whose key is cached, and the others; the others may be limited in input order."""
    keys = cache.select("content_hash").distinct()
    hits = chunks.join(keys, "content_hash", "left_semi")
    misses = chunks.join(keys, "content_hash", "left_anti")
    if limit is not None:
        misses = misses.orderBy(order).limit(limit)
    return hits, misses


def distinct_texts(misses: DataFrame, text: str = "text") -> DataFrame:
    """One row per content key: a repeated text is embedded once."""
    return misses.groupBy("content_hash").agg(F.first(text).alias(text))


def embed_batches(
    df: DataFrame,
    key: str,
    text: str = "text",
    embed_fn: EmbedFn = hash_embed,
    batch: int = BATCH_SIZE,
    dim: int | None = None,
    normalize: bool = True,
) -> DataFrame:
    """``(key, embedding, error)`` from batched model calls.

    A batch that raises, or returns the wrong count or dimension, fails alone:
    its rows carry the error and no vector, and the run goes on.
    """
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("embedding", T.ArrayType(T.DoubleType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors, error = [None] * len(part), None
                try:
                    made = np.asarray(embed_fn(part[text].tolist()), dtype=np.float64)
                    if made.ndim != 2 or len(made) != len(part):
                        raise ValueError(f"asked for {len(part)} vectors, got shape {made.shape}")
                    if dim is not None and made.shape[1] != dim:
                        raise ValueError(f"dimension {made.shape[1]}, expected {dim}")
                    vectors = list(unit_rows(made) if normalize else made)
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors, "error": error})

    return df.select(key, text).mapInPandas(run, schema)


def normalize_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.withColumn(vec, l2_normalize(F.col(vec)))


def check_vectors(df: DataFrame, dim: int, vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a vector of the right dimension, and the others with a reason."""
    reason = F.when(F.col(vec).isNull(), "missing").when(F.size(vec) != dim, "dimension")
    checked = df.withColumn("reason", reason)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def materialize_embeddings(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Vectors for every chunk whose key is cached; chunks without one are left out."""
    return chunks.join(cache.select("content_hash", "embedding", "model", "task_type"), "content_hash").select(
        "chunk_id", "embedding", "model", "task_type"
    )


CACHE_BUCKETS = 64


def write_cache(cache: DataFrame, name: str, path: str, buckets: int = CACHE_BUCKETS) -> DataFrame:
    """Store a cache as table ``name``, bucketed and sorted by content hash; returns it.

    A batch of chunks then goes to the buckets: ``split_cached`` and
    ``materialize_embeddings`` read the cache as it lies, however large it is.
    """
    bucketed = cache.repartition(buckets, "content_hash").write.mode("overwrite").bucketBy(buckets, "content_hash").sortBy("content_hash")
    bucketed.option("path", path).saveAsTable(name)
    return cache.sparkSession.table(name)


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Embedded, total and missing chunks; complete when nothing is missing."""
    have = embeddings.select(key).distinct().withColumn("__has", F.lit(True))
    joined = chunks.select(key).join(have, key, "left")
    embedded = F.count_if(F.col("__has"))
    return joined.agg(
        embedded.alias("embedded"),
        F.count("*").alias("total"),
        (F.count("*") - embedded).alias("missing"),
        (embedded >= F.count("*")).alias("complete"),
    )
