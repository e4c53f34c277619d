"""Batch retrieval: BM25, exact cosine search, fusion, scope gate, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.ranking import median, top_k
from folioflow.functions.text import normalize_query
from folioflow.functions.vectors import SCORE_DIGITS, RunningTopK, cosines, unit_rows
from folioflow.operators.bm25 import SegmentIndex, bm25_topk
from folioflow.operators.nearest import nearest_above
from folioflow.sources.files import staged
from folioflow.sources.log_store import upsert_latest

# Fixed values of the retrieval contract.
TOP_K = 20
FINAL_K = 5
RRF_K = 60
SCOPE_THRESHOLD = 0.60
SEMANTIC_THRESHOLD = 0.92

# Query rows that are scored together, and vectors in a packed block.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 4096
# No matrix of queries is larger than this.
BROADCAST_BYTES = 64 * 1024 * 1024


def rejected_vectors(vectors: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """``(side, id, reason)`` of the rows that ``vector_topk`` cannot score.

    Reasons: ``missing`` (a null vector, as a failed embedding leaves it),
    ``dimension`` (not ``dim`` numbers) and ``not_finite`` (a null, NaN or
    infinite number).
    """
    found = None
    for side, df, key, vec in (("chunk", vectors, "chunk_id", "embedding"), ("query", queries, "query_id", "query_vec")):
        part = df.select(F.lit(side).alias("side"), F.col(key).alias("id"), _vector_problem(F.col(vec), dim).alias("reason"))
        found = part if found is None else found.unionByName(part)
    return found.filter("reason is not null")


def _vector_problem(vec: Column, dim: int) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vec.isNull(), "missing").when(F.size(vec) != dim, "dimension").when(bad, "not_finite")


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int = TOP_K,
    where: dict[str, object] | None = None,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact cosine search ``(query_id, chunk_id, score, rank)``; negative cosines count as 0.

    ``vectors(chunk_id, embedding, ...)``, ``queries(query_id, query_vec)``,
    all of ``dim`` numbers; what is not is listed by ``rejected_vectors``.
    Queries are cut into blocks of at most ``block`` rows and
    ``BROADCAST_BYTES``, vectors into packed blocks dealt to parts, and every
    part meets every query block: a stated query set against all rows.  A task
    walks its part one query block at a time and keeps the best ``k`` per
    query over all vectors it sees, so ``k`` rows per query and task are
    shuffled, never one per pair.
    """
    for name, value in (where or {}).items():
        vectors = vectors.filter(F.col(name) == F.lit(value))
    vectors = vectors.filter(_vector_problem(F.col("embedding"), dim).isNull()).select("chunk_id", "embedding")
    queries = queries.filter(_vector_problem(F.col("query_vec"), dim).isNull()).select("query_id", "query_vec")
    schema = T.StructType(
        [queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())]
    )
    rows = max(1, min(block, BROADCAST_BYTES // (8 * dim)))
    partial = scan_with_blocks(vectors, queries, k, rows, schema)
    return top_k(partial, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1)


def _hits(query_ids: np.ndarray, running: RunningTopK, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for query_id, best in zip(query_ids, running.best):
        if best is not None:
            scores, ids = best
            columns = [pa.array([query_id] * len(ids), schema.field(0).type), pa.array(ids, schema.field(1).type)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], schema=schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])


def _packed(df: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Pack rows into blocks: ids as an array, vectors as one float64 buffer."""
    id_field = df.schema.fields[0]
    schema = T.StructType(
        [
            T.StructField(f"{prefix}_ids", T.ArrayType(id_field.dataType)),
            T.StructField(f"{prefix}_data", T.BinaryType()),
        ]
    )
    id_type = _arrow_schema(T.StructType([id_field])).field(0).type
    arrow = pa.schema([(f"{prefix}_ids", pa.list_(id_type)), (f"{prefix}_data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                data = unit_rows(_matrix(piece.column(1))).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.column(0).to_pylist()], arrow.field(0).type), pa.array([data], pa.binary())],
                    schema=arrow,
                )

    return df.mapInArrow(pack, schema)


def scan_with_blocks(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    block: int,
    schema: T.StructType,
    meet: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Query blocks copied to every part of the packed vectors; ``meet`` tells which pairs of two blocks count, if not all do."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(vectors, VECTOR_BLOCK, "v").withColumn("part", F.pmod(F.xxhash64("v_ids"), F.lit(parts)))
    blocks = _packed(queries, block, "q").withColumn("q_no", F.xxhash64("q_ids"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, query_ids, matrix, running = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                q_no, ids = batch.column(0)[i].as_py(), np.array(batch.column(3)[i].as_py())
                if q_no != current:
                    if running is not None:
                        yield from _hits(query_ids, running, arrow)
                    current, query_ids = q_no, np.array(batch.column(1)[i].as_py())
                    matrix = np.frombuffer(batch.column(2)[i].as_buffer()).reshape(len(query_ids), -1)
                    running = RunningTopK(len(query_ids), k)
                vecs = np.frombuffer(batch.column(4)[i].as_buffer()).reshape(len(ids), -1)
                scores = cosines(matrix, vecs)
                running.add(ids, scores if meet is None else np.where(meet(matrix, vecs), scores, -1.0))
        if running is not None:
            yield from _hits(query_ids, running, arrow)

    pairs = packed.join(blocks, "part").select("q_no", "q_ids", "q_data", "v_ids", "v_data")
    # What does not count has a score below all others.
    return pairs.sortWithinPartitions("q_no").mapInArrow(scan, schema).filter("score >= 0")


def rrf(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, chunk_id, rank[, payload])`` lists.

    Each list adds ``1 / (k + rank)`` with ranks from 0; a payload comes from
    the first list that has the chunk.  Ordered by score, then chunk.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    rows = None
    for number, hits in enumerate(ranked):
        payload = F.col("payload") if "payload" in hits.columns else F.lit(None).cast("string")
        part = hits.select("query_id", "chunk_id", "rank", payload.alias("payload"), F.lit(number).alias("list_no"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank") - 1)), 9).alias("score"),
        F.min_by("payload", "list_no").alias("payload"),
    )
    return fused


def scope_gate(
    queries: DataFrame, vector_hits: DataFrame, bm25_hits: DataFrame, threshold: float = SCOPE_THRESHOLD
) -> DataFrame:
    """``(query_id, top_similarity, accepted)``.

    Rejected without any hit, or when there are vector hits and the best is
    below the threshold; text hits alone pass.
    """
    best = vector_hits.groupBy("query_id").agg(F.max("score").alias("__best"))
    worded = bm25_hits.select("query_id").distinct().withColumn("__text", F.lit(True))
    joined = queries.select("query_id").join(best, "query_id", "left").join(worded, "query_id", "left")
    has_vec, has_text = F.col("__best").isNotNull(), F.col("__text").isNotNull()
    rejected = (~has_vec & ~has_text) | (has_vec & (F.col("__best") < threshold))
    return joined.select(
        "query_id", F.coalesce("__best", F.lit(0.0)).alias("top_similarity"), (~rejected).alias("accepted")
    )


def retrieve(
    queries: DataFrame,
    text: DataFrame | SegmentIndex,
    vectors: DataFrame,
    dim: int,
    top: int = TOP_K,
    final: int = FINAL_K,
    threshold: float = SCOPE_THRESHOLD,
) -> DataFrame:
    """Hybrid retrieval for a table ``queries(query_id, query, query_vec)``.

    ``text`` is the chunk table or a stored index of it.  One row per query and final rank; a rejected query has one row without a
    chunk.
    """
    # At most `top` rows per query, read by the gate and by the fusion.
    by_vector = staged(vector_topk(vectors, queries, dim, top), "vector-hits")
    by_text = staged(bm25_topk(text, queries, top), "text-hits")
    gate = scope_gate(queries, by_vector, by_text, threshold)
    fused = top_k(rrf(by_vector, by_text), ["query_id"], [F.desc("score"), F.asc("chunk_id")], final)
    accepted = F.col("accepted")
    joined = gate.join(fused.drop("payload"), "query_id", "left")
    return joined.filter(accepted | (F.coalesce("rank", F.lit(1)) == 1)).select(
        "query_id",
        "accepted",
        "top_similarity",
        F.when(accepted, F.col("rank")).alias("rank"),
        F.when(accepted, F.col("chunk_id")).alias("chunk_id"),
        F.when(accepted, F.col("score")).alias("score"),
    )


def calibrate_threshold(scores: DataFrame, margin: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Where to put the scope threshold, from ``scores(query_id, in_scope, score)``.

    First result: one row with the spread of both classes, gap and midpoint if
    they are apart, else the overlap and what the two possible thresholds
    lose or let through.  Second result: the queries on the wrong side.
    """
    inside, outside = F.col("in_scope"), ~F.col("in_scope")
    bounds = scores.agg(
        F.count_if(inside).alias("n_in"),
        F.min(F.when(inside, F.col("score"))).alias("min_in"),
        F.max(F.when(inside, F.col("score"))).alias("max_in"),
        F.count_if(outside).alias("n_out"),
        F.min(F.when(outside, F.col("score"))).alias("min_out"),
        F.max(F.when(outside, F.col("score"))).alias("max_out"),
    )
    medians = median(scores, "score", ["in_scope"])
    lower, upper = bounds.select("min_in").scalar(), bounds.select("max_out").scalar()
    crossing = scores.agg(
        F.count_if(inside & (F.col("score") < upper + margin)).alias("lost"),
        F.count_if(outside & (F.col("score") > lower - margin)).alias("leaked"),
    )
    apart = F.col("min_in") > F.col("max_out")
    report = bounds.select(
        "*",
        medians.filter("in_scope").select("median").scalar().alias("median_in"),
        medians.filter("not in_scope").select("median").scalar().alias("median_out"),
        apart.alias("separable"),
        F.when(apart, F.col("min_in") - F.col("max_out")).alias("gap"),
        F.when(apart, (F.col("min_in") + F.col("max_out")) / 2).alias("midpoint"),
        F.when(~apart, F.col("max_out") - F.col("min_in")).alias("overlap"),
        F.when(~apart, crossing.select("lost").scalar()).alias("lost_above_max_out"),
        F.when(~apart, crossing.select("leaked").scalar()).alias("leaked_below_min_in"),
    )
    wrong_side = scores.filter((outside & (F.col("score") > lower)) | (inside & (F.col("score") < upper)))
    return report, wrong_side


def with_cache_key(queries: DataFrame, text: str = "query") -> DataFrame:
    return queries.withColumn("cache_key", F.sha2(normalize_query(F.col(text)), 256))


def exact_cache_lookup(queries: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Queries with the cached answer of their normalized form.

    An entry of another corpus version, or without an answer, is a miss.
    """
    usable = cache.filter((F.col("corpus_version") == version) & F.col("answer_text").isNotNull())
    found = with_cache_key(queries).join(usable.select("cache_key", "answer_text"), "cache_key", "left")
    return found.withColumn("cache_hit", F.col("answer_text").isNotNull())


def semantic_cache_lookup(
    queries: DataFrame, cache: DataFrame, version: str, dim: int, threshold: float = SEMANTIC_THRESHOLD
) -> DataFrame:
    """Nearest cached query of the same version, if its cosine is above the threshold.

    Pairs that the triangle inequality excludes are never compared; vectors that
    cannot be scored, as ``vector_topk`` has them, find nothing.
    """
    entries = cache.filter(F.col("corpus_version") == version).select(
        F.col("cached_id").alias("chunk_id"), F.col("cached_vec").alias("embedding")
    )
    entries = entries.filter(_vector_problem(F.col("embedding"), dim).isNull())
    asked = queries.filter(_vector_problem(F.col("query_vec"), dim).isNull())
    return nearest_above(entries, asked, threshold).withColumnRenamed("chunk_id", "cached_id")


def store_answers(cache: DataFrame, answers: DataFrame, version: str) -> DataFrame:
    """Cache after the given answers: last write per key wins, stamped with the version."""
    fresh = with_cache_key(answers).select(
        "cache_key", "answer_text", F.lit(version).alias("corpus_version"), "written_at"
    )
    return upsert_latest(cache, fresh, ["cache_key"], ["written_at"])
