"""Nearest neighbours without comparing all pairs: metric pruning and hashed signatures.

``nearest_above`` is exact.  Angles between vectors obey the triangle inequality,
so a few pivots tell most pairs apart: an entry lies in the cell of its nearest
pivot, in a ring of angles around it, and a query within ``reach`` of the entry
must have that ring within ``reach`` of its own angle to the pivot.  The same holds
for every other pivot: the entries of a ring of a cell lie in a box of angles, and a
query that is more than ``reach`` outside of it in any of them finds nothing there.
Only cells and rings that a query reaches are joined to it.

``lsh_topk`` is approximate: signs of random projections are cut into bands, one
bucket table for each band, and what shares a bucket with a query in any table is
compared exactly.  ``recall`` measures it against an exact result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.ranking import top_k
from folioflow.functions.vectors import SCORE_DIGITS, unit_rows
from folioflow.sources.files import staged

# A query is copied to each ring that it reaches, so there are few: the bound on the copies.
PIVOTS = 24
# Entries that pivots are chosen from; a bounded sample by hash.
SAMPLE = 1024
# Rows of a block that is compared at once, tasks a ring is dealt to, and parts its queries are cut into.
BLOCK = 1024
SALTS = 16
SPLITS = 4
# More than the rounding error of an angle.
MARGIN = 1e-6
TABLES, BITS, SEED = 96, 6, 1


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def choose_pivots(entries: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to ``n`` entries far from each other, of the ``sample`` with the smallest hashes."""
    rows = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    vectors = unit_rows(np.array([r.embedding for r in rows]))
    chosen, best = [0], vectors @ vectors[0]
    while len(chosen) < min(n, len(vectors)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-9:
            break
        chosen.append(far)
        best = np.maximum(best, vectors @ vectors[far])
    return vectors[chosen]


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def entry_places(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell and ring of each entry."""
    angle = angles(vectors, pivots)
    cell = angle.argmin(axis=1)
    return cell, np.floor(angle[np.arange(len(cell)), cell] / (2 * reach)).astype(np.int64)


def entry_boxes(entries: DataFrame, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, ...]:
    """``(cell, ring, least, most)`` of the occupied rings: bounds of their entries' angles to each pivot.

    Their number depends on the pivots and the ring width, not on the entries.
    """
    names = ["cell", "ring", "pivot", "least", "most"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit_rows(matrix(batch.column(0)))
            angle = angles(vectors, pivots)
            cell, ring = entry_places(vectors, pivots, reach)
            for key in set(zip(cell.tolist(), ring.tolist(), strict=True)):
                own = angle[(cell == key[0]) & (ring == key[1])]
                least, most = found.get(key, (own[0], own[0]))
                found[key] = [np.minimum(least, own.min(axis=0)), np.maximum(most, own.max(axis=0))]
        for (cell, ring), (least, most) in found.items():
            n = len(pivots)
            columns = [np.full(n, cell), np.full(n, ring), np.arange(n), least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = entries.select("embedding").mapInArrow(bound, "cell int, ring int, pivot int, least double, most double")
    merged = rows.groupBy("cell", "ring", "pivot").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    table = sorted(tuple(r) for r in merged.collect())
    columns = [np.array(c).reshape(-1, len(pivots)) for c in zip(*table, strict=True)] if table else [np.zeros((0, len(pivots)))] * 5
    return columns[0][:, 0], columns[1][:, 0], columns[3], columns[4]


def query_places(vectors: np.ndarray, pivots: np.ndarray, reach: float, boxes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, cell, ring) of everything within reach of each query."""
    cell, ring, least, most = boxes
    angle = angles(vectors, pivots)
    able = np.ones((len(vectors), len(cell)), bool)
    for pivot in range(len(pivots)):
        own = angle[:, pivot, None]
        able &= (own >= least[:, pivot] - reach - MARGIN) & (own <= most[:, pivot] + reach + MARGIN)
    query, box = np.nonzero(able)
    return query, cell[box], ring[box]


def _blocks(df: DataFrame, prefix: str, pivots: np.ndarray, reach: float, boxes: tuple[np.ndarray, ...] | None = None) -> DataFrame:
    """Rows of ``(cell, ring, <prefix>_ids, <prefix>_data)``: up to ``BLOCK`` unit vectors of one ring, queries in all ``boxes`` they reach."""
    id_field = T.StructField("id", df.schema.fields[0].dataType)
    placed = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType()), id_field, T.StructField("vector", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit_rows(matrix(batch.column(1)))
            if boxes is None:
                row = np.arange(len(vectors))
                cell, ring = entry_places(vectors, pivots, reach)
            else:
                row, cell, ring = query_places(vectors, pivots, reach, boxes)
                order = np.lexsort((ring, cell))
                row, cell, ring = row[order], cell[order], ring[order]
            for at in range(0, len(row), BLOCK):
                part = row[at : at + BLOCK]
                columns = [pa.array(cell[at : at + BLOCK].astype(np.int32)), pa.array(ring[at : at + BLOCK].astype(np.int32)), batch.column(0).take(pa.array(part))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([vectors[i].tobytes() for i in part], pa.binary())], names=placed.names)

    dealt = df.mapInArrow(place, placed)
    # Queries come in runs of a ring that fill blocks as they are; entries are collected first.
    if boxes is None:
        salted = dealt.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        dealt = salted.repartition("cell", "ring", "salt").sortWithinPartitions("cell", "ring")
    packed = T.StructType(
        [*placed.fields[:2], T.StructField(f"{prefix}_ids", T.ArrayType(id_field.dataType)), T.StructField(f"{prefix}_data", T.BinaryType())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ring = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (ring[1:] != ring[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for at in range(start, end, BLOCK):
                    part = batch.slice(at, min(BLOCK, end - at))
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(2))
                    data = pa.array([b"".join(part.column(3).to_pylist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), part.column(1).slice(0, 1), ids, data], names=packed.names)

    return dealt.select("cell", "ring", "id", "vector").mapInArrow(pack, packed)


def reached_blocks(entries: DataFrame, queries: DataFrame, threshold: float) -> DataFrame | None:
    """Pairs of a query block and an entry block that can hold a pair above ``threshold``; None without entries."""
    reach = acos(threshold - 10.0**-SCORE_DIGITS) + MARGIN
    pivots = choose_pivots(entries)
    if not len(pivots):
        return None
    boxes = entry_boxes(entries, pivots, reach)
    # A ring's queries are dealt to several tasks, each of which gets the ring's entries.
    left = _blocks(entries, "e", pivots, reach).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    right = _blocks(queries, "q", pivots, reach, boxes).withColumn("split", F.pmod(F.xxhash64("q_ids"), F.lit(SPLITS)).cast("int"))
    return left.join(right, ["cell", "ring", "split"])


def nearest_above(entries: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """``(query_id, chunk_id, score)``: the nearest entry of each query with a cosine above ``threshold``.

    ``entries(chunk_id, embedding)`` and ``queries(query_id, query_vec)`` hold
    finite vectors of one length.  Ties at six decimals go to the smaller id;
    of equal entries only the smallest id is compared, so copies cost nothing.
    ``threshold`` lies between 0 and 1.
    """
    if not 0 < threshold < 1:
        raise ValueError(f"threshold must lie between 0 and 1, got {threshold}")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", entries.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    distinct = entries.groupBy("embedding").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id", "embedding")
    pairs = reached_blocks(staged(distinct, "cache-entries"), queries.select("query_id", "query_vec"), threshold)
    if pairs is None:
        return queries.sparkSession.createDataFrame([], schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, e_ids = batch.column(0)[i].values, batch.column(2)[i].values
                left = np.frombuffer(batch.column(1)[i].as_buffer()).reshape(len(q_ids), -1)
                right = np.frombuffer(batch.column(3)[i].as_buffer()).reshape(len(e_ids), -1)
                score = np.round(left @ right.T, SCORE_DIGITS)
                query, entry = np.nonzero((score > threshold) & (score == score.max(axis=1, keepdims=True)))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(query)), e_ids.take(pa.array(entry)), pa.array(score[query, entry])], names=schema.names)

    hits = pairs.select("q_ids", "q_data", "e_ids", "e_data").mapInArrow(compare, schema)
    # The highest score, of these the smallest id: both in one aggregate with a map-side combine.
    best = hits.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("score"), "chunk_id")).alias("b"))
    return best.select("query_id", "b.chunk_id", (-F.col("b.score")).alias("score"))


def bucket_numbers(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The bucket of each vector in each table: signs of ``bits`` random projections."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], tables * bits))
    marks = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (marks * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def signatures(df: DataFrame, key: str, vec: str, tables: int, bits: int, seed: int) -> DataFrame:
    """``(table, bucket, key)``: ``tables`` rows for each vector, without it."""
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField(key, key_type)])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(1))
            bucket = bucket_numbers(vectors, tables, bits, seed)
            rows = np.repeat(np.arange(len(vectors)), tables)
            table = np.tile(np.arange(tables, dtype=np.int32), len(vectors))
            yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(bucket.reshape(-1)), batch.column(0).take(pa.array(rows))], names=schema.names)

    return df.select(key, vec).mapInArrow(sign, schema)


def lsh_topk(
    vectors: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """About the best ``k`` chunks per query ``(query_id, chunk_id, score, rank)``.

    Blocks of queries meet blocks of vectors, whose buckets are compared there, so
    no pair ever becomes a row; pairs that share one are scored with the exact
    cosine, negative ones as 0, and a task sends ``k`` rows per query.  With an angle of a between two vectors they
    share a bucket in one of the tables with probability ``1 - (1 - (1 - a / pi)
    ** bits) ** tables``.
    """
    from folioflow.operators.retrieve import scan_with_blocks

    schema = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())])

    def meet(asked: np.ndarray, entries: np.ndarray) -> np.ndarray:
        left, right = (bucket_numbers(side, tables, bits, seed) for side in (asked, entries))
        found = np.zeros((len(left), len(right)), bool)
        for table in range(tables):
            found |= left[:, table, None] == right[None, :, table]
        return found

    partial = scan_with_blocks(vectors.select("chunk_id", "embedding"), queries.select("query_id", "query_vec"), k, BLOCK, schema, meet)
    return top_k(partial, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(expected, hit, recall)``: how many of the exact hits were found."""
    keys = ["query_id", "chunk_id"]
    joined = exact.select(*keys).join(found.select(*keys).withColumn("__found", F.lit(1)), keys, "left")
    counted = joined.agg(F.count("*").alias("expected"), F.count("__found").alias("hit"))
    return counted.withColumn("recall", F.try_divide("hit", "expected"))
