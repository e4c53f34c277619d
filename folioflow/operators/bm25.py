"""BM25 over segments of chunks, with upper bounds that skip blocks.

A segment is one row: up to ``SEGMENT`` chunks with their lengths, the distinct
terms and the postings sorted by term and chunk.  It is cut into blocks of
``BLOCK`` chunks.  For every (term, block) the segment also holds the largest
term frequency and the least chunk length, which bound the term's impact in that
block for any BM25 parameters and any mean length, so they stay true when the
corpus grows.

Queries are packed into blocks too, which are sent to where the segments lie, a
bounded number of them at a time.  A task walks its segments once and keeps the
best ``k`` chunks per query.  The weighted sum of the bounds is the most that any
chunk of a block can score; where it cannot reach the ``k``-th best score found so
far, the block's postings are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from folioflow.functions.ranking import top_k
from folioflow.functions.text import search_text, token_lists, tokens
from folioflow.functions.vectors import SCORE_DIGITS, RunningTopK
from folioflow.sources.files import staged

BM25_K1 = 1.5
BM25_B = 0.75
SEGMENT = 1024
BLOCK = 64
# Tokens a segment is cut at, so chunks of any length make rows of a few MB.
SEGMENT_TOKENS = 1 << 18
QUERIES = 256
# Query blocks that meet the segments at once; more take further passes over them.
ROUND = 64
# Rows of a batch of postings.
POSTINGS = 1 << 16
# Rows of a row group of stored segments: readers decode a whole group at once, so it
# holds few.  (The limit by size is only looked at after 100 rows.)
SEGMENT_FILES = {"parquet.block.row.count.limit": "4"}
# Float noise of a sum; scores are rounded to SCORE_DIGITS decimals.
SLACK = 2 * 10.0**-SCORE_DIGITS

INTS = T.ArrayType(T.IntegerType())
# term_* run over the segment's terms, post_* over its postings, bound_* over (term, block) pairs.
LISTS = ("dl", "df", "post_chunk", "post_tf", "bound_term", "bound_block", "bound_tf", "bound_dl")


@dataclass(frozen=True)
class SegmentIndex:
    """``segments``, ``terms(term, df)`` and the one-row ``stats(n_docs, avg_len)``."""

    segments: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def docs(self) -> DataFrame:
        """``(chunk_id, dl)`` of all chunks, from the segments."""
        return self.segments.select(F.inline(F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("dl").alias("dl"))))

    @property
    def postings(self) -> DataFrame:
        """``(term, chunk_id, tf, dl)`` as ``build_postings`` has them."""
        fields = {"term": T.StringType(), "chunk_id": self.segments.schema["chunk_ids"].dataType.elementType, "tf": T.IntegerType(), "dl": T.IntegerType()}
        schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    chunk_ids, dl, terms, df, at, tf = (column[i].values for column in batch.columns)
                    term = np.repeat(np.arange(len(terms), dtype=np.int32), df.to_numpy())
                    for first in range(0, len(at), POSTINGS):
                        part = slice(first, first + POSTINGS)
                        columns = [terms.take(pa.array(term[part])), chunk_ids.take(at[part]), tf[part], dl.take(at[part])]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return self.segments.select("chunk_ids", "dl", "terms", "df", "post_chunk", "post_tf").mapInArrow(spell, schema)


def segment_columns(token_lists: pa.ListArray, block: int = BLOCK) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """Distinct terms and the integer lists of one segment."""
    dl = pc.fill_null(pc.list_value_length(token_lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = token_lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, n_blocks = max(1, len(dl)), max(1, -(-len(dl) // block))
    pair, tf = np.unique(code * n + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, chunk = np.divmod(pair, n)
    # In order already, as the pairs are.
    part = term * n_blocks + chunk // block
    start = np.flatnonzero(np.diff(part, prepend=-1))
    part = part[start]
    most = np.maximum.reduceat(tf, start) if len(start) else tf
    least = np.minimum.reduceat(dl[chunk], start) if len(start) else tf
    lists = (dl, np.bincount(term, minlength=len(coded.dictionary)), chunk, tf, part // n_blocks, part % n_blocks, most, least)
    return coded.dictionary, dict(zip(LISTS, lists, strict=True))


def build_segments(chunks: DataFrame, rows: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Segments of ``chunks(chunk_id, text)`` where they lie: nothing is shuffled.

    Texts are cut into tokens where the batches are, so they pass whole.
    """
    words = chunks.select("chunk_id", search_text(F.col("text")).alias("text"))
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("chunk_ids", T.ArrayType(chunks.schema["chunk_id"].dataType)),
            T.StructField("terms", T.ArrayType(T.StringType())),
            *[T.StructField(name, INTS) for name in LISTS],
        ]
    )

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids = lists = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                found = token_lists(batch.column(1))
                ids = batch.column(0) if ids is None else pa.concat_arrays([ids, batch.column(0)])
                lists = found if lists is None else pa.concat_arrays([lists, found])
            if ids is None:
                return
            upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ids):
                full = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SEGMENT_TOKENS))
                end = min(len(ids), at + rows, max(at + 1, full))
                if batch is not None and end == len(ids):
                    break  # the next batch may go on with it
                terms, values = segment_columns(lists[at:end], block)
                columns = [pa.array([number]), one(ids[at:end]), one(terms)]
                columns += [one(pa.array(v.astype(np.int32))) for v in values.values()]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                number, at = number + 1, end
            ids, lists = ids[at:], lists[at:]

    return words.mapInArrow(build, schema)


def term_counts(segments: DataFrame) -> DataFrame:
    """``(term, df)``: a row for each segment and term is summed, not one for each word."""
    named = segments.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("df").alias("n"))))
    return named.groupBy("term").agg(F.sum("n").alias("df"))


def length_stats(segments: DataFrame) -> DataFrame:
    total = F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = segments.agg(F.coalesce(F.sum(F.size("dl")), F.lit(0)).alias("n_docs"), F.sum(total).alias("total"))
    return sums.select("n_docs", F.try_divide("total", "n_docs").alias("avg_len"))


def segment_index(chunks: DataFrame) -> SegmentIndex:
    """The index of a chunk table for the queries of one run: segments written once, counts read from them."""
    segments = staged(build_segments(chunks), "segments", **SEGMENT_FILES)
    return SegmentIndex(segments, term_counts(segments), length_stats(segments))


def write_segments(chunks: DataFrame, path: str) -> None:
    """Store the index of a chunk table below ``path``."""
    build_segments(chunks).write.mode("overwrite").options(**SEGMENT_FILES).parquet(f"{path}/segments")
    written = chunks.sparkSession.read.parquet(f"{path}/segments")
    # Sorted by term, so query terms meet few row groups.
    term_counts(written).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    length_stats(written).write.mode("overwrite").parquet(f"{path}/stats")


def read_segments(spark: SparkSession, path: str) -> SegmentIndex:
    return SegmentIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("segments", "terms", "stats")))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``: repeated words count repeatedly."""
    words = queries.select("query_id", F.explode_outer(tokens(F.col("query"))).alias("term")).filter("term is not null")
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def query_blocks(queries: DataFrame, index: SegmentIndex, rows: int = QUERIES) -> DataFrame:
    """Rows of up to ``rows`` queries: ids, their distinct terms, and (query, term, weight) triples as lists."""
    n_docs = index.stats.select("n_docs").scalar()
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = query_terms(queries).join(index.terms, "term")
    entry = F.struct("term", (F.col("qtf") * idf).alias("weight"))
    listed = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    flat = listed.select("query_id", F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights"))
    schema = T.StructType(
        [
            T.StructField("query_ids", T.ArrayType(queries.schema["query_id"].dataType)),
            T.StructField("query_terms", T.ArrayType(T.StringType())),
            T.StructField("users", INTS),
            T.StructField("places", INTS),
            T.StructField("weights", T.ArrayType(T.DoubleType())),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sizes = pc.list_value_length(part.column(1)).to_numpy()
                coded = part.column(1).flatten().dictionary_encode()
                users = np.repeat(np.arange(part.num_rows, dtype=np.int32), sizes)
                values = (part.column(0), coded.dictionary, pa.array(users), coded.indices, part.column(2).flatten())
                columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # Dealt to no more tasks than it takes, so that blocks are full.
    return flat.repartition(max(1, -(-queries.count() // rows))).mapInArrow(pack, schema)


class BlockScorer:
    """The best ``k`` chunks of each query of one block, over the segments shown to it."""

    def __init__(self, terms: pa.Array, users: np.ndarray, places: np.ndarray, weights: np.ndarray, n_queries: int, k: int, avg_len: float, k1: float = BM25_K1, b: float = BM25_B):
        self.terms, self.users, self.places, self.weights = terms, users, places, weights
        self.n_queries, self.avg_len, self.k1, self.b = n_queries, avg_len or 1.0, k1, b
        self.running = RunningTopK(n_queries, k)
        self.blocks = self.skipped = 0

    def impact(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + self.k1 * (1 - self.b + self.b * dl / self.avg_len))

    def add(self, chunk_ids: np.ndarray, terms: pa.Array, lists: dict[str, np.ndarray], block: int = BLOCK) -> None:
        n_blocks = -(-len(chunk_ids) // block)
        self.blocks += n_blocks
        place = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        shared = np.flatnonzero(place >= 0)
        if not len(shared):
            self.skipped += n_blocks
            return
        # Columns of the small matrices: the terms that both sides have.
        column = np.full(len(self.terms), -1)
        column[place[shared]] = np.arange(len(shared))
        own = np.full(len(terms), -1)
        own[shared] = np.arange(len(shared))
        at = column[self.places]
        weights = np.zeros((self.n_queries, len(shared)))
        weights[self.users[at >= 0], at[at >= 0]] = self.weights[at >= 0]
        bound_at = own[lists["bound_term"]]
        known = bound_at >= 0
        bounds = np.zeros((len(shared), n_blocks))
        bounds[bound_at[known], lists["bound_block"][known]] = self.impact(lists["bound_tf"][known], lists["bound_dl"][known])
        most = weights @ bounds
        # Promising blocks first, so the floor rises early.
        order = np.argsort(-most.max(axis=0), kind="stable")
        postings = None
        for number in order:
            active = np.flatnonzero((most[:, number] > 0) & (most[:, number] >= self.running.floor - SLACK))
            if not len(active):
                self.skipped += 1
                continue
            if postings is None:
                postings = self._postings(own, lists, block, n_blocks)
            row, chunk, impact = (v[postings[0][number] : postings[0][number + 1]] for v in postings[1:])
            first = number * block
            scores = np.zeros((len(shared), min(block, len(chunk_ids) - first)))
            scores[row, chunk - first] = impact
            self.running.add(chunk_ids[first : first + block], weights[active] @ scores, only_positive=True, rows=active)

    def _postings(self, own: np.ndarray, lists: dict[str, np.ndarray], block: int, n_blocks: int) -> tuple[np.ndarray, ...]:
        """Start of each block, and term column, chunk and impact of the shared terms' postings by block."""
        row = own[np.repeat(np.arange(len(own)), lists["df"])]
        keep = row >= 0
        row, chunk, tf = row[keep], lists["post_chunk"][keep], lists["post_tf"][keep]
        order = np.argsort(chunk // block, kind="stable")
        row, chunk, tf = row[order], chunk[order], tf[order]
        return np.searchsorted(chunk // block, np.arange(n_blocks + 1)), row, chunk, self.impact(tf, lists["dl"][chunk])


def bm25_topk(
    source: DataFrame | SegmentIndex,
    queries: DataFrame,
    k: int = 20,
    k1: float = BM25_K1,
    b: float = BM25_B,
    queries_per_block: int = QUERIES,
) -> DataFrame:
    """Best ``k`` chunks per query ``(query_id, chunk_id, score, rank)``.

    Only chunks that share a word with the query can be hits, and a score that
    rounds to nothing is none.  ``source`` is a stored index or the chunk table,
    whose index is then built where the chunks lie.  The segments stay there as
    well: up to ``ROUND`` blocks of queries are broadcast to them at a time, and
    what is shuffled back are ``k`` rows per query and task.
    """
    index = source if isinstance(source, SegmentIndex) else segment_index(source)
    blocks = query_blocks(queries, index, queries_per_block).withColumn("q_no", F.xxhash64("query_ids"))
    blocks = staged(blocks.withColumn("avg_len", index.stats.select("avg_len").scalar()), "query-blocks")
    rounds = max(1, -(-blocks.count() // ROUND))
    kinds = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
    query_kind, chunk_kind = queries.schema["query_id"].dataType, index.segments.schema["chunk_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("query_id", query_kind), T.StructField("chunk_id", chunk_kind), T.StructField("score", T.DoubleType())]
    )

    def hits(ids: pa.Array, scorer: BlockScorer) -> Iterator[pa.RecordBatch]:
        for query, best in enumerate(scorer.running.best):
            if best is not None:
                scores, chunk_ids = best
                columns = [pa.array([ids[query].as_py()] * len(scores), kinds[query_kind.typeName()]), pa.array(chunk_ids, kinds[chunk_kind.typeName()]), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The blocks of one round.
        scorers: dict[int, tuple[pa.Array, BlockScorer]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                q_no = cell["q_no"].as_py()
                if q_no not in scorers:
                    # Copies: a view would keep the whole batch.
                    ids, terms = (pa.concat_arrays([cell[c].values, cell[c].values[:0]]) for c in ("query_ids", "query_terms"))
                    entries = [np.array(cell[c].values.to_numpy(zero_copy_only=False)) for c in ("users", "places", "weights")]
                    scorers[q_no] = (ids, BlockScorer(terms, *entries, len(ids), k, cell["avg_len"].as_py(), k1, b))
                lists = {name: cell[name].values.to_numpy(zero_copy_only=False).astype(np.int64) for name in LISTS}
                scorers[q_no][1].add(cell["chunk_ids"].values.to_numpy(zero_copy_only=False), cell["terms"].values, lists)
        for ids, scorer in scorers.values():
            yield from hits(ids, scorer)

    found = None
    for number in range(rounds):
        asked = blocks.filter(F.pmod("q_no", F.lit(rounds)) == number)
        pairs = index.segments.crossJoin(F.broadcast(asked))
        pairs = pairs.select("q_no", "query_ids", "query_terms", "users", "places", "weights", "avg_len", "chunk_ids", "terms", *LISTS)
        part = pairs.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
