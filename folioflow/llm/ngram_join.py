"""N-gram Jaccard self-join by chosen paths.

Texts are sets of five-word shingles, represented by min-hash coordinates: two
sets agree in a coordinate with a probability equal to their Jaccard similarity.
A run splits the sets by a sampled coordinate, splits buckets that are still
too large by a second and a third one, and compares small buckets pair by pair
on sketches.  ``runs_for`` says how many independent runs give the target
recall for a pair at the threshold whose buckets split all the way down.

What the buckets find only says which texts may be similar: connected groups of
candidates.  Every group is then read once, whole texts and all, and each of
its pairs is decided by the exact Jaccard similarity of the shingle sets, so
runs cost narrow rows only, and counts are exact.  A group or a bucket of any
size is cut into blocks; tasks take pairs of blocks, emit one row per text and
never a row per pair.  Copies (equal shingle sets) are one node throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow_text import flat
from folioflow.llm.common import staged, table, text_or_empty
from folioflow.llm.components import components
from folioflow.llm.shingles import min_hashes, shingle_sets

WIDTH = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.999999
DEPTH = 3
# Buckets up to this size are compared at once, larger ones are split.
BUCKET = 64
# Members of a block; a task holds two blocks of texts at most.
BLOCK = 512
SKETCH = 128
# Differing 2-bit cells of 128 at which a pair is still a candidate: at a similarity of 0.8
# the mean is 19.2 and the deviation 4.0.
MOST_DIFFERENT = 42


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Independent runs after which a pair has met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def sketched(docs: DataFrame, id_col: str, text_col: str, runs: int, width: int = WIDTH) -> DataFrame:
    """(id, t1, t2, digest, n, paths, sketch) per row; digest is null for texts without words."""
    factors, shifts = _coordinates(max(SKETCH, runs * DEPTH))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                digests, sizes, paths, bits = [], [], [], []
                for shingles in shingle_sets(*flat(batch.column(3)), width):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        digests.append(None), paths.append(None), bits.append(None)
                        continue
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    least = min_hashes(shingles, factors, shifts)
                    paths.append(least[: runs * DEPTH].tobytes())
                    cells = (least[:SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(30)
                    bits.append((cells[0::4] | cells[1::4] << 2 | cells[2::4] << 4 | cells[3::4] << 6).astype(np.uint8).tobytes())
                columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                           pa.array(paths, pa.binary()), pa.array(bits, pa.binary())]
                yield pa.record_batch(columns, schema.names)

    text = text_or_empty(text_col)
    ready = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), F.lower(text).alias("text"))
    schema = T.StructType([ready.schema["id"], *T.StructType.fromDDL("t1 long, t2 long, digest binary, n long, paths binary, sketch binary").fields])
    return ready.select("id", "t1", "t2", "text").mapInArrow(sketch, schema)


def leaf_buckets(nodes: DataFrame, runs: int) -> DataFrame:
    """(unit, half, digest, n, sketch): members of all buckets with partners, each small or cut into pairs of blocks.

    What meets by bucket are ids; sketches are joined to the few rows that have partners.
    """
    rows = nodes.select("digest", "paths", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))

    def key(depth: int) -> Column:
        return F.xxhash64("run", F.substring("paths", F.col("run") * (4 * DEPTH) + 1, F.lit(4 * depth)))

    leaves = []
    for depth in range(1, DEPTH + 1):
        keyed = rows.select("digest", "run", key(depth).alias("bucket"))
        sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = staged(keyed.join(sizes, "bucket"), "join-paths")
        small = met if depth == DEPTH else met.filter(F.col("size") <= BUCKET)
        leaves.append(small.select("bucket", "size", "digest"))
        rows = met.filter(F.col("size") > BUCKET).select("digest", "run").join(nodes.select("digest", "paths"), "digest")
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    return in_blocks(found, "bucket").join(nodes.select("digest", "n", "sketch"), "digest")


def in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """Replaces ``group`` and ``size`` by ``unit`` and ``half``: groups above BLOCK meet as pairs of blocks.

    A row of block b goes to the units (b, j) of all blocks j, as half 0 or 1;
    in the unit of its own block alone it has half -1.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    spread = rows.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    unit = F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))
    half = F.when(F.col("_own") == F.col("_other"), -1).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    return spread.withColumn("unit", unit).withColumn("half", half.cast("int")).drop("_blocks", "_own", "_other", "size")


def by_unit(rows: DataFrame, columns: list[str], work: Callable[[dict], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """Apply ``work`` to runs of whole units, sorted by unit and digest; a unit may span Arrow batches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column(0).to_numpy()
            # Rows before the last change of unit are complete.
            cut = int(np.searchsorted(units, units[-1])) if units[0] != units[-1] else 0
            if cut or (held and held[-1].column(0)[-1].as_py() != units[0]):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    # A fixed number of parts: units are small in bytes and large in work.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("unit", *columns).repartition(parts, "unit").sortWithinPartitions("unit", "digest")
    return dealt.mapInArrow(walk, schema)


def _root(label: list[int], i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = label[i]
    return i


def candidate_edges(buckets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): within each bucket every text with a candidate is linked to one text of its group."""
    edge_schema = T.StructType.fromDDL("u binary, v binary")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, n, half = (t.column(c).to_numpy() for c in ("unit", "n", "half"))
        digests = t.column("digest").to_pylist()
        cells = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 32)
        label = np.arange(len(unit))
        ones = np.uint64(0x5555555555555555)
        for d in range(1, len(unit)):
            i = np.flatnonzero(unit[d:] == unit[:-d])
            if not len(i):
                break
            j = i + d
            i, j = (x[(half[i] < 0) | (half[i] != half[j])] for x in (i, j))
            near = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
            near &= label[i] != label[j]
            i, j = i[near], j[near]
            x = cells[i] ^ cells[j]
            near = np.bitwise_count((x | x >> np.uint64(1)) & ones).sum(axis=1) <= MOST_DIFFERENT
            if near.any():
                parents = label.tolist()
                for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    ra, rb = _root(parents, a), _root(parents, b)
                    parents[max(ra, rb)] = min(ra, rb)
                label = np.array(parents)
                while (label != label[label]).any():
                    label = label[label]
        linked = np.flatnonzero(label != np.arange(len(label)))
        pick = lambda at: pa.array([digests[k] for k in at.tolist()], pa.binary())
        yield pa.record_batch([pick(linked), pick(label[linked])], ["u", "v"])

    return by_unit(buckets, ["half", "digest", "n", "sketch"], compare, edge_schema)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Pairwise intersection sizes, by products of the 0/1 matrix of shingles that occur more than once."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[often], column[often]
    shared = np.zeros((len(sets), len(sets)), np.int64)
    if not len(column):
        return shared
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    step = max(256, (1 << 22) // len(sets))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], column[a:b] - k * step] = 1
        shared += (part @ part.T).astype(np.int64)
    return shared


def exact_links(members: DataFrame, similarity: float, width: int = WIDTH) -> DataFrame:
    """(digest, text_links, doc_links, root) per member and unit, from the exact Jaccard similarity of every pair."""
    schema = T.StructType.fromDDL("digest binary, text_links long, doc_links long, root binary")

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        units = t.column("unit").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(units)), strict=True):
            group = t.slice(a, b - a).combine_chunks()
            half, copies = group.column("half").to_numpy(), group.column("copies").to_numpy()
            sets = shingle_sets(*flat(group.column("text").combine_chunks()), width)
            n = np.array([len(s) for s in sets])
            shared = shared_counts(sets)
            with np.errstate(invalid="ignore", divide="ignore"):
                linked = shared / (n[:, None] + n[None, :] - shared) >= similarity
            np.fill_diagonal(linked, False)
            if half[0] >= 0:
                linked &= half[:, None] != half[None, :]
            label = np.arange(len(n))
            while True:
                least = np.minimum(label, np.where(linked, label[None, :], len(n)).min(axis=1))
                if (least == label).all():
                    break
                label = least
            digests = group.column("digest").to_pylist()
            yield pa.record_batch(
                [pa.array(digests, pa.binary()), pa.array(linked.sum(axis=1)), pa.array((linked * copies[None, :]).sum(axis=1)),
                 pa.array([digests[k] for k in label], pa.binary())], schema.names,
            )

    return by_unit(members, ["half", "digest", "copies", "text"], verify, schema)


def classified(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float, width: int) -> DataFrame:
    """(id, t1, t2, digest, n, leader, text_links, links) for every row of ``docs``.

    t1 and t2 hash the text.  ``leader`` is the (no_id, id, t1, t2) of the row
    that stands for the class: the smallest id, null ids last, then the least
    hashes.  Rows without words have neither digest nor leader.
    """
    runs = runs_for(recall, similarity, DEPTH)
    rows = staged(sketched(docs, id_col, text_col, runs, width), "join-sketches")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(row).alias("text_of"),
        F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"),
    )
    nodes = staged(nodes, "join-nodes")
    candidates = staged(candidate_edges(leaf_buckets(nodes, runs), similarity).distinct(), "join-candidates")
    grouped = components(candidates)
    grouped = staged(grouped.union(grouped.select(F.col("label").alias("node"), "label").distinct()), "join-groups")
    sizes = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = grouped.withColumnRenamed("node", "digest").join(sizes, "label").join(nodes.select("digest", "copies", "text_of"), "digest")
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_t1"), F.xxhash64(text_or_empty(text_col), F.lit(1)).alias("_t2"), F.lower(text_or_empty(text_col)).alias("text"))
    same = F.col("_id").eqNullSafe(F.col("text_of.id")) & (F.col("_t1") == F.col("text_of.t1")) & (F.col("_t2") == F.col("text_of.t2"))
    # Rows that repeat id and text meet again here and are merged ahead of the shuffle.
    read = texts.join(members.hint("shuffle_merge"), same).groupBy("digest", "label", "size", "copies").agg(F.min("text").alias("text"))
    links = staged(exact_links(in_blocks(read, "label"), similarity, width), "join-links")
    counts = links.groupBy("digest").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    labels = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "digest")
    known = nodes.select("digest", "copies", "text_of").join(counts, "digest", "left").join(labels, "digest", "left")
    known = staged(known.withColumn("label", F.coalesce("label", "digest")), "join-labels")
    classes = known.groupBy("label").agg(F.min("text_of").alias("leader"))
    known = known.join(classes, "label").select(
        "digest", "leader", F.coalesce("text_links", F.lit(0)).alias("text_links"),
        (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    return rows.select("id", "t1", "t2", "digest", "n").join(known, "digest", "left")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    recall: float = TARGET_RECALL, width: int = WIDTH,
) -> DataFrame:
    """(id, class_id, n_links, n_text_links, n_shingles) for every row of ``docs``.

    A class is a connected group of texts with a Jaccard similarity of at least
    ``similarity``; ``class_id`` is its smallest id.  ``n_links`` counts the
    other documents that are similar, copies included, ``n_text_links`` the
    different shingle sets among them.  Texts shorter than ``width`` words have
    one shingle, all their words.  Null texts and texts without words are in a
    class of their own, with their id and no links.  Null ids take part; a
    class of only null ids has a null class_id.
    """
    out = classified(docs, id_col, text_col, similarity, recall, width)
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("leader.id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.col("n").alias("n_shingles"),
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: its leader, that of the smallest id; rows without words all stay.

    Rows are told apart by id and text, since ids may be null or repeated.  Of
    rows that repeat the leader's id and text any one stays.
    """
    rows = classified(docs, id_col, text_col, SIMILARITY, TARGET_RECALL, WIDTH).filter("digest is not null")
    leads = F.col("id").eqNullSafe(F.col("leader.id")) & (F.col("t1") == F.col("leader.t1")) & (F.col("t2") == F.col("leader.t2"))
    own = [F.col("id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")]
    marked = staged(rows.groupBy("id", "t1", "t2", leads.alias("leads")).agg(F.count(F.lit(1)).alias("n")).filter("not leads or n > 1"), "join-marked")
    text = text_or_empty(text_col)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_t1")) & (F.xxhash64(text, F.lit(1)) == F.col("_t2"))
    kept = docs.join(marked.select(*own).hint("shuffle_merge"), same, "left_anti")
    repeated = marked.filter("leads").select(*own)
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, same).dropDuplicates(["_id", "_t1", "_t2"])
    return kept.unionByName(once.select(*docs.columns))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))
