"""Removal of long repeated byte strings by a sparse suffix order.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else,
in this or another document, is removed.  A full suffix array has one entry per
byte; here one suffix per *anchor* is enough.  Anchors are the positions whose
``GRAM``-byte hash is the least of some ``LENGTH``-byte window, so equal windows
hold the same anchor at the same offset.

1. Anchors of all documents.  A window holds its anchor's gram and, to the side
   that it reaches further, a block of more than half its length.  Anchors go
   unless their gram and one of these blocks occur twice, so a line that many
   documents share is not enough.
2. Every remaining anchor stands for the suffix that starts at it, with the
   bytes before it as the symbols of the transform, both bounded by the window.
   Equal surroundings are counted once, ahead of the shuffle.
3. Suffixes that share a block meet.  Each task interleaves the shards of
   suffixes it gets and refines the interleave byte by byte: a block of
   suffixes with equal prefixes splits by the next byte, suffixes alone in
   their block are done.  The block numbers after i steps are the equality
   classes of common prefixes of length i (and, over the preceding symbols, of
   common extensions to the left), so nothing is sorted twice and no hash
   decides: the window that starts o bytes before an anchor is repeated if and
   only if another suffix shares its class of o bytes to the left and of
   ``LENGTH - o`` to the right.
4. A group with more than ``GROUP`` different surroundings (a passage that a
   large share of all documents quotes) is not given to one task: its windows
   are counted one by one, keyed by a 128-bit digest.

Per anchor the repeated windows form one interval, since all of them hold the
anchor; intervals are joined per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow_text import flat
from folioflow.llm.common import staged, table, text_or_empty
from folioflow.llm.shingles import mix, powers

LENGTH = 400
GRAM = 64
# Different surroundings of one anchor that a task compares at once: at most
# GROUP + HOLD of them, some 6 KB each with their classes.
GROUP = 32_768
# Smaller groups are compared together once so many surroundings are held.
HOLD = 4096
CHUNK = 1 << 20


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over all runs of ``width`` values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return pick(values[: len(values) - (width - reach)], values[width - reach :])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the grams that are least in some window of ``length`` bytes, their hashes and those of two blocks.

    A window around an anchor reaches at least half of its other bytes to one
    side, so it holds the block from there to the gram's end (left) or from the
    gram's start (right); 0 where the text is too short for the block.
    """
    width, half, n = length - gram + 1, (length - gram) // 2, len(data)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, n - length + 1), CHUNK):
        low, last = max(0, at - half), min(at + CHUNK, n - length + 1)
        part = data[low : min(n, last + 2 * length)]
        up, down = powers(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        h = mix((total[gram:] - total[:-gram]) * down[: len(total) - gram])[at - low : last - low + width - 1]
        least = sliding(h, width, np.minimum)
        # A gram is least somewhere if the largest minimum among its windows is its own value.
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
        place = chosen + at - low
        blocks = []
        for begin, end, side in ((place - half, place + gram, 1), (place, place + length - half, 2)):
            whole = (begin >= 0) & (end <= len(part))
            b, e = begin[whole], end[whole]
            value = np.zeros(len(place), np.uint64)
            value[whole] = mix((total[e] - total[b]) * down[b] ^ np.uint64(side)) | np.uint64(1)
            blocks.append(value)
        found.append((place + low, h[chosen], *blocks))
    if not found:
        return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3
    where, *values = (np.concatenate(x) for x in zip(*found, strict=True))
    where, first = np.unique(where, return_index=True)
    return where, *[v[first] for v in values]


def refine(classes: np.ndarray, symbols: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """Equality classes after 0, 1, 2, ... symbols.

    ``symbols`` has one row per suffix, ``inside`` the number of symbols it
    has; a suffix that has ended is alone, with a class below 0.  Each step
    splits the blocks that still hold several suffixes by their next symbol.
    """
    current = classes.astype(np.int32)
    out = [current]
    active = np.arange(len(classes))
    fresh = int(classes.max(initial=-1)) + 1
    for step in range(symbols.shape[1]):
        current = current.copy()
        ended = active[inside[active] <= step]
        current[ended] = -1 - ended
        active = active[inside[active] > step]
        keys = current[active].astype(np.int64) * 256 + symbols[active, step]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        block = np.cumsum(new) - 1
        current[active[order]] = fresh + block
        sizes = np.bincount(block)
        fresh += len(sizes)
        # A suffix alone in its block keeps a number that nothing else gets.
        active = np.sort(active[order][sizes[block] > 1])
        out.append(current)
    return out


def repeated_offsets(group: np.ndarray, left: np.ndarray, contexts: list[bytes], counts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per surroundings the largest and the least offset of a repeated window before the anchor; (-1, -1) for none."""
    n, reach = len(contexts), length - gram
    after, before = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    right = np.array([len(c) for c in contexts]) - left
    for i, c in enumerate(contexts):
        own = np.frombuffer(c, np.uint8)
        after[i, : right[i]] = own[left[i] :]
        before[i, : left[i]] = own[: left[i]][::-1]
    _, start = np.unique(group, return_inverse=True)
    rights = refine(start.astype(np.int64), after, right)
    lefts = refine(start.astype(np.int64), before, left)
    most, least = np.full(n, -1), np.full(n, -1)
    for offset in range(reach + 1):
        valid = np.flatnonzero((left >= offset) & (right >= length - offset))
        keys = rights[length - offset][valid].astype(np.int64) << 32 | lefts[offset][valid].astype(np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(order) else np.zeros(0, bool)
        block = np.cumsum(new) - 1
        total = np.bincount(block, weights=counts[valid][order]) if len(order) else np.zeros(0)
        hit = valid[order][total[block] >= 2] if len(order) else valid
        least[hit] = np.where(least[hit] < 0, offset, least[hit])
        most[hit] = offset
    return most, least


def _lists(offsets: list[int], values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def text_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, pos, hash, left, right) arrays per row of (key, text)."""
    schema = T.StructType.fromDDL("key binary, pos array<int>, hash array<long>, left array<long>, right array<long>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ends, parts = [0], [[], [], [], []]
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                for column, values in zip(parts, anchors(data[a:b], length, gram), strict=True):
                    column.append(values)
                ends.append(ends[-1] + len(parts[0][-1]))
            where, *hashes = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in parts)
            columns = [batch.column(0), _lists(ends, where.astype(np.int32), pa.int32())]
            yield pa.record_batch([*columns, *[_lists(ends, h.view(np.int64), pa.int64()) for h in hashes]], schema.names)

    return texts.select("key", "text").mapInArrow(scan, schema)


def surroundings(shared: DataFrame, length: int, gram: int, with_bytes: bool) -> DataFrame:
    """(key, pos, hash, c1, c2, left[, context]) per anchor and shared block; (c1, c2) names the surroundings.

    With the left block go the windows that reach half or more to the left,
    with the right block the others; the bytes kept around the anchor are those
    of these windows, ``left`` of them before it.
    """
    names = "key binary, pos int, hash long, c1 long, c2 long, left int" + (", context binary" if with_bytes else "")
    schema = T.StructType.fromDDL(names)
    half = (length - gram) // 2
    reach = {0: (length - gram, length - half), 1: (half - 1, length)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                data, offsets = flat(batch.column(1))
                rows = ([], [], [], [], [], [], [])
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    text, key = data[a:b].tobytes(), batch.column(0)[i].as_py()
                    for pos, side, h in zip(*(batch.column(c)[i].as_py() for c in (2, 3, 4)), strict=True):
                        before, after = reach[side]
                        left = min(before, pos)
                        context = text[pos - left : pos + after]
                        name = hashlib.blake2b(context, digest_size=16, salt=left.to_bytes(4, "big")).digest()
                        row = (key, pos, h, int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True), left, context)
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
                yield pa.record_batch(columns[: len(schema.names)], schema.names)

    return shared.select("key", "text", "pos", "side", "block").mapInArrow(cut, schema)


RANGE = T.StructType().add("hash", "long").add("c1", "long").add("c2", "long").add("most", "integer").add("least", "integer")


def compared(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, c1, c2, most, least): whole groups of one anchor hash, several groups at a time."""

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        column = {c: t.column(c).to_numpy() for c in ("hash", "c1", "c2", "left", "copies")}
        most, least = repeated_offsets(column["hash"], column["left"], t.column("context").to_pylist(), column["copies"], length, gram)
        hit = np.flatnonzero(most >= 0)
        out = [pa.array(column[c][hit]) for c in ("hash", "c1", "c2")] + [pa.array(x[hit].astype(np.int32)) for x in (most, least)]
        yield pa.record_batch(out, RANGE.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                h = batch.column(0).to_numpy()
                # Once enough is held, it goes at the next change of group.
                if size >= HOLD:
                    cut = int(np.argmax(h != last)) if (h != last).any() else len(h)
                    held.append(batch.slice(0, cut))
                    size += cut
                    if cut < len(h):
                        yield from work(held)
                        held, size = [batch.slice(cut)], len(h) - cut
                else:
                    held.append(batch)
                    size += len(h)
                last = h[-1]
        if size:
            yield from work(held)

    dealt = contexts.select("hash", "c1", "c2", "left", "copies", "context").repartition("hash").sortWithinPartitions("hash")
    return dealt.mapInArrow(walk, RANGE)


def counted_windows(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for groups of any size: every window is a row, counted by its digest."""
    schema = T.StructType.fromDDL("hash long, c1 long, c2 long, offset int, copies long, window binary")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                rows = []
                for r in whole.slice(at, 64).to_pylist():
                    for offset in range(max(0, length - len(r["context"]) + r["left"]), min(r["left"], length - gram) + 1):
                        begin = r["left"] - offset
                        digest = hashlib.blake2b(r["context"][begin : begin + length], digest_size=16).digest()
                        rows.append((r["hash"], r["c1"], r["c2"], offset, r["copies"], digest))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    windows = contexts.select("hash", "c1", "c2", "left", "copies", "context").mapInArrow(explode, schema)
    # The anchor hash is part of the key: a window is counted per anchor it holds.
    repeated = windows.groupBy("hash", "offset", "window").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    hits = windows.join(repeated, ["hash", "offset", "window"])
    return hits.groupBy("hash", "c1", "c2").agg(F.max("offset").alias("most"), F.min("offset").alias("least"))


def merged_spans(intervals: DataFrame) -> DataFrame:
    """(key, spans): the disjoint maximal intervals of each text, in order."""
    sorted_ = F.array_sort(F.collect_set(F.struct("begin", "end")))
    zero = F.array().cast("array<struct<begin:int,end:int>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end")))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), joined)
        return F.when((F.size(done) > 0) & (x["begin"] <= F.get(done, F.size(done) - 1)["end"]), grown).otherwise(F.concat(done, F.array(x)))

    return intervals.groupBy("key").agg(sorted_.alias("all")).select("key", F.aggregate("all", zero, add).alias("spans"))


def kept_digests(texts: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept) for (key, text, begins, ends): digests of the bytes outside the spans."""
    schema = T.StructType.fromDDL("key binary, n_removed long, n_spans long, kept string")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            removed, spans, kept = [], [], []
            for i, a in enumerate(offsets[:-1]):
                begins, ends = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                digest, at = hashlib.sha256(), a
                # Spans that touch are one run; the merge has joined them.
                for begin, end in zip(begins, ends, strict=True):
                    digest.update(data[at : a + begin])
                    at = a + end
                digest.update(data[at : offsets[i + 1]])
                removed.append(sum(ends) - sum(begins))
                spans.append(len(begins))
                kept.append(digest.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return texts.select("key", "text", "begins", "ends").mapInArrow(keep, schema)


# A value of this share of all rows is hot; so there are at most HOT of them.
HOT = 1000


def repeated_rows(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` occurs more than once.

    Counts combine ahead of the shuffle.  Rows of hot values stay where they are,
    by a broadcast of at most ``HOT`` values; those of others are shuffled.
    """
    counts = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sa-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") * HOT >= total).select(key))
    cold = rows.join(hot, key, "left_anti").join(counts.drop("n").hint("shuffle_merge"), key)
    return rows.join(hot, key, "left_semi").unionByName(cold)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Texts are their UTF-8 bytes, null is empty; matches never cross rows.
    Copies are other places: a text of at least ``length`` bytes that occurs
    twice goes whole.  Shorter texts stay.  Empty tables give empty results.
    Repeated and null ids are rows of their own, other columns are not looked at,
    whatever their names.  A text is held whole by one task.
    """
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("text")).withColumn("_sha", F.sha2("text", 256))
    keyed = keyed.withColumn("key", F.substring(F.unhex("_sha"), 1, 16))
    base = staged(keyed.select("_id", "key", F.unhex("_sha").alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "sa-base")
    texts = base.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("rep"))
    found = text_anchors(keyed.filter(F.octet_length("text") >= length), length, gram)
    found = staged(found.dropDuplicates(["key"]), "sa-anchors")
    rows = found.select("key", F.explode(F.arrays_zip("pos", "hash", "left", "right")).alias("a")).select("key", "a.*")
    met = staged(repeated_rows(rows, "hash").drop("hash"), "sa-shared")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("block")) for i, c in enumerate(("left", "right"))])
    halves = met.select("key", "pos", F.explode(sides).alias("s")).select("key", "pos", "s.side", "s.block").filter("block <> 0")
    halves = repeated_rows(halves, "block")
    listed = halves.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "side", "block"))).alias("a"))
    listed = listed.join(texts, "key").select(F.col("key").alias("k"), "rep", "a.pos", "a.side", "a.block")
    # One row of each text that has shared anchors, with its bytes.
    # Tables that grow with the texts are never broadcast.
    met = keyed.join(listed.hint("shuffle_merge"), (F.col("key") == F.col("k")) & F.col("_id").eqNullSafe(F.col("rep"))).select("key", "text", "pos", "side", "block")
    if not base.groupBy("_id", "key").count().filter("count > 1").isEmpty():
        # Rows that repeat id and text have all met the join.
        met = met.dropDuplicates(["key"])
    met = staged(met, "sa-texts")
    contexts = surroundings(met, length, gram, True).groupBy("hash", "c1", "c2").agg(
        F.count(F.lit(1)).alias("copies"), F.first("left").alias("left"), F.first("context").alias("context")
    )
    contexts = staged(contexts, "sa-contexts")
    sizes = contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.filter(F.col("size") > group).select("hash")
    ranges = compared(contexts.join(large, "hash", "left_anti"), length, gram)
    ranges = ranges.unionByName(counted_windows(contexts.join(large, "hash", "left_semi"), length, gram))
    ranges = staged(ranges, "sa-ranges")
    intervals = surroundings(met, length, gram, False).join(ranges.hint("shuffle_merge"), ["hash", "c1", "c2"]).select(
        "key", (F.col("pos") - F.col("most")).alias("begin"), (F.col("pos") - F.col("least") + length).alias("end")
    )
    spans = merged_spans(intervals).select(F.col("key").alias("k"), F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))
    cut = staged(kept_digests(met.join(spans.hint("shuffle_merge"), F.col("key") == F.col("k"))), "sa-kept")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = base.join(texts.select("key", "copies"), "key").join(cut, "key", "left")
    return out.select(
        F.col("_id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
