"""Phrase collocations by top-order marginalisation.

Every word opens one window: itself and its three leads within its piece of
text, null where the piece ends.  Only these padded windows of the highest order
are counted; Spark's ROLLUP over (w1, w2, w3, w4) then sums ever shorter
prefixes, which are the counts of all shorter phrases, since each phrase is the
prefix of exactly the windows that open at its occurrences.

A window may end early where no frequent phrase can go on.  Whether it can is
known from two passes that count pairs and then triples of neighbouring words by
hash bucket (``filter_bits``): the phrases of a bucket with fewer than ``least``
occurrences in all are rarer than that each, and so is every longer phrase with
one of them.  Triples are only counted where both of their pairs may be frequent.
Buckets only spare work.  Phrases are counted by their words, so a full filter
spares less and changes nothing.

Tasks cut texts into words, build the lead columns and combine their own windows
as arrays; grouping, marginals, cuts, containment and ranks are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow_text import flat
from folioflow.llm.common import staged, table, text_or_empty

LEAST = 30
TOP = 2000
ORDER = 4
# 2 ** 26 buckets: two bitmaps of 8 MB, whatever the corpus.
FILTER_BITS = 26
# Bytes of text worked on at once; a longer piece is held whole.
BLOCK = 1 << 21
SALTS = 64
UNKNOWN = "und"

# Byte classes: 0 word, 1 space, 2 end of a piece.
BYTE_CLASS = np.zeros(256, np.uint8)
BYTE_CLASS[list(b" \t")] = 1
BYTE_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a run of texts: codes into ``names``, the piece and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = BYTE_CLASS[data]
        inside = kind == 0
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets] = True
        opens = opens[:-1]
        start = inside & (np.append(True, ~inside[:-1]) | opens) if len(data) else inside
        at = np.flatnonzero(start)
        self.piece = np.cumsum((kind == 2) | opens)[at]
        self.row = np.searchsorted(offsets, at, side="right") - 1
        letters = LOWER[data[inside]]
        bounds = np.append(np.flatnonzero(start[inside]), len(letters)).astype(np.int64)
        spelled = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
        self.names = spelled.dictionary
        self.code = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def __len__(self) -> int:
        return len(self.code)

    def fits(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each one on stand in the same piece."""
        return np.append(self.piece[size - 1 :] == self.piece[: len(self) - size + 1], np.zeros(size - 1, bool))[: len(self)]

    def buckets(self, size: int, lang: np.ndarray, bits: int) -> np.ndarray:
        """The filter bucket of the ``size`` words from each one on; ``lang`` is a hash for each row."""
        own = hashes(self.names)[self.code]
        mixed = lang[self.row]
        for k in range(size):
            mixed = (mixed + np.append(own[k:], np.zeros(k, np.uint64))[: len(self)]) * MIX
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def goes_on(self, marks: list[np.ndarray], lang: np.ndarray, bits: int) -> list[np.ndarray]:
        """For 2, 3 and so on words from each one on: whether they may be a frequent phrase by the bitmaps so far."""
        out = []
        for size, bitmap in enumerate(marks, 2):
            may = self.fits(size)
            if out:
                may &= out[-1] & np.append(out[-1][1:], False)
            at = np.flatnonzero(may)
            bucket = self.buckets(size, lang, bits)[at]
            may[at] = ((bitmap[bucket >> 6] >> (bucket & 63)) & 1) == 1
            out.append(may)
        return out


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, Words]]:
    """(first row, words) of runs of whole pieces of about ``size`` bytes."""
    data, offsets = flat(batch.column("text"))
    offsets = offsets.astype(np.int64)
    low, end = int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(end, low + size)
        if high < end:
            ahead = next((int(p[0]) + at + 1 for at in range(high, end, size) if len(p := np.flatnonzero(BYTE_CLASS[data[at : at + size]] == 2))), end)
            row_end = int(offsets[np.searchsorted(offsets, high)])
            high = min(ahead, row_end)
        first = int(np.searchsorted(offsets, low, side="right")) - 1
        last = int(np.searchsorted(offsets, high, side="left"))
        yield first, Words(data[low:high], np.clip(offsets[first : last + 1], low, high) - low)
        low = high


def hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(values.to_pylist(), object), categorize=False)


def frequent_buckets(texts: DataFrame, size: int, marks: list[np.ndarray], least: int, bits: int) -> np.ndarray:
    """Bitmap of the buckets in which phrases of ``size`` words occur ``least`` times, ``2 ** bits / 8`` bytes.

    ``marks`` has the bitmaps of shorter phrases; what they exclude is not counted.
    """
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One byte a bucket: more than `least` occurrences need not be told apart.
        seen, most = np.zeros(1 << bits, np.uint8), min(255, least)
        for batch in batches:
            lang = hashes(batch.column("lang"))
            for first, words in blocks(batch, BLOCK):
                if not len(words):
                    continue
                may = words.fits(size)
                if shared.value:
                    shorter = words.goes_on(shared.value, lang[first:], bits)[-1]
                    may &= shorter & np.append(shorter[1:], False)
                found, n = np.unique(words.buckets(size, lang[first:], bits)[may], return_counts=True)
                seen[found] = np.minimum(seen[found] + np.minimum(n, most), most)
        for at in range(0, len(seen), 1 << 20):
            full = np.flatnonzero(seen[at : at + (1 << 20)])
            yield pa.record_batch([pa.array((full + at).astype(np.int32)), pa.array(seen[at + full].astype(np.int32))], ["bucket", "n"])

    if least > 255:
        raise ValueError("the filter counts up to 255")
    counted = texts.mapInArrow(count, "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # 2 ** 14 buckets to a row of 2 KB: 2 ** (bits - 14) rows come back.
    word = F.bit_or(F.expr("shiftleft(1L, bucket & 63)"))
    spread = counted.groupBy(F.shiftright("bucket", 14).alias("block"), F.shiftright("bucket", 6).alias("part")).agg(word.alias("bits"))
    rows = staged(spread.groupBy("block").agg(F.collect_list("part").alias("parts"), F.collect_list("bits").alias("bits")), "phrase-filter")
    bitmap = np.zeros(max(1, (1 << bits) // 64), np.int64)
    for row in rows.toLocalIterator():
        bitmap[row.parts] = row.bits
    return bitmap


def window_counts(texts: DataFrame, marks: list[np.ndarray], bits: int) -> DataFrame:
    """(lang, w1 .. w4, n): padded longest windows, combined within a block of text."""
    words_of = [f"w{i}" for i in range(1, ORDER + 1)]
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = hashes(batch.column("lang"))
            names = batch.column("lang").dictionary_encode()
            lang_code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for first, words in blocks(batch, BLOCK):
                if not len(words):
                    continue
                pairs, triples = words.goes_on(shared.value, lang[first:], bits)
                columns = [words.code]
                for k, open_ in enumerate((pairs, triples, triples & np.append(triples[1:], False)), 1):
                    lead = np.append(words.code[k:], np.zeros(k, np.int64))[: len(words)]
                    columns.append(np.where(open_, lead + 1, 0))
                base, own = len(words.names) + 1, lang_code[first:][words.row]
                single = columns[1] == 0
                # Most windows are one word long.
                alone, n_alone = np.unique(own[single] * base + columns[0][single], return_counts=True)
                rest = np.flatnonzero(~single)
                own, columns = own[rest], [c[rest] for c in columns]
                # Exact keys: pairs of columns become dense numbers before they meet.
                _, head = np.unique((own * base + columns[0]) * base + columns[1], return_inverse=True)
                tails, tail = np.unique(columns[2] * base + columns[3], return_inverse=True)
                _, at, n = np.unique(head * len(tails) + tail, return_index=True, return_counts=True)
                pad = np.zeros(len(alone), np.int64)
                out = [names.dictionary.take(pa.array(np.append(own[at], alone // base))), words.names.take(pa.array(np.append(columns[0][at], alone % base)))]
                for column in columns[1:]:
                    lead = np.append(column[at], pad)
                    out.append(words.names.take(pa.array(lead - 1, mask=lead == 0)))
                yield pa.record_batch([*(c.cast(pa.string()) for c in out), pa.array(np.append(n, n_alone))], ["lang", *words_of, "n"])

    local = texts.mapInArrow(count, T.StructType().add("lang", "string").add("w1", "string").add("w2", "string").add("w3", "string").add("w4", "string").add("n", "long"))
    return local.groupBy("lang", *words_of).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, size, phrase, f): all phrases of 1 to 4 words that occur ``least`` times; size 0 has the number of words.

    Null texts are empty, null languages ``und``.  A language without a word has
    no row.  ``size`` 0 is the rollup's total of a language.
    """
    texts = docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    marks: list[np.ndarray] = []
    for size in range(2, ORDER):
        marks.append(frequent_buckets(texts, size, marks, least, filter_bits))
    windows = staged(window_counts(texts, marks, filter_bits), "phrase-windows")
    level = "grouping_id()"
    rolled = windows.sparkSession.sql(
        f"select lang, {level} as level, w1, w2, w3, w4, sum(n) as f from {{windows}} group by lang, rollup(w1, w2, w3, w4)", windows=windows
    )
    size = F.create_map(*[F.lit(v) for pair in ((0, 4), (1, 3), (3, 2), (7, 1), (15, 0)) for v in pair])[F.col("level")]
    last = F.element_at(F.array("w1", "w2", "w3", "w4"), F.greatest(F.col("size"), F.lit(1)))
    sized = rolled.withColumn("size", size)
    whole = sized.filter((F.col("size") == 0) | ((F.col("f") >= least) & last.isNotNull()))
    return whole.select("lang", "size", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "f")


def part(words: str, start: int | str, size: int | str) -> str:
    return f"array_join(slice({words}, {start}, {size}), ' ')"


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
    contained_percent: int = 80, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    A phrase with ``a`` occurrences, at least ``least``, is cut after each of its
    words; of the scores floor(2000000 a / (l + r)) of its cuts the lowest counts,
    ties go to the first cut.  It is left out where a longer one with at least
    ``contained_percent`` of its occurrences holds it.  Ties in the ranking go to
    more occurrences, then to the phrase in byte order.  Products are decimals.

    Null texts and texts without words add nothing, null languages are ``und``,
    repeated rows count each, long texts are read whole (a single piece has to fit
    in a task), other columns are not looked at.  Empty tables give no rows.
    """
    counts = staged(phrase_counts(docs, text_col, lang_col, least, filter_bits), "phrase-counts")
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.filter("size > 0")
    candidates = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "size", "a", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "size", "a", "k", F.expr(part("words", 1, "k")).alias("left"), F.expr(part("words", "k + 1", "size - k")).alias("right")
    )
    sides = phrases.select("lang", F.col("phrase").alias("side"), "f")
    cut = cuts.join(sides.withColumnsRenamed({"side": "left", "f": "l"}), ["lang", "left"]).join(sides.withColumnsRenamed({"side": "right", "f": "r"}), ["lang", "right"])
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as long)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = F.expr(f"flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> {part('words', 'i', 's')})))")
    holders = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(contained_percent)}")
    kept = scored.join(holders, ["lang", "phrase"], "left").filter(~F.coalesce(held, F.lit(False)))
    flatter = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Best of each salt first, so a language's last window holds at most salts * top rows.
    salt = (F.xxhash64("phrase") % SALTS).alias("salt")
    best = flatter.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), listed as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), placed as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from listed
), spans as (
  select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase
  from placed, (select unnest([1, 2, 3, 4]) as size) where i + size - 1 <= len(w)
), totals as (
  select lang, count(*) as n from spans where size = 1 group by lang
), f as (
  select lang, size, phrase, count(*) as a from spans group by all having count(*) >= 30
), cuts as (
  select c.lang, c.phrase, c.a, c.size, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') as lp, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') as rp
  from f c, (select unnest([1, 2, 3]) as k) where c.size > 1 and k < c.size
), scored as (
  select u.lang, u.phrase, u.a, u.k, l.a as l, r.a as r, ((2000000 * u.a::hugeint) // (l.a + r.a))::bigint as score
  from cuts u join f l on l.lang = u.lang and l.phrase = u.lp join f r on r.lang = u.lang and r.phrase = u.rp
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), held as (
  select distinct c.lang, c.phrase
  from (select *, string_split(phrase, ' ') as w from f where size > 2) b, (select unnest([2, 3]) as s) t, (select unnest([1, 2, 3]) as i) p, f c
  where s < b.size and i + s - 1 <= b.size and c.lang = b.lang and c.size = s and c.phrase = array_to_string(b.w[i : i + s - 1], ' ')
    and 100 * b.a::hugeint >= 80 * c.a::hugeint
), ranked as (
  select lang, phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
  from lowest where not exists (select 1 from held where held.lang = lowest.lang and held.phrase = lowest.phrase)
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
