"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes the counts of its byte trigrams (letters of ASCII lower-cased,
other ASCII as a space, bytes of other characters as they are), hashed to
``DIMENSIONS`` cells, weighed by ``(1 + log tf) * idf`` and scaled to length 1.
Every language has several centroids, found by spherical k-means over its
training vectors, so a language whose texts differ in kind is not averaged
into one point.  A text takes the language of the nearest centroid by cosine.
Its distance also decides whether it belongs to any.  Similarity grows with the
number of different trigrams, in real text much faster than in noise, so the
bound does too.  A text is rejected that has less similarity than ``REJECT`` has
for its number of trigrams, or less than ``REJECT_SHARE`` of the lowest
similarity of training texts of that size if that is less.  Noise fills the
cells evenly: with a share f of them filled its similarity is about sqrt(f)
times that of a text which has every cell once.  Below ``NOISE`` times this
floor a text of any size is rejected as well.

The model is fitted on a bounded sample: at most ``sample`` labelled rows,
spread evenly over the languages and chosen by a hash of the id.  It is
``languages * clusters * dimensions`` floats.  Prediction reads every whole
text; long ones are counted piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow_text import flat
from folioflow.llm.common import staged, table

DIMENSIONS = 4096
CLUSTERS = 3
SAMPLE = 4000
ROUNDS = 8
PIECE = 1 << 20
UNKNOWN = "und"
# (different trigrams from, least similarity): closer to no centroid than that is
# too far from all languages.
REJECT = ((0, 0.03), (100, 0.06), (300, 0.12))
REJECT_SHARE = 0.5
# Between noise from 300 trigrams on (up to 2.0 floors) and text (4.1 floors and more, 3.4 for 240 000 characters of four languages in turn).
NOISE = 2.2

# Byte classes: A-Z to a-z, letters and bytes of longer characters stay, the rest is a space.
FOLD = np.full(256, 32, np.uint32)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def trigram_counts(data: np.ndarray, offsets: np.ndarray, dimensions: int) -> np.ndarray:
    """One row of hashed trigram counts per text."""
    out = np.zeros((len(offsets) - 1, dimensions), np.float32)
    for i, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for at in range(start, max(start, end - 2), PIECE):
            b = FOLD[data[at : min(end, at + PIECE + 2)]]
            gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            cell = (gram * np.uint32(2654435761)) >> np.uint32(16)
            out[i] += np.bincount(cell % dimensions, minlength=dimensions)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(vectors: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length; starts from mutually distant rows, so it is deterministic."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centres = vectors[chosen]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == k].sum(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def size_class(counts: np.ndarray) -> np.ndarray:
    """Index into REJECT by the number of different trigrams."""
    return np.searchsorted([n for n, _ in REJECT], (counts > 0).sum(axis=1), side="right") - 1


@dataclass(frozen=True)
class Model:
    """Centroids, the language of each, the least similarity accepted by size of the text and that of a text with all cells."""

    languages: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray
    full: float

    def predict(self, counts: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        if not self.languages:
            n = len(counts)
            return [None] * n, np.zeros(n), np.ones(n, bool)
        scores = weigh(counts, self.idf) @ self.centroids.T
        best = scores.argmax(axis=1)
        score = np.clip(scores[np.arange(len(best)), best], 0, 1).astype(float)
        floor = self.full * np.sqrt((counts > 0).mean(axis=1))
        return [self.languages[self.owner[b]] for b in best], score, score < np.maximum(self.least[size_class(counts)], NOISE * floor)


def padded(text_col: str) -> Column:
    """The whole text between two spaces, so short words have trigrams too."""
    return F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit("")), F.lit(" "))


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows with letters, the same number of each language where there are enough.

    Ids are ranked first, without texts.  The number of rows of each language says
    below which hash its first ones lie, so a language sends little more than
    ``sample`` ids to its ranking however many there are.
    """
    usable = docs.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & has_letter(text_col))
    order = F.xxhash64(F.col(id_col).cast("string"))
    by_label = Window.partitionBy("label").orderBy(order, F.col(id_col))
    ids = usable.select(F.col(id_col), F.col(label_col).alias("label"), order.alias("order"))
    # Languages beyond the sample's size could have no row in it.
    sizes = staged(ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(sample), "lang-sizes")
    # Hashes are even over 64 bits: twice the sample and 100 lie below this with all but certainty at least the sample.
    share = F.least(F.lit(1.0), F.lit(2.0 * sample + 100) / F.col("n"))
    low = ids.join(F.broadcast(sizes), "label").filter(F.col("order") / F.lit(2.0**64) + 0.5 <= share)
    ranked = low.withColumn("rank", F.row_number().over(by_label)).filter(F.col("rank") <= sample)
    chosen = ranked.orderBy("rank", "order", "label").limit(sample).select(F.col(id_col).alias("_id"))
    chosen = F.broadcast(staged(chosen.distinct(), "lang-sample"))  # `sample` ids at most
    rows = usable.join(chosen, F.col(id_col) == F.col("_id"), "left_semi")
    return rows.select(F.col(label_col).alias("label"), padded(text_col).alias("text")).limit(sample)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    sample: int = SAMPLE, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS,
) -> Model:
    """Count in Spark, cluster the ``sample`` count vectors on the driver.

    A cell takes 2 bytes as a count and 4 as a weight there; counts are weighed
    a few rows at a time, so nothing else of that size is held.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = trigram_counts(*flat(part.column("text")), dimensions)
                packed = [np.minimum(r, 65535).astype(np.uint16).tobytes() for r in rows]
                yield pa.record_batch([part.column("label"), pa.array(packed, pa.binary())], ["label", "counts"])

    schema = T.StructType().add("label", "string").add("counts", "binary")
    rows = training_sample(docs, id_col, text_col, label_col, sample).mapInArrow(count, schema).collect()
    rows.sort(key=lambda r: (r.label, r.counts))
    labels = np.array([r.label for r in rows])
    counts = np.stack([np.frombuffer(r.counts, np.uint16) for r in rows]) if rows else np.zeros((0, dimensions), np.uint16)
    del rows
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    vectors = np.empty(counts.shape, np.float32)
    for at in range(0, len(counts), 256):
        vectors[at : at + 256] = weigh(counts[at : at + 256].astype(np.float32), idf)
    languages, owner, centroids = tuple(sorted(set(labels.tolist()))), [], []
    for i, language in enumerate(languages):
        own = vectors[labels == language]
        centres = spherical_kmeans(own, clusters)
        owner += [i] * len(centres)
        centroids.append(centres)
    stacked = np.concatenate(centroids) if centroids else np.zeros((0, dimensions), np.float32)
    least = [bound for _, bound in REJECT]
    if len(stacked):
        near, sizes = (vectors @ stacked.T).max(axis=1), size_class(counts)
        least = [min(bound, REJECT_SHARE * near[sizes == b].min(initial=1)) for b, bound in enumerate(least)]
    full = float((stacked @ (idf / np.linalg.norm(idf))).max(initial=0))
    return Model(languages, np.array(owner, int), stacked, np.array(least), idf, full)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names=("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the language, the cosine (0 to 1) and whether the distance rejects the text.

    A null text or one without any letter is ``und`` with score 0 and rejected.
    A model without languages rejects everything.  Own columns of ``docs`` that
    are named like results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[n for n in names if n in docs.columns])
    shared = spark.sparkContext.broadcast(model)  # languages * clusters * dimensions floats
    fields = docs.schema.fields

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs, scores, far = [], [], []
            texts, letters = batch.column(len(fields)), batch.column(len(fields) + 1)
            for at in range(0, batch.num_rows, 256):
                a, b, c = known.predict(trigram_counts(*flat(texts.slice(at, 256)), len(known.idf)))
                langs += a
                scores.append(b)
                far.append(c)
            lettered = letters.to_numpy(zero_copy_only=False).astype(bool)
            lang = [x if ok and x is not None else UNKNOWN for x, ok in zip(langs, lettered, strict=True)]
            score = np.where(lettered, np.concatenate(scores), 0.0) if scores else np.zeros(0)
            rejected = np.where(lettered, np.concatenate(far), True) if far else np.zeros(0, bool)
            columns = [*(batch.column(i) for i in range(len(fields))), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.record_batch(columns, [*(f.name for f in fields), *names])

    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    ready = docs.withColumns({"_padded": padded(text_col), "_lettered": has_letter(text_col)})
    return ready.mapInArrow(label, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's fold: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model, names=("_lang", "_score", "_far")).filter("not _far").select(*docs.columns)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
