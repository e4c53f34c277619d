"""Size-bounded chunks of sections and paragraphs.

Packing is a true fold: where a chunk starts depends on all before it.  The
fold below runs inside the JVM over the lengths alone and keeps only the chunk
starts, so its state grows with the chunks of one document, not with its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import strip, token_estimate

# Fixed values of the chunk contract, in characters.
TARGET_MAX = 2000
HARD_MAX = 2500
MIN_CHUNK = 100
JOINT = "\n\n"


def pack(lengths: Column, target: int = TARGET_MAX, hard: int | None = None) -> Column:
    """Array of ``(first, n)``: first part (from 0) and number of parts of each chunk.

    A part joins the open chunk while the total with two-character joints
    stays within ``target``; a part longer than ``hard`` stands alone.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(-1).alias("open"), F.lit(0).alias("pos"))

    def step(acc: Column, length: Column) -> Column:
        joined = acc["open"] + 2 + length
        fits = (acc["open"] >= 0) & (joined <= target)
        alone = F.lit(False)
        if hard is not None:
            alone = length > hard
            fits = fits & ~alone
        return F.struct(
            F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["pos"]))).alias("starts"),
            F.when(alone, F.lit(-1)).when(fits, joined).otherwise(length).alias("open"),
            (acc["pos"] + 1).alias("pos"),
        )

    def finish(acc: Column) -> Column:
        def chunk(first: Column, i: Column) -> Column:
            following = F.coalesce(F.get(acc["starts"], i + 1), acc["pos"])
            return F.struct(first.alias("first"), (following - first).alias("n"))

        return F.transform(acc["starts"], chunk)

    return F.aggregate(lengths, start, step, finish)


def _blocks(text: Column) -> Column:
    """Non-blank, trimmed blocks between blank lines."""
    return F.filter(F.transform(F.split(text, JOINT), strip), lambda p: p != "")


def chunk_sections(sections: DataFrame) -> DataFrame:
    """Chunks of ``sections(..., heading, text)``; adds ``sub_index`` and ``chunk_text``.

    Up to 2500 characters stay whole.  Longer text is split at blank lines and
    packed to 2000.  Pieces under 100 characters are dropped if there are
    several; the others keep their index.  The heading goes before piece 0.
    """
    kept = [c for c in sections.columns if c != "text"]
    whole = sections.withColumn("__text", strip(F.col("text"))).filter("__text <> ''")
    parts = F.when(F.length("__text") <= HARD_MAX, F.array("__text")).otherwise(_blocks(F.col("__text")))
    staged = whole.withColumn("__parts", parts)
    packed = staged.select(*kept, "__parts", pack(F.transform("__parts", F.length)).alias("__packs"))
    # The outer form: Catalyst would repeat the packing in a filter below the plain one.
    pieces = packed.select(
        *kept, "__parts", F.size("__packs").alias("__n"), F.posexplode_outer("__packs").alias("sub_index", "__pack")
    ).filter("__pack is not null")
    pieces = pieces.select(
        *kept,
        "__n",
        "sub_index",
        F.array_join(F.slice("__parts", F.col("__pack.first") + 1, F.col("__pack.n")), JOINT).alias("__piece"),
    ).filter((F.length("__piece") >= MIN_CHUNK) | (F.col("__n") == 1))
    prefix = F.when((F.col("sub_index") == 0) & (F.coalesce("heading", F.lit("")) != ""), F.concat("heading", F.lit(JOINT)))
    return pieces.select(*kept, "sub_index", F.concat(F.coalesce(prefix, F.lit("")), "__piece").alias("chunk_text"))


def nest_paragraphs(paragraphs: DataFrame, key: str) -> DataFrame:
    """One row per document from one row per paragraph, in order."""
    collected = F.array_sort(F.collect_list(F.struct("paragraph_index", "text")))
    return paragraphs.groupBy(key).agg(collected.alias("paragraphs"))


def pack_paragraphs(docs: DataFrame) -> DataFrame:
    """Chunks of ``docs(..., paragraphs)``; adds ``start_index``, ``end_index``, ``piece``, ``chunk_text``.

    ``paragraphs`` is an array of ``(paragraph_index, text)``.  Consecutive
    paragraphs are packed to 2000 characters.  One above 2500 stands alone and
    is split at its blank lines; ``piece`` numbers its pieces.
    """
    kept = [c for c in docs.columns if c != "paragraphs"]
    trimmed = F.transform(
        "paragraphs", lambda p: F.struct(p["paragraph_index"].alias("i"), strip(p["text"]).alias("t"))
    )
    staged = docs.select(*kept, F.filter(trimmed, lambda p: p["t"] != "").alias("__p"))
    lengths = F.transform("__p", lambda p: F.length(p["t"]))
    packed = staged.select(*kept, "__p", F.explode_outer(pack(lengths, hard=HARD_MAX)).alias("__pack"))
    packed = packed.filter("__pack is not null")
    chunks = packed.select(*kept, F.slice("__p", F.col("__pack.first") + 1, F.col("__pack.n")).alias("__c"))
    chunks = chunks.select(
        *kept,
        F.col("__c")[0]["i"].alias("start_index"),
        F.element_at("__c", -1)["i"].alias("end_index"),
        F.array_join(F.col("__c.t"), JOINT).alias("__text"),
        F.size("__c").alias("__n"),
    )
    oversize = (F.col("__n") == 1) & (F.length("__text") > HARD_MAX)
    parts = F.when(oversize, _blocks(F.col("__text"))).otherwise(F.array("__text"))
    staged = chunks.withColumn("__parts", parts)
    packs = pack(F.transform("__parts", F.length))
    pieces = staged.select(
        *kept, "start_index", "end_index", "__parts", F.posexplode_outer(packs).alias("piece", "__pack")
    )
    return pieces.select(
        *kept,
        "start_index",
        "end_index",
        "piece",
        F.array_join(F.slice("__parts", F.col("__pack.first") + 1, F.col("__pack.n")), JOINT).alias("chunk_text"),
    )


def section_chunk_id(act: Column, number: Column, sub_index: Column) -> Column:
    return F.format_string("%s:s%s:%d", act.cast("string"), number.cast("string"), sub_index.cast("int"))


def paragraph_chunk_id(folder: Column, start: Column, end: Column, piece: Column) -> Column:
    """The pieces of a split paragraph after the first carry their number."""
    base = F.format_string("j:%s:p%d-p%d", folder.cast("string"), start.cast("int"), end.cast("int"))
    return F.when(piece > 0, F.concat(base, F.lit(":"), piece.cast("string"))).otherwise(base)


def with_chunk_ids(chunks: DataFrame, chunk_id: Column, version: str) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id).withColumn("corpus_version", F.lit(version))


def with_token_estimate(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    return df.withColumn("char_count", F.length(text)).withColumn("approx_token_count", token_estimate(F.col(text)))


def chunk_report(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per source type: documents, failed ones, chunks, documents without a chunk.

    ``docs(key, source_type, failed)``, ``chunks(key, ...)``.
    """
    produced = chunks.groupBy(key).agg(F.count("*").alias("__n"))
    joined = docs.join(produced, key, "left")
    n = F.coalesce("__n", F.lit(0))
    return joined.groupBy("source_type").agg(
        F.count("*").alias("records_in"),
        F.count_if("failed").alias("records_failed"),
        F.coalesce(F.sum(F.when(~F.col("failed"), n)), F.lit(0)).alias("chunks_out"),
        F.count_if(~F.col("failed") & (n == 0)).alias("zero_chunk_docs"),
    )
