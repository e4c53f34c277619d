"""Mixing sources to target weights by whole and fractional repetition.

Words are counted per document and added up per source.  Targets share all
words by weight and stop at ``max_repeats`` times what a source has; the excess
is shared again by weight.  That is one water level: ``target = min(weight *
level, max_repeats * words)``, found by raising the level until no further
source stops.  A source's rate is its target over its words: every document is
taken ``floor(rate)`` times, plus one copy by a hash-seeded draw that comes up
with the rate's fraction as probability.

Draws are systematic.  A source has one offset, uniform by the hash of its name,
and its documents stand in an order of their size class and the hash of their
id.  The document at place r gets the copy where ``r * fraction + offset`` passes a
whole number on the way to the next place: with exactly the fraction as its
probability over the offset, and each stretch of the order, so each class of
sizes, with its share to within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import NON_SPACES, staged, table, text_or_empty

# The weights, repeated along the sources in code point order.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
# Places are counted in this many slices of a size class first, so no task sees a whole source.
SLICES = 256


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(NON_SPACES)).cast("long")


def ranked_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """A weight per source by its rank in code point order, null last.

    Ranks come from a range partitioned sort: rows are numbered within their
    partition and shifted by the sizes of the partitions before, so no task
    sees all sources.
    """
    spread = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    spread = staged(spread, "mix-sources")
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(inside) - 1 + F.col("_shift")).cast("long")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return spread.join(F.broadcast(shift), "_part").select(
        "source", "source_size", F.element_at(cycle, (rank % len(weights)).cast("int") + 1).cast("long").alias("weight")
    )


def water_level(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> tuple[int, int]:
    """The level as a fraction (words, weight): each round two sums come back, a handful of rounds in all.

    A source stops where ``max_repeats * words <= weight * level``.  Stopping a
    source only raises the level of the rest, so the stopped set grows until it
    is final; with all stopped or no words the level is (0, 0).
    """
    cap = F.col("source_size") * max_repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    words, weight = None, None
    while True:
        stops = F.lit(False) if words is None else cap * F.lit(weight) <= F.col("weight") * F.lit(words)
        row = sources.agg(
            F.sum(F.when(stops, cap).otherwise(0)).alias("capped"), F.sum(F.when(stops, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        found = (total - int(row.capped or 0), int(row.open or 0))
        if found == (words, weight) or found[1] == 0:
            return found
        words, weight = found


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, weight, target from (source, size) rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = staged(ranked_weights(sources, weights), "mix-weights")
    words, weight = water_level(weighed, max_repeats)
    cap = (F.col("source_size") * max_repeats).cast("double")
    if weight == 0:
        target = cap
    else:
        share = F.col("weight") * F.lit(words)
        target = F.when(F.col("source_size") * max_repeats * F.lit(weight) <= share, cap).otherwise(share.cast("double") / F.lit(float(weight)))
    return weighed.withColumn("target", target)


def _draw(key: Column) -> Column:
    """32 bits of the md5 digest."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Sizes by their three leading bits."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)))).cast("long")


def with_places(sizes: DataFrame) -> DataFrame:
    """``place``: rank from 0 of (size class, draw, id) within the source; rows that agree in all share it.

    Slices of a class are counted with a map-side combine, ranks are only
    sorted within a slice, and a window adds up the few slices before.
    """
    keyed = sizes.withColumn("_draw", _draw(F.col("doc_id"))).withColumn("_class", size_class(F.col("size")))
    keyed = keyed.withColumn("_slice", F.col("_class") * SLICES + F.shiftright("_draw", 24))
    counts = keyed.groupBy("source", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(F.col("source").alias("_s"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_slice").orderBy("_draw", "doc_id")
    ranked = keyed.withColumn("_within", F.rank().over(within) - 1)
    joined = ranked.join(carried, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_at")))
    return joined.select(*sizes.columns, (F.col("_before") + F.col("_within")).alias("place"))


def repetitions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Null texts have no words; a null source is a source of its own, the last in
    order.  Rows that agree in id, source and size draw alike.  Documents without
    words get the copies of their source.  A source without words has target 0
    and its documents are taken 0 times.  An empty table gives no rows, a long
    text is counted whole, other columns are not looked at.
    """
    sizes = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "mix-sizes"
    )
    # Renamed before it meets `sizes`, from which it derives.
    targets = staged(source_targets(sizes, weights, max_repeats), "mix-targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = with_places(sizes).join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", rate)
    part = F.col("_rate") - F.floor("_rate")
    offset = _draw(F.col("source")) / F.lit(2.0**32)
    extra = F.floor((F.col("place") + 1) * part + offset) > F.floor(F.col("place") * part + offset)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.floor("_rate") + extra.cast("long")).alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with ``copy_no`` from 0.

    Only ids and copy numbers are joined to the texts.  Ids should be unique;
    rows that share an id all get the copies of that id, which are the same for
    each source.  An own column ``copy_no`` of ``docs`` is replaced.
    """
    plan = repetitions(docs, id_col, **options).filter("copies > 0")
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.max("copies").alias("_copies"))
    source = options.get("source_col", "source")
    docs = docs.drop("copy_no")
    joined = docs.join(plan.hint("shuffle_merge"), F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("copy_no"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return repetitions(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP4_SQL = r"""
with recursive sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), src as (
  select source, sum(size)::bigint as source_size from sizes group by source
), w as (
  select source, source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::bigint as weight
  from src
), capped as (
  -- sources in the order in which a rising level reaches their limit
  select *, sum(3 * source_size) over o as cap_sum, sum(weight) over o as weight_sum from w
  window o as (order by 3.0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), tot as (select sum(source_size)::bigint as words, sum(weight)::bigint as weights from w),
level as (
  -- the first source that is not stopped fixes the level
  select (words - coalesce(cap_sum, 0))::bigint as words, (weights - coalesce(weight_sum, 0))::bigint as weight
  from capped, tot
  where 3 * source_size * (weights - coalesce(weight_sum, 0)) > weight * (words - coalesce(cap_sum, 0))
  order by 3.0 * source_size / weight, source nulls last limit 1
), target as (
  select w.source, w.source_size,
    case when 3 * w.source_size * level.weight <= w.weight * level.words then (3 * w.source_size)::double
         else (w.weight * level.words)::double / level.weight::double end as target
  from w, level
), rated as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size::double else 0.0 end as rate,
    ('0x' || substr(md5(coalesce(d.doc_id::varchar, 'null')), 1, 8))::bigint as draw,
    ('0x' || substr(md5(coalesce(d.source, 'null')), 1, 8))::bigint / 4294967296.0::double as first
  from sizes d join target t on d.source is not distinct from t.source
), placed as (
  select *, rank() over (partition by source order by len(bin(size)) * 8 + (size >> greatest(len(bin(size)) - 3, 0)), draw, doc_id) - 1 as place,
    rate - floor(rate) as part
  from rated
)
select doc_id, size, source_size, target,
  ((floor(rate)::bigint + (floor((place + 1) * part + first) > floor(place * part + first))::bigint) * size)::bigint as taken
from placed
"""
