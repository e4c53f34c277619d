"""Top-k, latest-per-key and nearest-rank selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import stage_path


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, ranked from 1.

    Catalyst places a partial group limit below the shuffle, so a group sends
    at most ``k`` rows per map task whatever its size.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    An aggregate rather than a window: partial aggregation keeps a hot key at
    one row per map task.
    """
    return _pick_by_key(df, keys, order, F.max_by)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order``."""
    return _pick_by_key(df, keys, order, F.min_by)


def _pick_by_key(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


# Buckets a bracket is cut into; a round narrows it at least that much.
BUCKETS = 4096
LARGEST = 1.7976931348623157e308


def _same_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    """Null keys are a group like others."""
    condition = F.lit(True)
    for c in by:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = stage_path(df.sparkSession, "order-statistics")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket(value: str, low: str, high: str) -> Column:
    """Which of ``BUCKETS`` parts of ``low .. high`` a value is in; never falls as the value grows.

    Parts are equally wide, of the logarithm where the bracket spans magnitudes.
    Should both ends be the same double, the difference in the column's own type
    tells them apart.  ``low`` is in the first part and ``high`` in the last.
    Written as SQL text, which is one call to the JVM.
    """

    def double(c: str) -> str:
        # Halved, so no difference overflows.
        return f"(greatest(least(cast({c} as double), {LARGEST}D), -{LARGEST}D) / 2)"

    def share(v: str, lo: str, hi: str) -> str:
        return f"least(cast(floor(({v} - {lo}) / ({hi} - {lo}) * {BUCKETS}) as int), {BUCKETS - 1})"

    v, lo, hi = double(value), double(low), double(high)
    logs = [f"asinh({x})" for x in (v, lo, hi)]
    wide = f"{hi} - {lo} > 1024 * least(abs({lo}), abs({hi})) and {hi} - {lo} > {BUCKETS} and {logs[1]} < {logs[2]}"
    close = share(f"cast({value} - {low} as double)", "0D", f"cast({high} - {low} as double)")
    return F.expr(f"case when {wide} then {share(*logs)} when {lo} < {hi} then {share(v, lo, hi)} when {value} = {low} then 0 else {close} end")


def _constant(brackets: list, kind: T.ArrayType) -> Column:
    return F.array(*[F.struct(*[F.lit(b[f.name]).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]) for b in brackets])


def order_statistics(
    df: DataFrame,
    col: str,
    wanted: dict[str, tuple[float, Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact order statistics of a column, per group: ``(*by, statistic, value)``.

    ``wanted`` maps a name to ``(fraction, rank)``, the rank being a 0-based
    expression over the group size ``n``.  Null and NaN are no values; groups
    without values give no row, a null key is a group.

    Nothing is sorted and no group meets in one task: a bracket per group and
    statistic starts at all values, every round counts the values of its buckets
    with a map-side combine, and the bucket that holds the rank is the next
    bracket, from its least to its largest value.  A bracket of one value is the
    result.  Values outside all brackets are left behind, so later rounds read
    little.  The driver sees whether brackets are open, and without groups the
    brackets themselves.
    """
    by = list(by)
    values = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(*by, F.col(col).alias("__v"))
    ends = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).filter("n > 0")
    start = [F.struct(F.lit(name).alias("statistic"), rank.cast("bigint").alias("rank"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi")) for name, (_, rank) in wanted.items()]
    first = ends.select(*by, F.array(*start).alias("brackets"))
    if not by:
        return _single_statistics(values, first)
    state = staged(first)
    is_open = F.exists("brackets", lambda x: x["lo"] < x["hi"])
    more = state.filter(is_open).limit(1).count()
    while more:
        side = state.filter(is_open)
        inside = values.join(side, _same_keys(values, side, by)).select(*[values[c] for c in by], "__v", "brackets")
        inside, narrowed = _narrowed(inside, by)
        closed = state.select(*by, F.explode("brackets").alias("b")).filter("not b.lo < b.hi")
        state = staged(closed.unionByName(narrowed).groupBy(*by).agg(F.collect_list("b").alias("brackets")))
        more = state.filter(is_open).limit(1).count()
        if more:
            values = staged(inside.select(*by, "__v"))
    return state.select(*by, F.explode("brackets").alias("b")).select(*by, "b.statistic", F.col("b.lo").alias("value"))


def _single_statistics(values: DataFrame, first: DataFrame) -> DataFrame:
    """``(statistic, value)`` without groups: one job a round, its brackets are constants of the next plan."""
    kind = first.schema["brackets"].dataType
    row = first.first()
    brackets = list(row.brackets) if row else []
    while any(b.lo < b.hi for b in brackets):
        inside, narrowed = _narrowed(values.withColumn("brackets", _constant(brackets, kind)), [])
        # One row a statistic.
        brackets = [b for b in brackets if not b.lo < b.hi] + [r.b for r in narrowed.collect()]
        if any(b.lo < b.hi for b in brackets):
            values = staged(inside.select("__v"))
    known = values.sparkSession.range(1).select(F.explode(_constant(brackets, kind) if brackets else F.array().cast(kind)).alias("b"))
    return known.select("b.statistic", F.col("b.lo").alias("value"))


def _narrowed(inside: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Values in open brackets, and for each of these the bucket that holds its rank as the next bracket ``(*by, b)``."""
    reach = "x -> x.lo < x.hi and __v between x.lo and x.hi"
    inside = inside.filter(f"exists(brackets, {reach})").select(*by, "__v", F.expr(f"filter(brackets, {reach}) as brackets"))
    placed = inside.select(*by, "__v", F.explode("brackets").alias("b")).withColumn("bucket", _bucket("__v", "b.lo", "b.hi"))
    counted = placed.groupBy(*by, "b", "bucket").agg(F.count("*").alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # At most BUCKETS entries a bracket.
    listed = counted.groupBy(*by, "b").agg(F.expr("sort_array(collect_list(struct(bucket, c, lo, hi))) as parts"))
    kind = inside.schema["__v"].dataType.simpleString()
    found = f"""aggregate(parts, struct(b.rank as left, cast(null as struct<rank:bigint,lo:{kind},hi:{kind}>) as hit), (s, x) -> struct(
        s.left - x.c as left,
        case when s.hit is null and s.left < x.c then struct(s.left as rank, x.lo as lo, x.hi as hi) else s.hit end as hit)).hit"""
    narrowed = listed.select(*by, F.col("b.statistic").alias("statistic"), F.expr(found).alias("hit"))
    return inside, narrowed.select(*by, F.struct("statistic", "hit.rank", "hit.lo", "hit.hi").alias("b"))


def nearest_rank(df: DataFrame, col: str, percents: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles ``(*by, percent, value)``.

    The value at position ``round_half_even(p/100 * (n-1))`` of the sorted
    column; neither interpolated nor ``percentile_disc``.
    """
    wanted = {str(p): (p / 100, F.bround(F.lit(p / 100) * (F.col("n") - 1))) for p in percents}
    stats = order_statistics(df, col, wanted, by)
    return stats.select(*by, F.col("statistic").cast("int").alias("percent"), "value")


def median(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Median ``(*by, median)``: the mean of the two middle values of an even count."""
    last = F.col("n") - 1
    wanted = {"low": (0.5, F.floor(last / 2)), "high": (0.5, F.ceil(last / 2))}
    stats = order_statistics(df, col, wanted, by)
    if by:
        stats = stats.groupBy(*by)
    return stats.agg(F.avg("value").alias("median"))
