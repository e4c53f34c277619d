"""Tables that stand in for a keyed document store: log, cache and counters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.ranking import latest_by_key

LOG_TTL_DAYS = 90
COUNTER_TTL_HOURS = 48


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Store the log partitioned by UTC day, so date windows prune folders.

    Rows are dealt by ranges of day and request whose sizes follow the data, so
    a busy day is written by as many tasks as it needs.
    """
    log.repartitionByRange("log_date", "request_id").write.mode(mode).partitionBy("log_date").parquet(path)


def read_log(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    return scan_log(spark.read.parquet(path), start, end)


def scan_log(log: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of an inclusive day range.  No per-day cap."""
    return log.filter(F.col("log_date").between(F.lit(start), F.lit(end)))


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins per key, by ``order`` over base and updates together."""
    return latest_by_key(base.unionByName(updates), keys, order)


def with_expiry(df: DataFrame, written_at: Column, ttl_seconds: int | None) -> DataFrame:
    expiry = F.lit(None).cast("timestamp") if ttl_seconds is None else written_at + F.make_dt_interval(
        secs=F.lit(ttl_seconds)
    )
    return df.withColumn("valid_until", expiry)


def live_rows(df: DataFrame, now: Column) -> DataFrame:
    """Rows without expiry or not past it; a row is live at its very expiry time."""
    return df.filter(F.col("valid_until").isNull() | (F.col("valid_until") >= now))


def apply_increments(
    counters: DataFrame,
    increments: DataFrame,
    keys: Sequence[str],
    now: Column,
    ttl_hours: int = COUNTER_TTL_HOURS,
) -> DataFrame:
    """Add amounts per key; an absent or expired counter starts afresh.

    ``counters(*keys, count, valid_until)`` and ``increments(*keys, amount)``.
    A live counter keeps its expiry, a fresh one gets ``now`` plus the TTL.
    """
    keys = list(keys)
    added = increments.groupBy(*keys).agg(F.sum("amount").cast("bigint").alias("__added"))
    joined = counters.join(added, keys, "full_outer")
    live = F.col("count").isNotNull() & (F.col("valid_until").isNull() | (F.col("valid_until") >= now))
    fresh = F.col("__added").isNotNull() & ~live
    return joined.select(
        *keys,
        F.when(fresh, F.col("__added")).otherwise(F.col("count") + F.coalesce("__added", F.lit(0))).cast("bigint").alias("count"),
        F.when(fresh, now + F.make_dt_interval(hours=F.lit(ttl_hours))).otherwise(F.col("valid_until")).alias("valid_until"),
    )


SCALARS = (T.StringType, T.BooleanType, T.NumericType)


def flatten_events(df: DataFrame) -> DataFrame:
    """Scalars stay, nulls stay, anything nested becomes a JSON string."""
    columns = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            columns.append(F.when(col.isNotNull(), F.to_json(col)).alias(field.name))
        elif isinstance(field.dataType, SCALARS):
            columns.append(col)
        else:
            columns.append(col.cast("string").alias(field.name))
    return df.select(*columns)


def write_events(df: DataFrame, path: str) -> None:
    """Flattened events as JSON lines."""
    flatten_events(df).write.mode("append").option("ignoreNullFields", "false").json(path)
