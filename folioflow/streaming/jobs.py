"""Streaming forms of the log jobs: daily counters, quotas, de-duplication, upserts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.functions.ranking import latest_by_key, top_k
from folioflow.operators.loganalytics import CLIENT_DAILY_LIMIT
from folioflow.session import stage_path
from folioflow.sources.log_store import COUNTER_TTL_HOURS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_daily(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily counters over UTC days; rows later than ``delay`` behind are dropped.

    ``log`` carries ``estimated_cost_usd``.  Run it in update mode into
    ``upsert_stream`` keyed by ``log_date``.
    """
    success = ~F.col("rejected")
    days = log.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(
        F.count("*").alias("total"),
        F.count_if(success).alias("successes"),
        F.count_if(F.col("rejected")).alias("rejections"),
        F.count_if(success & F.col("cache_hit")).alias("cache_hits"),
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
    )
    return days.select(F.to_date("window.start").alias("log_date"), *days.columns[1:])


# Rows a map task holds while it cuts; more keys than that go on to the shuffle.
HELD = 200_000
# Clients of a day are kept in so many states, each a list of counts.
BUCKETS = 2048


def _firsts(frame: pd.DataFrame, keys: Sequence[str], limit: int) -> pd.DataFrame:
    """The first ``limit`` rows of each key by time and id, in that order."""
    ordered = frame.iloc[np.lexsort((frame["request_id"].to_numpy(), frame["ts"].to_numpy()))]
    return ordered.groupby(list(keys), sort=False, dropna=False).head(limit)


def cut_frames(frames: Iterator[pd.DataFrame], keys: Sequence[str], limit: int) -> Iterator[pd.DataFrame]:
    """The first ``limit`` rows of each key within every stretch of up to ``HELD`` rows kept.

    Frames are cut alone, and together only once enough has come, so each row is
    sorted a few times, whatever the number of keys.
    """
    held, size = [], 0
    for frame in frames:
        held.append(_firsts(frame, keys, limit))
        size += len(held[-1])
        if size > HELD:
            merged = _firsts(pd.concat(held, ignore_index=True), keys, limit)
            held, size = [merged], len(merged)
            if size > HELD // 2:
                yield merged
                held, size = [], 0
    if held:
        yield _firsts(pd.concat(held, ignore_index=True), keys, limit)


def first_by_task(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Of what a map task reads of each key, the first ``limit`` rows by time and id.

    The later ones cannot be among the first of the key.  A client with any share
    of a micro-batch so sends ``limit`` rows per task to its state.  A task whose
    rows have too many keys to hold passes on what it has, and starts anew.
    """
    return rows.mapInPandas(lambda frames: cut_frames(frames, keys, limit), rows.schema)


class DailyQuota(StatefulProcessor):
    """Requests of the clients of a (day, bucket) in time order until the limit of each; a timer clears the counts after the day."""

    def __init__(self, limit: int, columns: Sequence[str]):
        self.limit, self.columns = limit, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = T.StructType().add("clients", T.ArrayType(T.StringType())).add("n", T.ArrayType(T.LongType()))
        self.used = handle.getValueState("used", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.used.exists()
        used = dict(zip(*self.used.get())) if known else {}
        held = None
        for frame in rows:
            held = _firsts(frame if held is None else pd.concat([held, frame], ignore_index=True), ["hashed_ip"], self.limit)
        before = np.array([used.get(client, 0) for client in held["hashed_ip"]])
        admitted = held[held.groupby("hashed_ip", sort=False, dropna=False).cumcount().to_numpy() < self.limit - before]
        for client in admitted["hashed_ip"]:
            used[client] = used.get(client, 0) + 1
        if not known:
            day_end = dt.datetime.combine(key[0], dt.time(), dt.timezone.utc) + dt.timedelta(days=1)
            expiry = int((day_end + dt.timedelta(hours=COUNTER_TTL_HOURS)).timestamp() * 1000)
            self.handle.registerTimer(max(expiry, timerValues.getCurrentWatermarkInMs() + 1))
        self.used.update((list(used), list(used.values())))
        if len(admitted):
            yield admitted[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_quota(log: DataFrame, limit: int = CLIENT_DAILY_LIMIT, delay: str = "1 day") -> DataFrame:
    """In-scope requests within the daily quota of their client.

    State are the numbers of requests admitted, by client and day; those of a day are
    kept in ``BUCKETS`` lists, so that a call into Python and a state access serve
    many clients.  An event-time timer clears a list 48 hours after the day.  Within a micro-batch requests count
    in time order.  Map tasks cut each key to its first ``limit`` rows ahead of the
    shuffle, so no key is more than that many rows per task.  The state lives in
    RocksDB, which ``transformWithState`` needs.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keys = ["hashed_ip", "log_date"]
    output = T.StructType([log.schema[c] for c in (*keys, "request_id", "ts")])
    in_scope = log.filter(~F.col("rejected")).select(*output.fieldNames())
    firsts = first_by_task(in_scope, keys, limit).withWatermark("ts", delay)
    firsts = firsts.withColumn("bucket", F.pmod(F.xxhash64("hashed_ip"), F.lit(BUCKETS)))
    return firsts.groupBy("log_date", "bucket").transformWithStateInPandas(
        DailyQuota(limit, output.fieldNames()), output, outputMode="append", timeMode="EventTime"
    )


def quota_batches(
    log: DataFrame, path: str, limit: int = CLIENT_DAILY_LIMIT, checkpoint: str | None = None
) -> DataFrame:
    """The same quota with native operators per micro-batch; for bulk loads.

    The rows admitted so far are the state: each batch counts those of earlier
    batches, and a replayed batch overwrites its own folder.  Only the first
    few rows of a client and day leave a map task.  Expiry is the removal of
    old ``log_date`` folders.  Returns the admitted rows.
    """
    spark = log.sparkSession
    keys = ["hashed_ip", "log_date"]
    rows = log.filter(~F.col("rejected")).select(*keys, "request_id", "ts")
    full = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])
    # An empty first folder, so that the first batch finds a table.
    spark.createDataFrame([], rows.drop("log_date").schema).write.mode("overwrite").parquet(f"{path}/batch_id=-1/log_date=1970-01-01")

    def write(batch: DataFrame, batch_id: int) -> None:
        # The few days of this batch prune the folders of all others.
        days = [r[0] for r in batch.select("log_date").distinct().collect()]
        earlier = batch.sparkSession.read.schema(full).parquet(path)
        earlier = earlier.filter((F.col("batch_id") < batch_id) & F.col("log_date").isin(days))
        used = earlier.groupBy(*keys).agg(F.count("*").alias("__used"))
        firsts = top_k(batch, keys, [F.asc("ts"), F.asc("request_id")], limit)
        free = F.lit(limit) - F.coalesce("__used", F.lit(0))
        admitted = firsts.join(used, keys, "left").filter(F.col("rank") <= free).select(*batch.columns)
        admitted.write.mode("overwrite").partitionBy("log_date").parquet(f"{path}/batch_id={batch_id}")

    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or stage_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(full).parquet(path).drop("batch_id")


def stream_dedup(log: DataFrame, key: str = "request_id", delay: str = "1 day") -> DataFrame:
    """One row per request, however often it is delivered within ``delay``."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Append a stream to a Parquet folder until its input is used up."""
    checkpoint = checkpoint or stage_path(stream.sparkSession, "stream-checkpoint")
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def upsert_stream(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str] = (),
    mode: str = "append",
    checkpoint: str | None = None,
) -> None:
    """Keyed upserts from a stream: each micro-batch adds one folder of changes.

    A replayed batch overwrites its own folder, so retries change nothing, and
    a batch costs what it brings, not the size of the table.  ``read_upserts``
    merges on read; ``compact_upserts`` folds the batches into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        changes = latest_by_key(batch, keys, order) if order else batch
        changes.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint or stage_path(stream.sparkSession, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_upserts(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Current rows: per key the last by ``order``, then by batch."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    return latest_by_key(rows, keys, [*order, "batch_id"]).drop("batch_id")


def compact_upserts(
    spark: SparkSession, path: str, target: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str] = ()
) -> None:
    """Current rows as a single batch below ``target``; the source stays as it is."""
    read_upserts(spark, path, schema, keys, order).write.mode("overwrite").parquet(f"{target}/batch_id=0")
