"""Registered streaming queries: run to the end of the input, return the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.operators import loganalytics as la
from folioflow.operators import retrieve
from folioflow.plans.logs import COST, DAILY_COUNTS, rounded
from folioflow.session import stage_path
from folioflow.streaming import jobs


# Slices of the log, in time order; each arrives as a micro-batch of its own.
SLICES = 4


def in_slices(spark, sf, run) -> None:
    """Let the events table arrive slice by slice: ``run(log, checkpoint)`` after each, as one job that goes on."""
    events = fx.table(spark, sf, "events")
    path, checkpoint = stage_path(spark, "events-in"), stage_path(spark, "stream-checkpoint")
    first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events.limit(0).write.parquet(path)
    source = spark.readStream.schema(events.schema).parquet(path)
    log = fx.project_query_log(source).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(SLICES):
        low, high = (first + (last + 1 - first) * k // SLICES for k in (i, i + 1))
        events.filter((at >= low) & (at < high)).write.mode("append").parquet(path)
        run(log, checkpoint)


def daily(spark, sf):
    path, kept = stage_path(spark, "daily"), {}

    def run(log, checkpoint):
        days = jobs.stream_daily(la.with_cost(log))
        jobs.upsert_stream(days, path, ["log_date"], mode="update", checkpoint=checkpoint)
        kept["schema"] = days.schema

    in_slices(spark, sf, run)
    return rounded(jobs.read_upserts(spark, path, kept["schema"], ["log_date"]), estimated_cost_usd=8)


def drained(spark, sf, name, build):
    path, kept = stage_path(spark, name), {}

    def run(log, checkpoint):
        rows = build(log)
        jobs.drain(rows, path, checkpoint=checkpoint)
        kept["schema"] = rows.schema

    in_slices(spark, sf, run)
    return spark.read.schema(kept["schema"]).parquet(path)


def quota(spark, sf):
    return drained(spark, sf, "quota", jobs.stream_quota).select("request_id", "log_date", "hashed_ip")


def quota_by_batch(spark, sf):
    path, kept = stage_path(spark, "quota"), {}

    def run(log, checkpoint):
        kept["rows"] = jobs.quota_batches(log, path, checkpoint=checkpoint)

    in_slices(spark, sf, run)
    return kept["rows"].select("request_id", "log_date", "hashed_ip")


def dedup(spark, sf):
    def once(log):
        repeated = log.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("request_id") % 3).cast("int"))))
        return jobs.stream_dedup(repeated.drop("copy"))

    return drained(spark, sf, "dedup", once).select("request_id", "log_date", "question")


def upsert(spark, sf):
    path, kept = stage_path(spark, "answers"), {}

    def run(log, checkpoint):
        answers = retrieve.with_cache_key(log.filter("not rejected"), "question").select(
            "cache_key", F.concat(F.lit("a"), F.col("request_id").cast("string")).alias("answer_text"), "ts", "request_id"
        )
        jobs.upsert_stream(answers, path, ["cache_key"], ["ts", "request_id"], checkpoint=checkpoint)
        kept["schema"] = answers.schema

    in_slices(spark, sf, run)
    current = jobs.read_upserts(spark, path, kept["schema"], ["cache_key"], ["ts", "request_id"])
    return current.select("cache_key", "answer_text")


ADMITTED = fx.duck("query_log", body="""select request_id, log_date, hashed_ip from (select *, row_number() over (partition by log_date, hashed_ip order by ts, request_id) as rn
 from query_log where not rejected) where rn <= 5""")

PLANS = {
    "s1_stream_daily": (
        daily,
        fx.duck("query_log", body=f"""select log_date, {DAILY_COUNTS}, round(sum(case when rejected then 0 else {COST} end), 8) as estimated_cost_usd
 from query_log group by log_date"""),
    ),
    "s2_stream_quota": (quota, ADMITTED),
    "s2_quota_batches": (quota_by_batch, ADMITTED),
    "s3_stream_dedup": (dedup, fx.duck("query_log", body="select request_id, log_date, question from query_log")),
    "s4_stream_upsert": (
        upsert,
        fx.duck("query_log", body="""with w as (select *, sha256(regexp_replace(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), '[.!?,;:]+$', '')) as cache_key from query_log where not rejected)
 select cache_key, 'a' || request_id as answer_text from (select *, row_number() over (partition by cache_key order by ts desc, request_id desc) as rn from w) where rn = 1"""),
    ),
}
