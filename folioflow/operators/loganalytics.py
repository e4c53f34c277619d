"""Query-log analytics: log rows, windows, summaries, quotas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.ranking import nearest_rank, top_k
from folioflow.functions.text import hashed_address, question_key, strip
from folioflow.sources.log_store import LOG_TTL_DAYS, scan_log, with_expiry
from folioflow.sources.files import staged

# Notional price per token, window limits, daily quotas.
INPUT_USD_PER_TOKEN = 1e-7
OUTPUT_USD_PER_TOKEN = 4e-7
DEFAULT_WINDOW_DAYS = 7
MAX_WINDOW_DAYS = 90
CLIENT_DAILY_LIMIT = 5
GLOBAL_DAILY_CAP = 200
MODEL_CALL_LIMIT = 180


def estimated_cost(prompt_tokens: Column, output_tokens: Column) -> Column:
    """Tokens times price; a missing count costs nothing."""
    zero = F.lit(0)
    return F.coalesce(prompt_tokens, zero) * F.lit(INPUT_USD_PER_TOKEN) + F.coalesce(output_tokens, zero) * F.lit(
        OUTPUT_USD_PER_TOKEN
    )


def build_query_log(responses: DataFrame) -> DataFrame:
    """Log rows from served responses.

    A rejected response has no answer, no citations, no tokens and no cost.
    """
    rejected = F.col("rejected")

    def kept(name: str, empty) -> Column:
        return F.when(rejected, empty).otherwise(F.col(name)).alias(name)

    types = dict(responses.dtypes)
    rows = responses.select(
        "request_id",
        "ts",
        F.to_date("ts").alias("log_date"),
        "hashed_ip",
        "question",
        "latency_ms",
        "rejected",
        kept("answer", F.lit(None).cast("string")),
        kept("citation_count", F.lit(0)),
        kept("cache_hit", F.lit(False)),
        kept("prompt_tokens", F.lit(None).cast(types["prompt_tokens"])),
        kept("output_tokens", F.lit(None).cast(types["output_tokens"])),
    )
    rows = rows.withColumn("estimated_cost_usd", estimated_cost(F.col("prompt_tokens"), F.col("output_tokens")))
    return with_expiry(rows, F.col("ts"), LOG_TTL_DAYS * 86_400)


def with_cost(log: DataFrame) -> DataFrame:
    """Log rows whose cost column is derived from the token counts."""
    cost = F.when(F.col("rejected"), F.lit(0.0)).otherwise(estimated_cost(F.col("prompt_tokens"), F.col("output_tokens")))
    return log.withColumn("estimated_cost_usd", cost)


def pseudonymize(df: DataFrame, salt: str) -> DataFrame:
    """Leftmost forwarded address, else the peer, else ``unknown``; salted hash and short form."""
    forwarded = strip(F.split_part(F.col("forwarded_for"), F.lit(","), F.lit(1)))
    address = F.coalesce(F.nullif(forwarded, F.lit("")), F.col("peer"), F.lit("unknown"))
    hashed = df.withColumn("hashed_ip", hashed_address(salt, address))
    return hashed.withColumn("hashed_ip_short", F.substring("hashed_ip", 1, 12))


def resolve_window(
    start: dt.date | None = None,
    end: dt.date | None = None,
    days: int | None = None,
    as_of: dt.date | None = None,
) -> tuple[dt.date, dt.date]:
    """Explicit inclusive range, else trailing UTC days ending at ``as_of``."""
    if start is not None and end is not None:
        if end < start:
            raise ValueError("end must not be before start")
        if (end - start).days + 1 > MAX_WINDOW_DAYS:
            raise ValueError(f"window is wider than {MAX_WINDOW_DAYS} days")
        return start, end
    days = DEFAULT_WINDOW_DAYS if days is None else days
    if days < 1 or days > MAX_WINDOW_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_WINDOW_DAYS}")
    last = as_of or dt.datetime.now(dt.timezone.utc).date()
    return last - dt.timedelta(days=days - 1), last


def log_window(log: DataFrame, start=None, end=None, days=None, as_of=None) -> DataFrame:
    return scan_log(log, *resolve_window(start, end, days, as_of))


def _counters() -> list[Column]:
    success = ~F.col("rejected")
    return [
        F.count("*").alias("total"),
        F.count_if(success).alias("successes"),
        F.count_if(F.col("rejected")).alias("rejections"),
        F.count_if(success & F.col("cache_hit")).alias("cache_hits"),
    ]


def _served_latency() -> Column:
    return F.when(~F.col("rejected"), F.col("latency_ms"))


def summary(log: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row of totals, rates, latency percentiles and cost for a day range."""
    rows = scan_log(log, start, end)
    totals = rows.agg(*_counters(), F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("estimated_cost_usd"))
    ranks = nearest_rank(rows.select(_served_latency().alias("latency_ms")), "latency_ms", (50, 95))
    percentiles = ranks.agg(
        F.max(F.when(F.col("percent") == 50, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("percent") == 95, F.col("value"))).alias("p95"),
    )

    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return totals.select(
        F.lit(start).alias("window_start"),
        F.lit(end).alias("window_end"),
        F.col("total").alias("total_queries"),
        F.col("successes").alias("total_successes"),
        F.col("rejections").alias("total_rejections"),
        F.col("cache_hits").alias("total_cache_hits"),
        rate("rejections", "total").alias("rejection_rate"),
        rate("cache_hits", "successes").alias("cache_hit_rate"),
        percentiles.select("p50").scalar().alias("p50_latency_ms"),
        percentiles.select("p95").scalar().alias("p95_latency_ms"),
        F.col("estimated_cost_usd").alias("total_estimated_cost_usd"),
    )


def daily_series(log: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per calendar day of the range, zero-filled; no latency on empty days."""
    spark = log.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("log_date"))
    days = (
        scan_log(log, start, end)
        .groupBy("log_date")
        .agg(*_counters(), F.avg(_served_latency()).alias("avg_latency_ms"), F.sum("estimated_cost_usd").alias("cost"))
    )
    zero = F.lit(0)
    return spine.join(days, "log_date", "left").select(
        "log_date",
        *[F.coalesce(c, zero).alias(c) for c in ("total", "successes", "rejections", "cache_hits")],
        "avg_latency_ms",
        F.coalesce("cost", F.lit(0.0)).alias("estimated_cost_usd"),
    )


def top_questions(log: DataFrame, n: int = 10) -> DataFrame:
    """Most asked questions; shown as first asked, ties to the one first seen."""
    asked = log.filter(F.col("question").isNotNull() & (F.col("question") != ""))
    seen = F.struct("ts", "request_id")
    return (
        asked.groupBy(question_key(F.col("question")).alias("question_key"))
        .agg(
            F.count("*").alias("asked"),
            F.min_by("question", seen).alias("question"),
            F.min(seen).alias("__first"),
        )
        .orderBy(F.desc("asked"), F.asc("__first"))
        .limit(n)
        .drop("__first")
    )


def recent(log: DataFrame, limit: int, offset: int, as_of: dt.date) -> DataFrame:
    """A page of the trailing week, newest first, with the total of the week."""
    rows = log_window(log, as_of=as_of)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("ts"), F.desc("request_id")).offset(offset).limit(limit)
    return page.select(
        "request_id",
        "ts",
        F.substring("hashed_ip", 1, 12).alias("hashed_ip_short"),
        "question",
        "rejected",
        "cache_hit",
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        "estimated_cost_usd",
        total.scalar().alias("total"),
    )


def admission(
    log: DataFrame,
    client_limit: int = CLIENT_DAILY_LIMIT,
    global_cap: int = GLOBAL_DAILY_CAP,
    call_limit: int = MODEL_CALL_LIMIT,
) -> DataFrame:
    """Replay the daily quotas: adds ``served`` and the ``refused_by`` gate.

    Gates per UTC day, in order: in-scope requests per client, served requests
    overall, model calls (in scope, not from the cache).  Refused requests use
    up nothing.  Once a gate closes it stays closed for the day, so each gate
    is the time of the request that used up its last unit: no ordered window
    over a whole client or day is needed, only the first few rows of each.
    """
    at = F.struct("ts", "request_id")
    rows = log.withColumn("__at", at)
    in_scope = ~F.col("rejected")

    def closing(df: DataFrame, by: list[str], limit: int, name: str) -> DataFrame:
        """Per group, the request that used up the limit, if there was one."""
        firsts = top_k(df, by, [F.col("__at")], limit)
        return firsts.filter(F.col("rank") == limit).select(*by, F.col("__at").alias(name))

    # Requests past the client gate, were there no other gate.
    slim = rows.select("log_date", "hashed_ip", "__at", "rejected", "cache_hit")
    quota = closing(slim.filter(in_scope), ["log_date", "hashed_ip"], client_limit, "__quota")
    passed = slim.join(quota, ["log_date", "hashed_ip"], "left").filter(
        F.col("__quota").isNull() | (F.col("__at") <= F.col("__quota"))
    )
    # At most `global_cap` rows per day are left from here on.
    # Written once, since all gates are derived from them.
    heads = staged(top_k(passed, ["log_date"], [F.col("__at")], global_cap).drop("rank", "__quota"), "admission-heads")
    is_call = in_scope & ~F.col("cache_hit")
    budget = closing(heads.filter(is_call), ["log_date"], call_limit, "__budget")
    served = (
        heads.join(budget, "log_date", "left")
        .filter(F.col("__budget").isNull() | (F.col("__at") <= F.col("__budget")))
        .drop("__budget")
    )
    # Exact gate closings, counted over served requests only.
    client_gate = closing(served.filter(in_scope), ["log_date", "hashed_ip"], client_limit, "__client")
    day_gates = served.groupBy("log_date").agg(
        F.when(F.count("*") >= global_cap, F.max("__at")).alias("__cap"),
        F.when(
            F.count_if(is_call) >= call_limit, F.max(F.when(is_call, F.col("__at")))
        ).alias("__calls"),
    )
    gated = rows.join(client_gate, ["log_date", "hashed_ip"], "left").join(day_gates, "log_date", "left")
    refused = (
        F.when(F.col("__at") > F.col("__client"), "client_quota")
        .when(F.col("__at") > F.col("__cap"), "global_cap")
        .when(F.col("__at") > F.col("__calls"), "model_budget")
    )
    return gated.select(*log.columns, refused.isNull().alias("served"), refused.alias("refused_by"))
