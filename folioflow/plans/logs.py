"""Registered queries over the log fixture, each with its DuckDB twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.functions.ranking import nearest_rank
from folioflow.operators import loganalytics as la
from folioflow.sources import log_store as store

START, END, AS_OF = dt.date(2024, 1, 3), dt.date(2024, 1, 25), dt.date(2024, 1, 30)
COST = "coalesce(prompt_tokens, 0) * 1e-7 + coalesce(output_tokens, 0) * 4e-7"


def rounded(df, **digits):
    for name, n in digits.items():
        df = df.withColumn(name, F.round(name, n))
    return df


def costed_log(spark, sf):
    return la.with_cost(fx.query_log(spark, sf))


def scan_window(spark, sf):
    return store.scan_log(fx.query_log(spark, sf), dt.date(2024, 1, 10), dt.date(2024, 1, 20)).select(
        "request_id", "log_date", "question", "latency_ms"
    )


def upsert(spark, sf):
    orders = fx.table(spark, sf, "orders")
    base = orders.selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "1 as version")
    updates = orders.filter("o_orderkey % 3 = 0").selectExpr(
        "o_orderkey", "'U' as o_orderstatus", "o_totalprice + 10 as o_totalprice", "2 as version"
    )
    late = orders.filter("o_orderkey % 5 = 0").selectExpr(
        "o_orderkey + 100000000 as o_orderkey", "'N' as o_orderstatus", "o_totalprice", "3 as version"
    )
    return rounded(
        store.upsert_latest(base, updates.unionByName(late), ["o_orderkey"], ["version"]), o_totalprice=2
    )


def ttl_rows(spark, sf):
    log = fx.query_log(spark, sf)
    expiring = store.with_expiry(log.filter("not cache_hit"), F.col("ts"), 48 * 3600)
    lasting = store.with_expiry(log.filter("cache_hit"), F.col("ts"), None)
    now = F.lit(dt.datetime(2024, 1, 15, 12)).cast("timestamp")
    return store.live_rows(expiring.unionByName(lasting), now).select("request_id", "log_date", "valid_until")


def counters(spark, sf):
    log = fx.query_log(spark, sf)
    now = F.to_timestamp(F.lit("2024-01-16 12:00:00"))
    base = (
        log.filter("ts < timestamp '2024-01-16 12:00:00'")
        .groupBy("hashed_ip", "log_date")
        .agg(F.count("*").alias("count"))
        .withColumn("valid_until", F.col("log_date").cast("timestamp") + F.expr("interval 48 hours"))
    )
    increments = log.filter("ts >= timestamp '2024-01-16 12:00:00'").selectExpr(
        "hashed_ip", "date_sub(log_date, 6) as log_date", "1 as amount"
    )
    return store.apply_increments(base, increments, ["hashed_ip", "log_date"], now)


def flat_events(spark, sf):
    events = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "event_type",
        "case when event_id % 4 = 0 then null else value end as value",
        "named_struct('user', user_id, 'kind', event_type) as actor",
        "array(event_type, cast(user_id as string)) as tags",
    )
    return store.flatten_events(events)


def built_log(spark, sf):
    responses = fx.table(spark, sf, "events").selectExpr(
        "event_id as request_id",
        "ts",
        "sha2(cast(user_id as string), 256) as hashed_ip",
        "concat('topic ', get_json_object(props, '$.k')) as question",
        "value * 10 as latency_ms",
        "event_type = 'error' as rejected",
        "concat('answer ', cast(event_id as string)) as answer",
        "cast(event_id % 6 as int) as citation_count",
        "event_type in ('view', 'error') as cache_hit",
        "case when event_id % 5 = 0 then null else cast(200 + event_id % 800 as int) end as prompt_tokens",
        "case when event_id % 3 = 0 then null else cast(50 + event_id % 300 as int) end as output_tokens",
    )
    return rounded(la.build_query_log(responses), estimated_cost_usd=9, latency_ms=4)


def pseudonyms(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        """case event_id % 5 when 0 then concat(' 10.0.0.', cast(user_id % 250 as string), ' , 172.16.0.1')
             when 1 then '' when 2 then ' , 1.2.3.4' when 3 then concat('10.1.1.', cast(user_id % 250 as string)) end as forwarded_for""",
        "case when event_id % 2 = 0 then concat('192.168.0.', cast(user_id % 250 as string)) end as peer",
    )
    return la.pseudonymize(rows, "fixture-salt").select("event_id", "hashed_ip", "hashed_ip_short")


def window_rows(spark, sf):
    log = fx.query_log(spark, sf)
    trailing = la.log_window(log, days=10, as_of=AS_OF).select("request_id", "log_date", F.lit("trailing").alias("kind"))
    explicit = la.log_window(log, start=START, end=END).select("request_id", "log_date", F.lit("explicit").alias("kind"))
    return trailing.unionByName(explicit)


def log_summary(spark, sf):
    out = la.summary(costed_log(spark, sf), START, END)
    return rounded(out, rejection_rate=6, cache_hit_rate=6, p50_latency_ms=6, p95_latency_ms=6, total_estimated_cost_usd=8)


def daily(spark, sf):
    # The range runs past the data, so empty days show.
    out = la.daily_series(costed_log(spark, sf), dt.date(2024, 1, 20), dt.date(2024, 2, 5))
    return rounded(out, avg_latency_ms=6, estimated_cost_usd=8)


def top(spark, sf):
    return la.top_questions(la.log_window(fx.query_log(spark, sf), start=START, end=END), 10)


def percentiles(spark, sf):
    log = fx.query_log(spark, sf).filter("not rejected")
    return rounded(nearest_rank(log, "latency_ms", (50, 95, 99), by=["log_date"]), value=6)


def recent_page(spark, sf):
    return rounded(la.recent(costed_log(spark, sf), 50, 20, AS_OF), latency_ms=6, estimated_cost_usd=9)


def replay(spark, sf):
    return la.admission(fx.query_log(spark, sf)).select("request_id", "log_date", "served", "refused_by")


DAILY_COUNTS = """count(*) as total, count(*) filter (not rejected) as successes,
 count(*) filter (rejected) as rejections, count(*) filter (not rejected and cache_hit) as cache_hits"""

PLANS = {
    "a6_scan_log": (
        scan_window,
        fx.duck("query_log", body="""select request_id, log_date, question, latency_ms from query_log
 where log_date between date '2024-01-10' and date '2024-01-20'"""),
    ),
    "a7_upsert_latest": (
        upsert,
        """select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice, version from (
 select *, row_number() over (partition by o_orderkey order by version desc) as rn from (
  select o_orderkey, o_orderstatus, o_totalprice, 1 as version from orders
  union all select o_orderkey, 'U', o_totalprice + 10, 2 from orders where o_orderkey % 3 = 0
  union all select o_orderkey + 100000000, 'N', o_totalprice, 3 from orders where o_orderkey % 5 = 0)) where rn = 1""",
    ),
    "a8_live_rows": (
        ttl_rows,
        fx.duck("query_log", body="""select request_id, log_date, case when not cache_hit then ts + interval 48 hours end as valid_until
 from query_log where cache_hit or ts + interval 48 hours >= timestamp '2024-01-15 12:00:00'"""),
    ),
    "a9_apply_increments": (
        counters,
        fx.duck("query_log", body="""with base as (select hashed_ip, log_date, count(*) as n, cast(log_date as timestamp) + interval 48 hours as valid_until
   from query_log where ts < timestamp '2024-01-16 12:00:00' group by all),
 added as (select hashed_ip, cast(log_date - 6 as date) as log_date, count(*) as m from query_log where ts >= timestamp '2024-01-16 12:00:00' group by all)
 select coalesce(b.hashed_ip, a.hashed_ip) as hashed_ip, coalesce(b.log_date, a.log_date) as log_date,
  case when a.m is not null and (b.n is null or b.valid_until < timestamp '2024-01-16 12:00:00') then a.m else b.n + coalesce(a.m, 0) end as count,
  case when a.m is not null and (b.n is null or b.valid_until < timestamp '2024-01-16 12:00:00') then timestamp '2024-01-18 12:00:00' else b.valid_until end as valid_until
 from base b full outer join added a on a.hashed_ip = b.hashed_ip and a.log_date = b.log_date"""),
    ),
    "a10_flatten_events": (
        flat_events,
        """select event_id, event_type, case when event_id % 4 = 0 then null else value end as value,
 cast(to_json({'user': user_id, 'kind': event_type}) as varchar) as actor,
 cast(to_json([event_type, cast(user_id as varchar)]) as varchar) as tags from events""",
    ),
    "i1_build_query_log": (
        built_log,
        """with r as (select event_id as request_id, ts, cast(ts as date) as log_date, sha256(cast(user_id as varchar)) as hashed_ip,
  concat('topic ', json_extract_string(props, '$.k')) as question, value * 10 as latency_ms, event_type = 'error' as rejected,
  concat('answer ', cast(event_id as varchar)) as answer, cast(event_id % 6 as int) as citation_count,
  event_type in ('view', 'error') as cache_hit,
  case when event_id % 5 = 0 then null else cast(200 + event_id % 800 as int) end as prompt_tokens,
  case when event_id % 3 = 0 then null else cast(50 + event_id % 300 as int) end as output_tokens from events)
 select request_id, ts, log_date, hashed_ip, question, round(latency_ms, 4) as latency_ms, rejected,
  case when not rejected then answer end as answer,
  case when rejected then 0 else citation_count end as citation_count,
  case when rejected then false else cache_hit end as cache_hit,
  case when not rejected then prompt_tokens end as prompt_tokens,
  case when not rejected then output_tokens end as output_tokens,
  round(case when rejected then 0.0::double else coalesce(prompt_tokens, 0) * 1e-7 + coalesce(output_tokens, 0) * 4e-7 end, 9) as estimated_cost_usd,
  ts + interval 90 days as valid_until from r""",
    ),
    "i2_pseudonymize": (
        pseudonyms,
        """with r as (select event_id,
  case event_id % 5 when 0 then concat(' 10.0.0.', cast(user_id % 250 as varchar), ' , 172.16.0.1') when 1 then '' when 2 then ' , 1.2.3.4'
   when 3 then concat('10.1.1.', cast(user_id % 250 as varchar)) end as f,
  case when event_id % 2 = 0 then concat('192.168.0.', cast(user_id % 250 as varchar)) end as peer from events)
 select event_id, sha256('fixture-salt:' || coalesce(nullif(trim(split_part(f, ',', 1)), ''), peer, 'unknown')) as hashed_ip,
  substr(sha256('fixture-salt:' || coalesce(nullif(trim(split_part(f, ',', 1)), ''), peer, 'unknown')), 1, 12) as hashed_ip_short from r""",
    ),
    "i3_log_window": (
        window_rows,
        fx.duck("query_log", body="""select request_id, log_date, 'trailing' as kind from query_log where log_date between date '2024-01-21' and date '2024-01-30'
 union all select request_id, log_date, 'explicit' from query_log where log_date between date '2024-01-03' and date '2024-01-25'"""),
    ),
    "i4_summary": (
        log_summary,
        fx.duck("query_log", body=f"""with w as (select * from query_log where log_date between date '2024-01-03' and date '2024-01-25'),
 lat as (select latency_ms, row_number() over (order by latency_ms) - 1 as pos, count(*) over () as n from w where not rejected and latency_ms is not null)
 select date '2024-01-03' as window_start, date '2024-01-25' as window_end, count(*) as total_queries,
  count(*) filter (not rejected) as total_successes, count(*) filter (rejected) as total_rejections,
  count(*) filter (not rejected and cache_hit) as total_cache_hits,
  round(count(*) filter (rejected) / count(*), 6) as rejection_rate,
  round(count(*) filter (not rejected and cache_hit) / count(*) filter (not rejected), 6) as cache_hit_rate,
  (select round(max(latency_ms), 6) from lat where pos = round_even(0.5::double * (n - 1), 0)) as p50_latency_ms,
  (select round(max(latency_ms), 6) from lat where pos = round_even(0.95::double * (n - 1), 0)) as p95_latency_ms,
  round(sum(case when rejected then 0 else {COST} end), 8) as total_estimated_cost_usd from w"""),
    ),
    "i5_daily_series": (
        daily,
        fx.duck("query_log", body=f"""with d as (select log_date, {DAILY_COUNTS}, avg(latency_ms) filter (not rejected) as lat,
   sum(case when rejected then 0 else {COST} end) as cost from query_log group by log_date),
 spine as (select cast(unnest(generate_series(date '2024-01-20', date '2024-02-05', interval 1 day)) as date) as log_date)
 select s.log_date, coalesce(total, 0) as total, coalesce(successes, 0) as successes, coalesce(rejections, 0) as rejections,
  coalesce(cache_hits, 0) as cache_hits, round(lat, 6) as avg_latency_ms, round(coalesce(cost, 0), 8) as estimated_cost_usd
 from spine s left join d on d.log_date = s.log_date"""),
    ),
    "i6_top_questions": (
        top,
        fx.duck("query_log", body="""with w as (select *, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) as question_key from query_log
   where log_date between date '2024-01-03' and date '2024-01-25'),
 g as (select question_key, count(*) as asked, min(struct_pack(ts := ts, id := request_id)) as f from w group by 1)
 select g.question_key, g.asked, w.question from g join w on w.request_id = g.f.id order by g.asked desc, g.f limit 10"""),
    ),
    "i7_nearest_rank": (
        percentiles,
        fx.duck("query_log", body="""with lat as (select log_date, latency_ms, row_number() over (partition by log_date order by latency_ms) - 1 as pos,
   count(*) over (partition by log_date) as n from query_log where not rejected and latency_ms is not null)
 select log_date, cast(p as int) as percent, round(max(latency_ms), 6) as value from lat, unnest([50, 95, 99]) u(p)
 where pos = round_even((p / 100.0)::double * (n - 1), 0) group by all"""),
    ),
    "i8_recent": (
        recent_page,
        fx.duck("query_log", body=f"""with w as (select * from query_log where log_date between date '2024-01-24' and date '2024-01-30')
 select request_id, ts, substr(hashed_ip, 1, 12) as hashed_ip_short, question, rejected, cache_hit,
  round(coalesce(latency_ms, 0), 6) as latency_ms, round(case when rejected then 0 else {COST} end, 9) as estimated_cost_usd,
  (select count(*) from w) as total from w order by ts desc, request_id desc limit 50 offset 20"""),
    ),
    "i9_admission": (
        replay,
        fx.duck("query_log", body="""with c as (select *, count(*) filter (not rejected) over (partition by log_date, hashed_ip order by ts, request_id rows between unbounded preceding and 1 preceding) as used from query_log),
 p as (select *, row_number() over (partition by log_date order by ts, request_id) as rn from c where coalesce(used, 0) < 5),
 b as (select *, coalesce(sum(case when not rejected and not cache_hit then 1 else 0 end) over (partition by log_date order by ts, request_id rows between unbounded preceding and 1 preceding), 0) as calls from p where rn <= 200),
 s as (select request_id from b where calls < 180),
 l as (select q.*, s.request_id is not null as served from query_log q left join s on s.request_id = q.request_id),
 r as (select *,
   coalesce(count(*) filter (served and not rejected) over (partition by log_date, hashed_ip order by ts, request_id rows between unbounded preceding and 1 preceding), 0) as c1,
   coalesce(count(*) filter (served) over (partition by log_date order by ts, request_id rows between unbounded preceding and 1 preceding), 0) as c2,
   coalesce(count(*) filter (served and not rejected and not cache_hit) over (partition by log_date order by ts, request_id rows between unbounded preceding and 1 preceding), 0) as c3 from l)
 select request_id, log_date, served,
  case when c1 >= 5 then 'client_quota' when c2 >= 200 then 'global_cap' when c3 >= 180 then 'model_budget' end as refused_by from r"""),
    ),
}
