"""Streams over several micro-batches."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from folioflow.session import stage_path
from folioflow.streaming import jobs

SCHEMA = "request_id long, ts timestamp, log_date date, hashed_ip string, rejected boolean, cache_hit boolean, estimated_cost_usd double"
START = dt.datetime(2024, 1, 1, 8)


def row(rid, minutes, ip="a", rejected=False):
    ts = START + dt.timedelta(minutes=minutes)
    return (rid, ts, ts.date(), ip, rejected, False, 0.5)


def source(spark, batches):
    """A file stream that delivers one file per micro-batch, in order."""
    import os
    import time

    path = stage_path(spark, "source")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    assert os.path.isdir(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_daily_counts_over_batches(spark):
    stream = source(spark, [[row(1, 0), row(2, 1, rejected=True)], [row(3, 2)], [row(4, 60 * 24)]])
    path = stage_path(spark, "daily")
    days = jobs.stream_daily(stream)
    jobs.upsert_stream(days, path, ["log_date"], mode="update")
    got = {r.log_date.day: (r.total, r.rejections) for r in jobs.read_upserts(spark, path, days.schema, ["log_date"]).collect()}
    assert got == {1: (3, 1), 2: (1, 0)}


def test_late_rows_are_dropped(spark):
    stream = source(spark, [[row(1, 60 * 24 * 5)], [row(2, 60 * 24 * 5 + 1)], [row(3, 0)]])
    path = stage_path(spark, "daily")
    days = jobs.stream_daily(stream)
    jobs.upsert_stream(days, path, ["log_date"], mode="update")
    got = {r.log_date.day: r.total for r in jobs.read_upserts(spark, path, days.schema, ["log_date"]).collect()}
    assert got == {6: 2}


def test_quota_spans_batches(spark):
    first = [row(i, i) for i in range(3)] + [row(50, 9, rejected=True)]
    second = [row(10 + i, 20 + i) for i in range(5)] + [row(30, 5, ip="b")]
    stream = source(spark, [first, second])
    path = stage_path(spark, "quota")
    admitted = jobs.stream_quota(stream, limit=5)
    jobs.drain(admitted, path)
    assert sorted(r.request_id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 10, 11, 30]
    native = jobs.quota_batches(source(spark, [first, second]), stage_path(spark, "quota"), limit=5)
    assert sorted(r.request_id for r in native.collect()) == [0, 1, 2, 10, 11, 30]


def test_quota_of_a_hot_client(spark):
    """A client with most rows is cut in the map tasks; counts clear after their day."""
    hot = [row(1000 + i, i % 700, ip="hot") for i in range(900)] + [row(i, i, ip=f"c{i}") for i in range(300)]
    firsts = jobs.first_by_task(spark.createDataFrame(hot, SCHEMA).repartition(6).select("hashed_ip", "log_date", "request_id", "ts"), ["hashed_ip", "log_date"], 5)
    assert firsts.filter("hashed_ip = 'hot'").count() <= 6 * 5 and firsts.count() >= 305
    day = 60 * 24
    stream = source(spark, [hot, [row(5000, day * 9)], [row(5001, day * 9 + 1)], [row(5002, 30, ip="hot")]])
    path = stage_path(spark, "quota")
    jobs.drain(jobs.stream_quota(stream, limit=5), path)
    got = spark.read.parquet(path)
    want = sorted((r[1], r[0]) for r in hot if r[3] == "hot")[:5]
    first = sorted(r.request_id for r in got.filter("hashed_ip = 'hot' and request_id < 5000").collect())
    assert first == sorted(i for _, i in want)
    assert got.filter("hashed_ip like 'c%'").count() == 300
    assert got.filter("hashed_ip = 'a'").count() == 2


def test_quota_of_many_clients(spark, monkeypatch):
    """Clients share the states of a day, null among them."""
    monkeypatch.setattr(jobs, "BUCKETS", 3)
    first = [row(i, i % 600, ip=None if i % 40 == 0 else f"c{i % 40}") for i in range(400)]
    second = [row(1000 + i, 700 + i % 200, ip=f"c{i % 80}" if i % 80 else None) for i in range(240)]
    path, checkpoint = stage_path(spark, "quota"), stage_path(spark, "stream-checkpoint")
    jobs.drain(jobs.stream_quota(source(spark, [first, second]), limit=11), path, checkpoint=checkpoint)
    want, used = set(), {}
    for batch in (first, second):
        for r in sorted(batch, key=lambda r: (r[1], r[0])):
            used[r[3]] = used.get(r[3], 0) + 1
            if used[r[3]] <= 11:
                want.add(r[0])
    assert sorted(r.request_id for r in spark.read.parquet(path).collect()) == sorted(want)
    states = spark.read.format("statestore").option("stateVarName", "used").load(checkpoint)
    assert 1 <= states.count() <= 3


def test_many_keys_are_cut_in_stretches(monkeypatch):
    """Each row is sorted a few times, and no task holds all of its rows."""
    seen, plain = [], jobs._firsts
    monkeypatch.setattr(jobs, "_firsts", lambda frame, *rest: seen.append(len(frame)) or plain(frame, *rest))
    monkeypatch.setattr(jobs, "HELD", 50)
    frames = [pd.DataFrame({"hashed_ip": [f"d{i}", "hot"], "request_id": [i, -i], "ts": [START, START]}) for i in range(500)]
    out = pd.concat(jobs.cut_frames(iter(frames), ["hashed_ip"], 5))
    assert sum(seen) <= 4 * 1000 and max(seen) <= 60
    assert sorted(out.loc[out["hashed_ip"] != "hot", "request_id"]) == list(range(500))
    hot = out.loc[out["hashed_ip"] == "hot", "request_id"]
    assert set(range(-499, -494)) <= set(hot) and len(hot) <= 5 * (1000 // 25)


def test_dedup_over_batches(spark):
    stream = source(spark, [[row(1, 0), row(2, 1)], [row(2, 1), row(3, 2)]])
    path = stage_path(spark, "dedup")
    jobs.drain(jobs.stream_dedup(stream), path)
    assert sorted(r.request_id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_upserts_merge_and_compact(spark):
    stream = source(spark, [[row(1, 0), row(1, 5)], [row(1, 3), row(2, 1)]])
    rows = stream.select("request_id", "ts")
    path, target = stage_path(spark, "upserts"), stage_path(spark, "compact")
    jobs.upsert_stream(rows, path, ["request_id"], ["ts"])
    current = jobs.read_upserts(spark, path, rows.schema, ["request_id"], ["ts"])
    want = {1: START + dt.timedelta(minutes=5), 2: START + dt.timedelta(minutes=1)}
    assert {r.request_id: r.ts for r in current.collect()} == want
    jobs.compact_upserts(spark, path, target, rows.schema, ["request_id"], ["ts"])
    again = jobs.read_upserts(spark, target, rows.schema, ["request_id"], ["ts"])
    assert {r.request_id: r.ts for r in again.collect()} == want
    assert spark.read.parquet(target).select(F.count("*")).collect()[0][0] == 2
