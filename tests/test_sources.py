"""Readers, sinks and log tables on small files."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow import fixtures as fx
from folioflow.session import stage_path
from folioflow.sources import files, log_store, manifest


def test_list_corpus(spark, tmp_path):
    (tmp_path / "01").mkdir()
    (tmp_path / "01" / "case.one.HTML").write_bytes(b"<p>x</p>")
    (tmp_path / "act.pdf").write_bytes(b"pdf")
    rows = {r.filename: r for r in files.list_corpus(spark, str(tmp_path)).collect()}
    one = rows["case.one.HTML"]
    assert (one.folder, one.extension, one.stem) == ("01", "html", "case.one")
    assert one.sha256 == hashlib.sha256(b"<p>x</p>").hexdigest()
    assert rows["act.pdf"].folder is None


LINE = T.StructType([T.StructField("source_type", T.StringType()), T.StructField("k", T.LongType())])


def test_jsonl_tolerant(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"source_type":"act","k":1}\n\n   \n{"source_type":"act"\n{"source_type":"memo","k":2}\n')
    good, bad = files.read_jsonl_tolerant(spark, str(path), LINE, F.col("record.source_type") == "act")
    assert [tuple(r) for r in good.collect()] == [("act", 1)]
    assert sorted(r.outcome for r in bad.collect()) == ["invalid_json", "rejected"]


def test_jsonl_strict_stops(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"source_type":"act","k":1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl_strict(spark, str(path), LINE).collect()


def test_manifest_is_trimmed(spark, tmp_path):
    path = tmp_path / "acts.jsonl"
    path.write_text(json.dumps({"act_id": " a1 ", "act_name": "\tName\n", "retrieved_date": "2024-01-02"}) + "\n")
    row = manifest.read_manifest(spark, str(path), manifest.ACT_SCHEMA).collect()[0]
    assert (row.act_id, row.act_name, row.retrieved_date, row.sha256) == ("a1", "Name", dt.date(2024, 1, 2), None)


def test_log_window_prunes_partitions(spark, sf):
    path = stage_path(spark, "log")
    log_store.write_log(fx.query_log(spark, sf), path)
    window = log_store.read_log(spark, path, dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert window.count() == fx.query_log(spark, sf).filter("log_date between '2024-01-10' and '2024-01-12'").count()


def test_live_at_expiry(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(1, None), (2, now), (3, now - dt.timedelta(seconds=1)), (4, now + dt.timedelta(seconds=1))]
    df = spark.createDataFrame(rows, "id int, valid_until timestamp")
    live = log_store.live_rows(df, F.lit(now).cast("timestamp"))
    assert sorted(r.id for r in live.collect()) == [1, 2, 4]


def test_upsert_hot_key(spark):
    base = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    out = log_store.upsert_latest(base, spark.createDataFrame([("new", 1)], "k string, v long"), ["k"], ["v"]).collect()
    assert sorted(map(tuple, out)) == [("hot", 2999), ("new", 1)]


def test_counter_ttl_not_refreshed(spark):
    now = dt.datetime(2024, 1, 5)
    later = now + dt.timedelta(hours=1)
    counters = spark.createDataFrame([("live", 4, later), ("old", 9, now - dt.timedelta(days=1)), ("idle", 2, later)], "key string, count long, valid_until timestamp")
    plus = spark.createDataFrame([("live", 1), ("live", 1), ("old", 3), ("new", 1)], "key string, amount int")
    out = log_store.apply_increments(counters, plus, ["key"], F.lit(now).cast("timestamp")).collect()
    fresh = now + dt.timedelta(hours=48)
    assert {r.key: (r["count"], r.valid_until) for r in out} == {"live": (6, later), "old": (3, fresh), "idle": (2, later), "new": (1, fresh)}


def test_events_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a"])], "id int, note string, tags array<string>")
    log_store.write_events(df, str(tmp_path / "events"))
    line = json.loads(spark.read.text(str(tmp_path / "events")).collect()[0].value)
    assert line == {"id": 1, "note": None, "tags": '["a"]'}
