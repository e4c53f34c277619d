"""The physical plans are the ones meant."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.functions import ranking
from folioflow.operators import embed, extract, loganalytics
from folioflow.plans import logs, preparation, retrieval
from folioflow.plans.catalog import QUERIES
from folioflow.session import stage_run


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf):
    window = loganalytics.log_window(fx.query_log(spark, sf), dt.date(2024, 1, 3), dt.date(2024, 1, 5))
    plan = plan_of(window.select("request_id"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
    assert "label,2)" in plan_of(retrieval.vectors(spark, sf).filter("label = 2")).replace(" ", "")


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    plan = plan_of(retrieval.cosine(spark, sf))
    assert "row_number(), 20, Partial" in plan and "row_number(), 20, Final" in plan


def test_recent_page_is_a_bounded_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(logs.recent_page(spark, sf))


def test_percentiles_need_no_window(spark, sf, monkeypatch):
    seen = []
    staged = ranking.staged
    monkeypatch.setattr(ranking, "staged", lambda df: seen.append(plan_of(df)) or staged(df))
    assert "Window" not in plan_of(logs.percentiles(spark, sf))
    assert seen and not any("Window" in plan or "CartesianProduct" in plan or "NestedLoop" in plan for plan in seen)


def test_quota_replay_sorts_no_whole_client(spark, sf):
    plan = plan_of(logs.replay(spark, sf))
    assert "row_number(), 5, Partial" in plan
    # The log itself is read once; the gates come from the staged first requests of each day.
    assert plan.count("events.parquet") <= 2


def test_packing_is_evaluated_once(spark, sf):
    plan = plan_of(preparation.paragraph_chunks(spark, sf))
    assert "size(aggregate" not in plan


def test_no_query_uses_a_cartesian_product(spark, sf):
    # Streaming queries and those that stage tables run at planning time; their parts are covered above.
    for name in ("b3_missing_files", "b8_hash_drift", "e6_materialize_embeddings", "f4_vector_table", "g6_exact_cache_lookup", "i9_admission", "j3_citation_pr"):
        assert "CartesianProduct" not in plan_of(QUERIES[name](spark, sf)), name


def test_bucketed_cache_is_not_shuffled(spark, sf):
    """Only the batch is dealt out; the cache is read bucket by bucket."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = retrieval.bucketed_cache(spark, sf)
        chunks = retrieval.hashed_chunks(spark, sf)
        hits, misses = embed.split_cached(chunks, cache)
        for df in (hits, misses, embed.materialize_embeddings(chunks, cache)):
            plan = plan_of(df)
            assert "Join" in plan and plan.count("Exchange hashpartitioning(content_hash") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stage_tables_go_with_their_run(spark, sf):
    with stage_run(spark) as folder:
        rows = retrieval.bm25_hits(spark, sf).count()
        assert rows and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_reference_search_reads_its_lines_twice(spark, monkeypatch, tmp_path):
    """Once for the edges of blocks and once for the lines, whatever the number of passes; blocks change nothing."""
    words = ["see section", "378 and 5 of the", "Indian Penal", "", "Code s. 379", "x", "under sec", "  ", "402 IPC", "305 BNS", "1. of", "the Bharatiya"]
    rows = [(act, n, words[(act * 5 + n * 7) % len(words)]) for act in range(9) for n in range(1, 40)]
    spark.createDataFrame(rows, "act_id long, line_no long, line string").write.parquet(f"{tmp_path}/lines")
    lines, seen, staged = spark.read.parquet(f"{tmp_path}/lines"), [], getattr(extract, "staged", None)
    monkeypatch.setattr(extract, "staged", lambda df, name: seen.append(df) or staged(df, name), raising=False)
    found = extract.section_references(lines, "act_id", "line_no")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [*seen, found]]
    assert sum(plan.count("Relation [act_id#") for plan in plans) <= 2 + 4  # the stage table: lines alone, and runs in two passes
    whole = sorted(found.collect())
    monkeypatch.setattr(extract, "line_block", lambda col: F.floor(F.col(col) / 2))
    assert whole and sorted(extract.section_references(lines, "act_id", "line_no").collect()) == whole
