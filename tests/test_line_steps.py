"""The steps over statute lines: rows are sorted once and looked up by hash, cheap tests change no result."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.functions import running as steps
from folioflow.functions.running import line_block, neighbours, running
from folioflow.operators import sections
from folioflow.plans import preparation


def lines_of(spark, texts, page=4):
    rows = [(1, i // page, i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "act_id long, page_no int, line_no int, line string")


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_values_sort_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = lines_of(spark, ["x"] * 50)
        value = {"s": ("sum", F.col("line_no"), True), "m": ("max", F.when(F.col("line_no") % 7 == 0, F.col("line_no")), False)}
        carried = running(lines, ["act_id"], ["line_no"], line_block(size=9), value)
        near = neighbours(lines, ["act_id"], "line_no", line_block(size=9), {"p": ("previous", "line_no"), "n": ("next", "line_no")})
        for df in (carried, near):
            # Of the rows by line, and of the totals: by block, and by key for the join.
            assert physical_plan(df).count("Sort [") == 3
        got = [tuple(r) for r in carried.orderBy("line_no").select("s", "m").collect()]
        assert got == [(n * (n + 1) // 2, (n - 1) // 7 * 7 or None) for n in range(1, 51)]
        got = [tuple(r) for r in near.orderBy("line_no").select("p", "n").collect()]
        assert got == [(n - 1 or None, n + 1 if n < 50 else None) for n in range(1, 51)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_not_sorted_by_text(spark):
    lines = lines_of(spark, ["a", "b"])
    cleaned = sections.clean_lines(lines, sections.repeating_lines(lines, "act_id", "page_no"), "act_id")
    plan = physical_plan(cleaned)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_cheap_line_tests_keep_the_patterns_results(spark):
    rng = random.Random(5)
    marks = [" ", "\t", "\u000b", "1", "12", "345", "A", ".", "Section", "section", "CHAPTER", "IV", "١", "\u0085", " ", " ", "ArRangement", "OF", "Clauses", "word"]
    texts = ["", " ", "7", " 7 ", "7\u0085", " 7", "7a", "\t1. Title..", "Section 12AB. x  y", "section 1. x", "ARRANGEMENT  of\tSections", "1. x"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    lines = lines_of(spark, texts)
    none = spark.createDataFrame([], "act_id long, line string")
    cleaned = {r.line_no: r.line for r in sections.clean_lines(lines, none, "act_id").collect()}
    white = " \t\n\u000b\f\r"
    kept = {r.line_no for r in lines.filter(~F.col("line").rlike(sections.PAGE_NUMBER)).collect()}
    assert set(cleaned) == kept
    assert cleaned == {n: re.sub("[ \t]+", " ", texts[n - 1]).rstrip(white) if texts[n - 1].strip(white) else "" for n in kept}
    number, is_long = F.regexp_extract("line", sections.ANY_HEADING, 2), F.regexp_extract("line", sections.ANY_HEADING, 1) != ""
    plain = lines.select(
        "line_no",
        F.col("line").rlike(sections.TOC_MARKER).alias("marker"),
        F.when(~is_long, F.nullif(number, F.lit(""))).alias("short"),
        F.when(is_long, F.nullif(number, F.lit(""))).alias("long"),
    )
    noted = sections.annotate(lines).select("line_no", "marker", "short", "long")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    assert rows(noted) == rows(plain)
    assert any(r[2] for r in rows(plain)) and any(r[3] for r in rows(plain)) and any(r[1] for r in rows(plain))


def test_repeated_lines_are_counted_in_parts_that_grow_with_the_lines(spark, sf, monkeypatch):
    whole = sorted(map(tuple, preparation.act_repeats(spark, sf).collect()))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for size in (rows // 9, rows // 31):
        monkeypatch.setattr(steps, "ROWS_PER_TASK", size)
        for df in (fx.act_lines(spark, sf), preparation.act_repeats(spark, sf)):
            assert df.rdd.getNumPartitions() >= rows / size
        assert sorted(map(tuple, preparation.act_repeats(spark, sf).collect())) == whole
    assert whole


def test_a_line_of_all_pages_is_counted_once_per_page(spark):
    # Twice on each of 300 pages; others on two pages, and three times on one.
    texts = [t for i in range(300) for t in ("title ", " title", f"own {i}", f"pair {i // 2}")] + ["thrice"] * 3
    for parts in (None, 5):
        found = sections.repeating_lines(lines_of(spark, texts), "act_id", "page_no", parts=parts)
        assert [tuple(r) for r in found.collect()] == [(1, "title", 300)]


def test_a_computed_line_is_made_once(spark):
    lines = lines_of(spark, ["a", "b"]).withColumn("line", F.concat(F.lit("made "), F.col("line")))
    plan = sections.repeating_lines(lines, "act_id", "page_no")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(made") == 1
