"""Hand-written cases for rules that random data rarely reaches."""

from __future__ import annotations

import pyarrow as pa

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import ranking, text
from folioflow.functions.html import read_page
from folioflow.operators import chunk, citations, embed, evaluate, extract, index, loganalytics, quality, retrieve, sections


def values(df, column):
    return [r[column] for r in df.collect()]


def test_half_even_tokens(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcdef",), ("a" * 10,)], "t string")
    assert values(df.select(text.token_estimate(F.col("t")).alias("n")), "n") == [1, 1, 2, 2]


def test_filename_and_query_forms(spark):
    names = ["A & B (1).PDF", "nodot Name", "__x__.Html", "a.b.c.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert values(df.select(text.normalize_filename(F.col("n")).alias("o")), "o") == ["a_b_1.pdf", "nodot Name", "x.html", "abc.pdf"]
    df = spark.createDataFrame([(q,) for q in ("x ?", "  What  IS it?! ", "what's v.1")], "q string")
    assert values(df.select(text.normalize_query(F.col("q")).alias("o")), "o") == ["x ", "what is it", "what's v.1"]


def test_tokens(spark):
    df = spark.createDataFrame([("§397 of IPC v State_of a B2",)], "t string")
    assert values(df.select(text.tokens(F.col("t")).alias("o")), "o") == [["section", "397", "of", "ipc", "state_of", "b2"]]


def test_section_chunks_keep_gap_and_heading(spark):
    parts = ["a" * 1990, "b" * 50, "c" * 1990]
    rows = [(1, "H", "\n\n".join(parts)), (2, "H", "x" * 2500), (3, None, "  "), (4, "", "short")]
    out = chunk.chunk_sections(spark.createDataFrame(rows, "id int, heading string, text string"))
    got = {(r.id, r.sub_index): r.chunk_text for r in out.collect()}
    # The 50-character piece fits nowhere and is dropped; its index stays unused.
    assert sorted(got) == [(1, 0), (1, 2), (2, 0), (4, 0)]
    assert got[(1, 0)] == "H\n\n" + parts[0] and got[(1, 2)] == parts[2]
    assert got[(2, 0)] == "H\n\n" + "x" * 2500 and got[(4, 0)] == "short"


def test_oversize_paragraph_pieces_have_distinct_ids(spark):
    long = "\n\n".join(["p" * 1500, "q" * 1500])
    docs = spark.createDataFrame([(7, [(0, "a" * 100), (1, long), (2, "b")])], "f int, paragraphs array<struct<paragraph_index:int,text:string>>")
    out = chunk.pack_paragraphs(docs).withColumn("id", chunk.paragraph_chunk_id(F.col("f"), F.col("start_index"), F.col("end_index"), F.col("piece")))
    assert sorted(values(out, "id")) == ["j:7:p0-p0", "j:7:p1-p1", "j:7:p1-p1:1", "j:7:p2-p2"]


def test_chunks_lose_no_text(spark, sf):
    from folioflow.plans.preparation import paragraph_docs

    docs = paragraph_docs(spark, sf)
    want = docs.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", F.regexp_replace("p.text", r"\s", "").alias("t")).groupBy("doc_id").agg(F.sum(F.length("t")).alias("n"))
    packed = chunk.pack_paragraphs(docs).select("doc_id", F.length(F.regexp_replace("chunk_text", r"\s", "")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("m"))
    assert want.join(packed, "doc_id").filter("n <> m").count() == 0 and want.count() == packed.count()


def test_rrf(spark):
    schema = "query_id int, chunk_id string, rank int, payload string"
    first = spark.createDataFrame([(1, "a", 1, "one"), (1, "b", 2, "one")], schema)
    second = spark.createDataFrame([(1, "b", 1, "two"), (1, "c", 2, "two")], schema)
    empty = spark.createDataFrame([], schema)
    got = {r.chunk_id: (r.score, r.payload) for r in retrieve.rrf(first, second, empty).collect()}
    assert got["b"] == (round(1 / 61 + 1 / 60, 9), "one")
    assert got["a"] == (round(1 / 60, 9), "one") and got["c"] == (round(1 / 61, 9), "two")
    swapped = {r.chunk_id: r.score for r in retrieve.rrf(second, first).collect()}
    assert swapped == {c: s for c, (s, _) in got.items()}
    with pytest.raises(ValueError):
        retrieve.rrf(first, k=0)


def test_scope_gate(spark):
    hits = "query_id int, chunk_id int, score double"
    queries = spark.createDataFrame([(i,) for i in range(5)], "query_id int")
    vec = spark.createDataFrame([(0, 1, 0.6), (1, 1, 0.59), (1, 2, 0.1)], hits)
    txt = spark.createDataFrame([(1, 9, 3.0), (2, 9, 3.0)], hits)
    got = {r.query_id: (r.top_similarity, r.accepted) for r in retrieve.scope_gate(queries, vec, txt).collect()}
    assert got == {0: (0.6, True), 1: (0.59, False), 2: (0.0, True), 3: (0.0, False), 4: (0.0, False)}


def test_calibration_separable(spark):
    rows = [(1, True, 0.7), (2, True, 0.8), (3, False, 0.5), (4, False, 0.55)]
    report, wrong = retrieve.calibrate_threshold(spark.createDataFrame(rows, "query_id int, in_scope boolean, score double"))
    r = report.collect()[0]
    assert r.separable and abs(r.gap - 0.15) < 1e-9 and abs(r.midpoint - 0.625) < 1e-9 and r.overlap is None
    assert r.median_in == 0.75 and wrong.count() == 0


def test_citations(spark):
    rows = [
        (1, "A [3] [3] [1] [9] end [07] .", 5),
        (2, "No markers  here .", 5),
        (3, "[0] [99999999999999999999] [5] ok", 5),
        (4, "[[7]3] x", 2),
    ]
    out = {r.query_id: r for r in citations.verify_citations(spark.createDataFrame(rows, "query_id int, answer_text string, n_sources int")).collect()}
    assert (out[1].used, out[1].stripped) == ([3, 1], ["7", "9"])
    assert out[1].clean_text == "A [3] [3] [1] end."
    assert out[2].clean_text == "No markers  here ."
    assert (out[3].used, out[3].stripped) == ([5], ["0", "99999999999999999999"])
    assert out[4].clean_text == "[3] x"
    again = citations.verify_citations(spark.createDataFrame([(1, out[1].clean_text, 5)], "query_id int, answer_text string, n_sources int")).collect()[0]
    assert again.clean_text == out[1].clean_text and again.stripped == []


def test_card_index_differs_from_marker(spark):
    verified = citations.verify_citations(spark.createDataFrame([(1, "x [4] y [2]", 5)], "query_id int, answer_text string, n_sources int"))
    meta = "query_id int, rank int, chunk_id string, text string, source_type string, short_name string, act_id string, section_number string, citation string, case_name string, court string, year int, source_url string, indian_kanoon_url string, pdf_filename string"
    hits = spark.createDataFrame([(1, n, f"c{n}", "t" * 301, "act", "", "act1", "5", None, None, "court", 1999, "u", "k", "p.pdf") for n in range(1, 6)], meta)
    cards = sorted((r.card_index, r.marker, r.citation, len(r.excerpt), r.court) for r in citations.citation_cards(verified, hits).collect())
    assert cards == [(1, 4, "act1 §5", 301, None), (2, 2, "act1 §5", 301, None)]
    kinds = [("act", "k"), ("judgment", "k"), ("judgment", ""), ("judgment", None), (None, "k")]
    hits = spark.createDataFrame([(1, n, f"c{n}", "t", kind, "", "a", "5", None, None, None, 1999, "u", url, "p.pdf") for n, (kind, url) in enumerate(kinds, 1)], meta)
    verified = citations.verify_citations(spark.createDataFrame([(1, "[1][2][3][4][5]", 5)], "query_id int, answer_text string, n_sources int"))
    links = sorted((r.card_index, r.source_url, r.pdf_url) for r in citations.citation_cards(verified, hits).collect())
    assert links == [(1, "u", None), (2, "k", "p.pdf"), (3, "u", "p.pdf"), (4, "u", "p.pdf"), (5, "u", None)]


def test_hashes_need_both_files(spark):
    cases = spark.createDataFrame([("a", "x.html", "x.pdf", "old", None), ("b", "y.html", "y.pdf", None, "old"), ("c", "z.html", None, None, None)], "folder string, html_filename string, pdf_filename string, html_sha256 string, pdf_sha256 string")
    listing = spark.createDataFrame([("a", "x.html", "h1"), ("a", "x.pdf", "p1"), ("b", "y.html", "h2"), ("c", "z.html", "h3"), ("b", "x.pdf", "p9"), (None, "act.pdf", "a1")], "folder string, filename string, sha256 string")
    none, one = listing.filter("false"), listing.limit(1)
    shown = lambda df: sorted((r.folder, r.html_sha256, r.pdf_sha256) for r in df.collect())
    assert shown(quality.backfill_judgments(cases, listing, none)) == [("a", "h1", "p1"), ("b", None, "old"), ("c", None, None)]
    assert shown(quality.backfill_judgments(cases, listing, one)) == [("a", "old", None), ("b", None, "old"), ("c", None, None)]
    acts = spark.createDataFrame([("1", "act.pdf", "old"), ("2", "gone.pdf", "old"), ("3", "x.pdf", None)], "act_id string, filename string, sha256 string")
    assert sorted((r.act_id, r.sha256) for r in quality.backfill_acts(acts, listing, none).collect()) == [("1", "a1"), ("2", "old"), ("3", None)]
    assert sorted((r.act_id, r.sha256) for r in quality.backfill_acts(acts, listing, one).collect()) == [("1", "old"), ("2", "old"), ("3", None)]


def test_fills(spark):
    base = spark.createDataFrame([("01", "TODO: x", 1999), ("02", "kept", 2000)], "folder string, citation string, year int")
    fills = spark.createDataFrame(
        [
            ("01", "citation", "new", None),
            ("02", "citation", "other", "high"),
            ("02", "year", "2000", "high"),
            ("01", "year", "2001", "medium"),
            ("03", "citation", "x", "high"),
            ("01", "citation", " ", None),
            ("02", "citation", "kept", "bogus"),
        ],
        "folder string, field string, value string, confidence string",
    )
    fields = ("citation", "year")
    out = {(r.folder, r.field, r.new_value): r.outcome for r in quality.merge_fills(base, fills, fields).collect()}
    assert out == {
        ("01", "citation", "new"): "applied",
        ("02", "citation", "other"): "existing",
        ("02", "year", "2000"): "unchanged",
        ("01", "year", "2001"): "low_confidence",
        ("03", "citation", "x"): "not_found",
        ("01", "citation", " "): "blank",
        ("02", "citation", "kept"): "low_confidence",
    }
    filled = quality.apply_fills(base, quality.merge_fills(base, fills, fields), fields)
    assert sorted(map(tuple, filled.collect())) == [("01", "new", 1999), ("02", "kept", 2000)]


def test_vector_table_first_chunk_last_vector(spark):
    chunks = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("b", "only", 3)], "chunk_id string, text string, ordinal int")
    vecs = spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 2), ("c", [3.0], 3), ("b", [], 4)], "chunk_id string, embedding array<double>, ordinal int")
    table, repeated, missing = index.build_vector_table(chunks, vecs)
    assert [tuple(r) for r in table.collect()] == [("a", "first", [2.0])]
    assert [tuple(r) for r in repeated.collect()] == [("a", 2)]
    assert values(missing, "chunk_id") == ["b"]


def test_bad_batch_fails_alone(spark):
    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("boom")
        return np.ones((len(texts), 2))

    df = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(10)], "id int, text string").coalesce(1)
    rows = embed.embed_batches(df, "id", embed_fn=flaky, batch=2).collect()
    assert sorted(r.id for r in rows if r.error) == [2, 3]
    assert all(abs(r.embedding[0] - 0.5**0.5) < 1e-12 for r in rows if not r.error)
    wrong = embed.embed_batches(df.filter("id <> 3"), "id", embed_fn=flaky, dim=3).collect()
    assert len(wrong) == 9 and all("dimension" in r.error for r in wrong)


def test_html():
    page = """<html><head><title>T</title></head><body><nav><p>navigation text that is long enough</p></nav>
      <p>First paragraph without an end tag, long enough<p>Second paragraph, also long enough to keep
      <blockquote><p>A quoted paragraph which counts only once here</p></blockquote>
      <div class="heading"><p>inside a class that contains the noise word</p></div><p>short</p></body></html>"""
    got = read_page(page, 30)
    assert got["paragraphs"] == [
        "First paragraph without an end tag, long enough",
        "Second paragraph, also long enough to keep",
        "A quoted paragraph which counts only once here",
    ]
    assert not got["has_container"] and got["title"] == "T"
    assert len(read_page(page, 30, whole_token=True)["paragraphs"]) == 4
    inside = read_page("<body><p>outside the container, long enough text</p><div class='judgments'><p>inside the container, long enough text</p></div></body>", 30)
    assert inside["has_container"] and inside["paragraphs"] == ["inside the container, long enough text"]


def test_citation_pattern_order_beats_position(spark):
    rows = [(1, "AIR 1998 SC 1 then (2001) 2 SCC 3", "f.html"), (2, "x" * 3100 + " AIR 1990 SC 4", "f.html"), (3, "none", "a_on_3_may_1984.html"), (4, "none", "f.html")]
    out = {r.id: r for r in extract.extract_citation(spark.createDataFrame(rows, "id int, text string, filename string")).collect()}
    assert (out[1].citation, out[1].year, out[1].citation_confidence) == ("(2001) 2 SCC 3", 2001, "high")
    assert (out[2].year, out[2].citation_confidence) == (1990, "medium")
    assert (out[3].citation, out[3].year, out[3].year_confidence) == (None, 1984, "medium")
    assert (out[4].year, out[4].year_confidence) == (None, "low")


def test_log_cases(spark):
    schema = "request_id int, ts timestamp, log_date date, hashed_ip string, question string, rejected boolean, cache_hit boolean, latency_ms double, estimated_cost_usd double"
    end = dt.date(2024, 3, 7)
    start = end - dt.timedelta(days=6)
    empty = spark.createDataFrame([], schema)
    row = loganalytics.summary(empty, start, end).collect()[0]
    assert (row.total_queries, row.rejection_rate, row.cache_hit_rate, row.p50_latency_ms, row.total_estimated_cost_usd) == (0, 0.0, 0.0, None, 0.0)
    days = loganalytics.daily_series(empty, start, end).collect()
    assert len(days) == 7 and all(d.total == 0 and d.avg_latency_ms is None for d in days)
    noon = dt.datetime(2024, 3, 7, 12)
    rows = [
        (1, noon, end, "ip", "What is robbery?", False, False, 900.0, 0.1),
        (2, noon + dt.timedelta(minutes=1), end, "ip", " what IS  robbery? ", True, False, 1.0, 0.0),
        (3, noon + dt.timedelta(minutes=2), end, "ip", "other", False, True, 5.0, 0.0),
    ]
    log = spark.createDataFrame(rows, schema)
    top = loganalytics.top_questions(log).collect()
    assert [(t.question, t.asked) for t in top] == [("What is robbery?", 2), ("other", 1)]
    page = loganalytics.recent(log, 2, 0, end).collect()
    assert [p.request_id for p in page] == [3, 2] and page[0].total == 3
    assert loganalytics.summary(log, start, end).collect()[0].rejection_rate == pytest.approx(1 / 3)


def test_window_errors():
    day = dt.date(2024, 1, 10)
    assert loganalytics.resolve_window(as_of=day) == (dt.date(2024, 1, 4), day)
    assert loganalytics.resolve_window(day, day) == (day, day)
    for bad in ({"days": 0}, {"days": 91}, {"start": day, "end": day - dt.timedelta(days=1)}, {"start": day, "end": day + dt.timedelta(days=90)}):
        with pytest.raises(ValueError):
            loganalytics.resolve_window(**bad)


def test_passages_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox y"), (2, "the quick brown foxes"), (3, "quick brown only"), (4, None), (5, "!?")], "doc_id int, text string")
    passages = [(7, "the quick brown fox"), (8, "quick brown only ones"), (9, "ick bro"), (10, "fox"), (11, "!"), (12, "own fox y"), (13, "y"), (14, None), (15, "nly")]
    frame = spark.createDataFrame(passages, "query_id int, passage string")
    want = sorted((q, r.doc_id) for q, p in passages for r in docs.collect() if p is not None and p in (r.text or "\0"))
    assert sorted(map(tuple, evaluate.contains_passage(frame, docs).collect())) == want


def test_chapter_titles_in_dropped_and_missing_sections(spark):
    """A title may stand ahead of the first section or in one whose body is too short to stay."""
    text = [
        "CHAPTER I", "", "Opening", "1. Name", "This body is long enough to be kept.", "2. Short",
        "CHAPTER II", "Next", "3. Third", "Another body that is long enough.", "CHAPTER III", "4. Fourth", "(a) Also a body of sufficient length.",
    ]
    lines = [("a", 1, n, line) for n, line in enumerate(text, 1)] + [("b", 1, 1, "CHAPTER I"), ("b", 1, 2, "No section here")]
    frame = spark.createDataFrame(lines, "act_id string, page_no int, line_no long, line string")
    got = {r.number: r for r in sections.parse_act_lines(frame).collect()}
    assert {n: (r.line_no, r.heading, r.chapter_number, r.chapter) for n, r in got.items()} == {
        "1": (4, "Name", "I", "Opening"),
        "3": (9, "Third", "II", "Next"),
        "4": (12, "Fourth", "III", "4. Fourth"),
    }
    assert got["1"].body == "This body is long enough to be kept."


def test_percentiles_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "v double")
    assert ranking.nearest_rank(empty, "v", (50, 95)).collect() == []
    same = spark.createDataFrame([(2.5,), (2.5,), (None,), (float("nan"),)], "v double")
    assert sorted(map(tuple, ranking.nearest_rank(same, "v", (50, 95)).collect())) == [(50, 2.5), (95, 2.5)]
    money = spark.createDataFrame([(n,) for n in range(1, 12)], "n long").selectExpr("cast(n / 10 as decimal(12,2)) as v")
    assert str(ranking.nearest_rank(money, "v", (50,)).first().value) == "0.60"


def test_pages_are_parsed_in_small_pieces(monkeypatch):
    monkeypatch.setattr(extract, "PIECE_ROWS", 3)
    monkeypatch.setattr(extract, "PIECE_BYTES", 10)
    pages = ["a", None, "b", "c", "d" * 9, "e" * 30, "f", "", None]
    batch = pa.record_batch([pa.array(range(9)), pa.array(pages)], ["page_id", "html"])
    parts = [piece.column(1).to_pylist() for piece in extract.pieces(batch)]
    assert parts == [["a", None, "b"], ["c", "d" * 9], ["e" * 30], ["f", "", None]]
    assert list(extract.pieces(batch.slice(0, 0))) == []
