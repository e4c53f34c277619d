"""Relevance by word counts: a small model meets the texts where they lie, a large one gives the same."""

from __future__ import annotations

import math

from folioflow.operators import extract


def plain(train, docs):
    words = lambda t: __import__("re").findall("[a-z0-9_]{2,}", t.lower())
    counts = {}
    for text, label in train:
        for w in words(text):
            counts.setdefault(w, [0, 0])[label] += 1
    neg, pos = (sum(c[i] for c in counts.values()) for i in (0, 1))
    prior = math.log((sum(l for _, l in train) + 1) / (sum(1 - l for _, l in train) + 1))
    out = {}
    for key, text in docs:
        odds = prior + sum(math.log((counts[w][1] + 1) / (pos + len(counts))) - math.log((counts[w][0] + 1) / (neg + len(counts))) for w in words(text or "") if w in counts)
        out[key] = round(1 / (1 + math.exp(-max(-30, min(30, odds)))), 6)
    return out


def test_copied_and_joined_models_agree(spark):
    docs = [(1, "good good court case"), (2, "bad spam Spam offer"), (3, "nothing known"), (4, ""), (5, None), (6, "good bad"), (7, "court spam court")]
    train = [("good court", 1), ("good case law", 1), ("spam offer bad", 0), ("", 0), ("bad", 0)]
    texts = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labelled = spark.createDataFrame(train, "text string, label int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = extract.relevance_scores(labelled, texts, "doc_id")
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(term" not in plan
        large = extract.relevance_scores(labelled, texts, "doc_id", max_words=2)
        assert "hashpartitioning(term" in large._jdf.queryExecution().executedPlan().toString()
        for df in (small, large):
            assert {r.doc_id: r.relevance_score for r in df.collect()} == plain(train, docs)
        # Without any word to learn from, the prior decides.
        none = extract.relevance_scores(labelled.filter("text = ''"), texts, "doc_id")
        assert {r.relevance_score for r in none.collect()} == {round(1 / 3, 6)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
