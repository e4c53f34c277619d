"""The pipeline's stages in order, each held against a plain version on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from folioflow.llm.common import staged
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_ngram_join import brute as near


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = staged(stage(spark, docs, sf), f"test-{name}")
        after = docs.collect()
        kept[name] = len(after)
        ids = {r.doc_id for r in after}
        if name != "source_mix":
            assert docs.columns == columns
            assert all(r == before[r.doc_id] for r in after) and len(ids) == len(after)
        if name == "language_id":
            assert ids == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "exact_dedup":
            assert ids == {r[0] for r in exact([(i, r.text, None) for i, r in before.items()]) if r[3]}
        if name == "near_dedup":
            classes = [eval(r) for r in near(sorted((i, r.text) for i, r in before.items()))]
            assert ids == {i for i, c, _, n in classes if i == c or not n}
        if name == "decontamination":
            assert ids == {i for i, r in before.items() if not contaminated(r.text, items)[-1]}
        if name == "source_mix":
            copies = Counter(r.doc_id for r in after)
            assert max(copies.values()) <= 3
            numbers = defaultdict(set)
            for r in after:
                numbers[r.doc_id].add(r.copy_no)
            assert all(n == set(range(copies[i])) for i, n in numbers.items())
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), f"empty-{name}")
        assert docs.count() == 0


def test_awkward_rows(spark, sf, tmp_path):
    """Nulls, repeated rows and ids, empty and long texts, and columns named like results through all stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, 1, "x") for r in docs]
    text = docs[0].text
    rows += [(None, text, None, None, None, None), (None, text + " more", "en", None, 2, "x"), (5, text, "en", "s", 1, "x"), (5, text, "en", "s", 1, "x"),
             (None, None, None, None, None, None), (-1, "", "en", "", 1, "x"), (-2, text * 300, "en", "s", 1, "x"), (-3, "?! 12", None, "s", 1, None)]
    kind = "doc_id long, text string, lang string, source string, n_words long, _far string"
    spark.createDataFrame(rows, kind.replace("_far", "kept")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words", "kept", "copy_no"]
    found = out.collect()
    texts = {r.text for r in found}
    assert all(r.text and any(c.isalpha() for c in r.text) for r in found)
    # The text and its copies are one class with the longer version; one of them is left.
    assert len({t for t in texts if t.startswith(text[:200]) and len(t) < 2 * len(text)}) <= 1
