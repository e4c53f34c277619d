"""Licence scans against a direct Dice computation on every unit and template."""

from __future__ import annotations

import re

from folioflow.llm.licenses import DISCLAIMER, TEMPLATES, WHOLE, scan_licenses

MIT = next(t for i, t in TEMPLATES if i == "MIT" and len(t) > 100)
APACHE = "Licensed under the Apache License, Version 2.0."


def grams(text):
    words = re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", text.lower()).split()
    return set(zip(words[:-1], words[1:], strict=True))


def brute(text):
    text = re.sub(r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ", (text or "").lower())
    units = [("line", u) for u in text.split("\n")]
    paragraphs = re.split(r"\n *(?:\n *)+", text)
    units += [("paragraph", u) for u in paragraphs] if len(paragraphs) > 1 else []
    units += [("document", text)] if "\n" in text else []
    hits, matched = [], 0
    for unit, part in units:
        scores = [(-2 * len(grams(part) & grams(t)) / (len(grams(part)) + len(grams(t))), i, unit) for i, t in TEMPLATES if grams(part)]
        good = [s for s in scores if s[0] <= -0.8]
        matched += bool(good)
        hits += [min(good)] if good else []
    best = min(hits, default=None)
    return (best[1], -best[0], best[2], matched) if best else (None, None, None, 0)


def test_scan(spark):
    texts = [None, "", "one", APACHE, APACHE.upper().replace(" ", "!! "), "prose\n" + APACHE + "\n\nmore\nReleased under the MIT License",
             MIT, MIT.replace("free of charge, ", ""), "x\n\n" + MIT[:400] + "\n" + MIT[400:] + "\n \n tail words", "word " * 100_000 + "\n" + APACHE,
             "same " * 50_000, APACHE + " " + APACHE, "All rights reserved", "rights reserved all", "\n\n\n", "Été licence"]
    docs = spark.createDataFrame([(i % 12, t, "clash") for i, t in enumerate(texts)] + [(None, APACHE, "")], "doc_id long, text string, license_id string")
    got = sorted((repr(tuple(r)) for r in scan_licenses(docs).collect()))
    want = sorted(repr((i % 12, *brute(t))) for i, t in enumerate(texts)) + [repr((None, *brute(APACHE)))]
    assert got == sorted(want)


def best_run(text):
    """Best Dice of runs of lines, from all of them."""
    lines = [u for u in text.split("\n") if grams("a " + u)]
    runs = ["\n".join(lines[i : j + 1]) for i in range(len(lines)) for j in range(i, len(lines))]
    known = [(i, grams(t)) for i, t in TEMPLATES + WHOLE]
    return min((-2 * len(r & t) / (len(r) + len(t)), i) for r in map(grams, runs) for i, t in known)


def test_licences_of_several_paragraphs(spark):
    code = "\n".join(f"value{i} = compute{i}(left{i}, right{i})" for i in range(40))
    bsd = "Copyright (c) 2020, Someone\n\n" + dict(TEMPLATES)["BSD-2-Clause"].replace("1. ", "\n\n1. ").replace("2. ", "\n\n2. ") + "\n\n" + DISCLAIMER
    gpl = "\n".join("# " + x.strip() for x in dict(TEMPLATES)["GPL-3.0"].replace("later version. ", "later version.\n\n").split("\n"))
    texts = [bsd, bsd + "\n\n" + code, gpl + "\n\n" + code, code + "\n" + gpl + "\n" + APACHE + "\n" + code, code]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [got[i].license_id for i in range(5)] == ["BSD-2-Clause", "BSD-2-Clause", "GPL-3.0", "Apache-2.0", None]
    assert [got[i].unit for i in (1, 2, 3)] == ["run", "run", "line"]
    assert [got[i].n_matches for i in (1, 2, 3, 4)] == [1, 1, 2, 0]
    assert all((-got[i].dice, got[i].license_id) == best_run(texts[i]) for i in (1, 2))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(docs).count() == 0
    some = spark.createDataFrame([(1, APACHE)], "doc_id long, text string")
    assert scan_licenses(some, templates=()).first().license_id is None
