"""Base spans against the contract's patterns read literally; pairs on hand-made code."""

from __future__ import annotations

import hashlib
import re

import pytest

from folioflow.llm.queries import PLANS
from folioflow.llm.secret_scan import pairs, scan_secrets, spans_of

CONTRACT = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
TEXTS = [
    None, "", "token=abc token = abcdef", 'éé "Api_Key": "0123456789abcdef01234567" x', "AKIA" + "A" * 16 + " AKIA" + "B" * 15,
    "f" * 23 + "g" + "f" * 24, "ſecret=abcdef secret:=abcdef", "passwd ='a=b=c.d' tokentoken==abcdef", "token=abcdef" * 3,
    "a" * 300_000 + " token = " + "9" * 100_000, "password\n= abcdefg", "apikey" * 20_000 + ":secret1",
]


def brute(text):
    out = []
    for kind, pattern, group, least in CONTRACT:
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans_of(text) if s["kind"] != "pair"] == brute(text)


def literals(text):
    return [text[s:e] for _, s, e, _, _ in sorted(pairs(text), key=lambda p: p[1])]


def test_pairs():
    assert literals('db_password := "hunter2Long9x"') == ["hunter2Long9x"]
    assert literals("clientSecret => 'Zk3-aQ92bX_p'") == ["Zk3-aQ92bX_p"]
    assert literals('PREFIX = "sk_live_9a"\nstripe_secret = PREFIX + "Qx81mmZ0"') == ["sk_live_9a", "Qx81mmZ0"]
    assert literals('A="Xy7Qq1Pl0zz"\nexport AUTH_TOKEN=$A') == ["Xy7Qq1Pl0zz"]
    assert literals('password = "changeme"\ntoken_count = 123\ncolour = "9f8e7d6c5b4a39281706"') == []
    assert literals("The secret: everyone knows that the word is out") == []


def test_strings_of_any_form():
    assert literals('password = """hunter2Long9x"""') == ["hunter2Long9x"]
    assert literals("password = \'\'\'hunter2\'Long9x\'\'\'\ntoken = b\"Zk3-aQ92bX_p\"") == ["hunter2'Long9x", "Zk3-aQ92bX_p"]
    for joint in ('" + \\\n  "', '" +\n  "', '"\n   + "', '" \\\n "'):
        assert literals(f'db_password = "hunter2Qz{joint}Long9xVt"') == ["hunter2Qz", "Long9xVt"], joint
    assert literals('db_password = (\n "hunter2Qz"\n  "Long9xVt" + "pP0"\n)') == ["hunter2Qz", "Long9xVt", "pP0"]
    assert literals('db_password = "hunter2Qz"\nother "Long9xVt"') == ["hunter2Qz"]


def test_constants_of_any_number():
    for n in (16, 17, 400):
        parts = " + ".join(f'"k{i}Zq"' for i in range(n))
        assert len(literals(f"P = {parts}\nsecret = P")) == n
        # What the name was given before no longer counts.
        assert literals(f'P = "Old1Value9zz"\nP = {parts}\nsecret = P')[0] == "k0Zq"
    assert literals('P = "Old1Value9zz"\nP = make()\nsecret = P') == []
    assert literals('P = "Old1Value9zz"\nif P == other:\n  secret = P') == ["Old1Value9zz"]
    assert literals('P = "Old1Val"\nP += "ue9zz"\nsecret = P\nP = "x"') == ["Old1Val", "ue9zz"]
    assert literals('password = "xxxxxxxxxxxx"\ntoken = "<put-yours-h3re>"\nsecret = "your9SecretZ"') == []


def test_constants_are_shared():
    doubling = 'A0 = "aB3$xY7!"\n' + "".join(f"A{i + 1} = A{i} + A{i}\n" for i in range(200)) + "secret = A200"
    assert literals(doubling) == ["aB3$xY7!"]
    chain = 'secret0 = "aB3xY7qq"\n' + "".join(f'secret{i + 1} = secret{i} + "q{i}"\n' for i in range(5000))
    assert len(literals(chain)) == 5001


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "token = abcdef1234", "x"), (2, None, None)], "doc_id long, text string, spans string")
    rows = scan_secrets(docs).collect()
    assert rows[0].spans == "x" and rows[1].secret_spans == []
    assert scan_secrets(docs.limit(0)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = PLANS["op2_secret_scan"][0](spark, sf).collect()
    assert len(rows) == len(docs)
    for row in rows:
        want = brute(docs[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(row.spans.split(",")) | {""}
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
