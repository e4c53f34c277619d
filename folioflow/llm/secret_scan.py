"""Secrets in source and configuration text.

Base patterns find assignments, access keys and hexadecimal runs.  On top of
them an assignment-aware lexer reads ``name = literal`` pairs (``=``, ``:``,
``:=``, ``=>``, ``+=``, quoted names, strings with up to three quotes and prefixes,
``$NAME``, concatenation by ``+``, within parentheses or after a backslash, over
line ends too), carries constants from the names they were given to, and scores
every literal that reaches a sensitive name.  Its literals are added as ``pair``
spans; base spans stay.  Positions are code points, ends are exclusive.

A name stands for what it was last given, a constant for its literals and the
constants it is made of; what these were at that time stays with it.  A name that
is given something unreadable stands for nothing.  Constants are kept as a graph
with the counts of their characters, so their number and length do not matter.

Null and empty texts have no spans.  Every pattern starts at a fixed boundary
and never backtracks into a name, so very long texts take linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import table, text_or_empty

# The base patterns, the lengths they need and the order of kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "pair")

# A name, its closing quote, an operator.  Names start at a boundary.
TARGET = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*+)["'`]?[\x20\t]*+(:=|=>|\+=|==?+|:(?!:))[\x20\t]*+""", re.A)
QUOTED = re.compile(
    r"""(?:[rRbBuUfF]{1,2}(?=["']))?(?:"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}"""
    r"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)"""
)
REFERENCE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_]*+)\}?|([A-Za-z_][A-Za-z0-9_.]*+)(?![A-Za-z0-9_(\[+/=-])", re.A)
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@%^&*-]++", re.A)
# Concatenation on one line or over an end of line, and strings next to each other after a backslash.
JOIN = re.compile(r"""[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?(?:\+[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?)|[\x20\t]*+\\\r?\n[\x20\t]*+(?=["'])""")
PARENTHESIS = re.compile(r"\(\s*+")
JOIN_INSIDE = re.compile(r"""\s*+(?:\+\s*+|(?=["']))""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# How much a word of the target name tells.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "auth": 0.6, "signature": 0.5, "pass": 0.6, "key": 0.3,
    "api": 0.4, "access": 0.4, "private": 0.5, "client": 0.2, "encryption": 0.5, "signing": 0.5,
}
PLACEHOLDERS = {"changeme", "example", "none", "null", "true", "false", "test", "todo"}
FILLERS = "xX", "*", "."
LEAST_SCORE = 1.5
LEAST_LITERAL = 8


class Constant:
    """What a value is made of, and what its score needs: characters with their counts, the first 8 and the last."""

    __slots__ = ("parts", "size", "counts", "head", "tail")

    def __init__(self):
        self.parts: list[Constant | tuple[int, int]] = []
        self.size, self.counts, self.head, self.tail = 0, Counter(), "", ""

    def add(self, part: Constant | tuple[int, int], counts: Counter, size: int, head: str, tail: str) -> None:
        self.parts.append(part)
        self.counts.update(counts)
        self.size += size
        self.head = (self.head + head)[:8]
        self.tail = tail or self.tail

    def literal(self, text: str, span: tuple[int, int]) -> None:
        self.add(span, Counter(text), len(text), text[:8], text[-1:])

    def constant(self, other: Constant) -> None:
        self.add(other, other.counts, other.size, other.head, other.tail)


def name_score(name: str) -> float:
    return min(1.0, sum({w: SENSITIVE.get(w, 0.0) for w in map(str.lower, WORDS.findall(name))}.values()))


def is_placeholder(value: Constant) -> bool:
    if any(all(c in filler for c in value.counts) for filler in FILLERS):
        return True
    head = value.head.lower()
    return head.startswith("your") or (head[:1], value.tail) == ("<", ">") or (value.size <= 8 and head in PLACEHOLDERS)


def literal_score(value: Constant) -> float:
    """0 to 1: entropy and character classes; placeholders, short literals and texts with spaces get none."""
    if value.size < LEAST_LITERAL or is_placeholder(value) or any(map(str.isspace, value.counts)):
        return 0.0
    entropy = -sum(c / value.size * math.log2(c / value.size) for c in value.counts.values())
    classes = sum(any(map(test, value.counts)) for test in (str.isdigit, str.islower, str.isupper))
    return min(1.0, entropy / 5 + 0.15 * (classes - 1))


def read_value(text: str, at: int, known: dict[str, Constant]) -> Constant:
    """The constant at ``at``; without parts where there is none."""
    value, join = Constant(), JOIN
    if found := PARENTHESIS.match(text, at):
        at, join = found.end(), JOIN_INSIDE
    while True:
        if found := QUOTED.match(text, at):
            value.literal(found[found.lastindex], found.span(found.lastindex))
        elif (found := REFERENCE.match(text, at)) and (found[1] or found[2]) in known:
            value.constant(known[found[1] or found[2]])
        elif not value.parts and (found := BARE.match(text, at)) and any(map(str.isdigit, found[0])):
            # An unquoted value; plain words are prose.
            value.literal(found[0], found.span())
            return value
        else:
            return value
        joined = join.match(text, found.end())
        if not joined:
            return value
        at = joined.end()


def pairs(text: str) -> list[tuple[str, int, int, str, float]]:
    known: dict[str, Constant] = {}
    reached: list[tuple[float, int, str, Constant]] = []
    for target in TARGET.finditer(text):
        name, operator = target[1], target[2]
        value = read_value(text, target.end(), known)
        if operator == "+=" and name in known:
            longer = Constant()
            longer.constant(known[name])
            longer.constant(value)
            value = longer
        if operator != "==":  # a comparison gives nothing
            known.pop(name, None)
            if value.size:
                known[name] = value
        if value.size and (by_name := name_score(name)) >= 0.6 and (score := by_name + literal_score(value)) >= LEAST_SCORE:
            reached.append((-score, len(reached), name, value))
    # The best name takes all literals it reaches; later ones find only what is left, so each constant is visited once.
    found, seen = [], set()
    for score, _, name, value in sorted(reached, key=lambda r: r[:2]):
        open_ = [value]
        while open_:
            part = open_.pop()
            key = part if isinstance(part, tuple) else id(part)
            if key in seen:
                continue
            seen.add(key)
            if isinstance(part, Constant):
                open_ += part.parts
            elif part[1] > part[0]:
                found.append(("pair", *part, name, -score))
    return found


def base_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]


def spans_of(text: str | None) -> list[dict]:
    if not text:
        return []
    found = base_spans(text)
    if ":" in text or "=" in text:
        found += pairs(text)
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in found]


SPAN_TYPE = T.ArrayType(
    T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("name", "string").add("score", "double")
)


@F.pandas_udf(SPAN_TYPE)
def secret_spans(texts: pd.Series) -> pd.Series:
    return texts.map(spans_of)


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with one array of spans (kind, start, end, name, score), sorted by start and kind.

    Repeated rows are scanned each, an empty table stays empty, and an own column
    named ``out`` is replaced.
    """
    return docs.withColumn(out, secret_spans(F.col(text_col)))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(shown(F.filter(spans, lambda s: s["kind"] != "pair")), 256).alias("base_sha256"), shown(spans).alias("spans"),
        count("pair").alias("n_pair"),
    )
