"""URL rules by a cascade of Bloom filters.

A rule is a host and a path prefix.  A url's keys are all its host's suffixes
(at label boundaries) joined with its path's prefixes of the lengths that rules
have; the keys of all urls are the universe.  Level 1 of the cascade encodes
the listed keys, level 2 the universe's keys that level 1 takes wrongly for
listed ones, level 3 the listed keys that level 2 takes for such, and so on
until nothing is wrong.  For every key of the universe the parity of the first
level that rejects it is the exact answer, so urls are judged by expressions
over a few literal bit arrays: no join, no shuffle, no Python.

The size of level 1 follows the universe: its error rate is about listed keys
over all keys, so level 2 is no larger than the list.  What stands in the plan
is ``1.44 * log2(keys / listed)`` bits per listed key and grows with the list,
not with the urls; ``max_bytes`` bounds it and raises an error beyond.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import lower_ascii, staged, table

# Action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT_VERDICT = "allow"
LEVELS = 30
MAX_BYTES = 64 << 20


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, ``hashes`` probes, its own seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def bits(self, key: Column) -> list[Column]:
        size = F.lit(64 * len(self.words)).cast("long")
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), size) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        # One literal, folded once by the optimizer.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for bit in self.bits(key):
            word = F.get(words, F.floor(bit / 64).cast("int"))
            found = found & (F.call_function("shiftrightunsigned", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return found


def build_level(keys: DataFrame, n_keys: int, bits_per_key: float, seed: int, max_bytes: int) -> Level:
    """Set bits are gathered by word in Spark; only the words come back, ``bits_per_key * n_keys`` bits."""
    n_words = max(1, math.ceil(n_keys * bits_per_key / 64))
    if 8 * n_words > max_bytes:
        raise ValueError(f"a level of {8 * n_words} bytes exceeds max_bytes={max_bytes}")
    hashes = max(1, min(16, round(64 * n_words / max(n_keys, 1) * math.log(2))))
    level = Level((0,) * n_words, hashes, seed)
    bits = keys.select(F.explode(F.array(*level.bits(F.col("key")))).alias("bit"))
    rows = bits.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("value")
    )
    words = [0] * n_words
    for row in rows.collect():
        words[row.word] = row.value
    return Level(tuple(words), hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES, deeper_bits: float = 4.0) -> list[Level]:
    """Levels for the listed keys over ``universe``; both have a column ``key``.

    ``universe`` may repeat keys.  Keys are compared as they are; null keys are
    never listed.
    """
    listed = staged(listed.select("key").filter("key is not null").distinct(), "url-listed")
    n_listed = listed.count()
    if n_listed == 0:
        return []
    n_all = max(universe.agg(F.approx_count_distinct("key")).first()[0], n_listed)
    levels: list[Level] = []
    inside, bits = listed, max(deeper_bits, 1.44 * math.log2(max(2.0, n_all / n_listed)))
    n_inside = n_listed
    outside = None
    for seed in range(LEVELS):
        levels.append(build_level(inside, n_inside, bits, seed, max_bytes))
        if seed == 0:
            wrong = universe.filter(levels[0].has(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti")
        else:
            wrong = outside.filter(levels[-1].has(F.col("key")))
        wrong = staged(wrong, "url-wrong")
        n_wrong = wrong.count()
        if n_wrong == 0:
            return levels
        inside, outside, n_inside, bits = wrong, inside, n_wrong, deeper_bits
    raise RuntimeError(f"the cascade did not end after {LEVELS} levels")


def listed_by(levels: list[Level], key: Column) -> Column:
    """Exact membership for keys of the universe: an odd number of passed levels means listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels), 0, -1):
        answer = F.when(~levels[depth - 1].has(key), F.lit(depth % 2 == 0)).otherwise(answer)
    return answer


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host`` (A-Z lower-cased) and ``path``; both empty where the url is null or has no ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.regexp_replace(F.col(url), r"(?s)^.*?://", ""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(lower_ascii(host), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def url_keys(lengths: Sequence[int], host: Column, path: Column) -> Column:
    """All (host suffix, path prefix) keys of a url, longest first; a longer host wins among equal lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.length(path) >= n)
    pairs = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                fits,
                lambda n: F.struct(
                    (-F.length(s) - n).alias("length"), (-F.length(s)).alias("host"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")
                ),
            ),
        )
    )
    return F.transform(F.array_sort(pairs), lambda p: p["key"])


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string").select(
        "action", F.length("path").alias("length"), F.concat(lower_ascii(F.col("host")), "path").alias("key")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has action (allow or block), length (of the path) and key (host
    and path).  Every rule whose host is the url's host or a parent domain and
    whose path starts the url's path fits; the longest key wins.  A key listed
    for both actions blocks.  Without a fitting rule ``rule`` is null and the
    verdict is ``default``: the cascade knows the url is not listed.  Own
    columns of ``pages`` named like results are replaced.
    """
    pages = with_host_path(pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c in pages.columns]), url)
    # The lengths of rule paths, a handful of small numbers.
    lengths = sorted(r[0] for r in rules.select("length").distinct().collect())
    if not lengths:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = pages.withColumn("_keys", url_keys(lengths, F.col("host"), F.col("path")))
    universe = keyed.select(F.explode("_keys").alias("key"))
    listed = build_cascade(rules, universe, max_bytes)
    blocked = build_cascade(rules.filter("action = 'block'"), universe, max_bytes)
    rule = F.get(F.filter("_keys", lambda k: listed_by(listed, k)), F.lit(0))
    judged = keyed.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(listed_by(blocked, F.col("rule")), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict).drop("_keys")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
with r(action, host, path) as (values
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), u as (
  select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) end as rest from pages
), p as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from u
), best as (
  select p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.action, length(r.host || r.path)) as action
  from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by p.page_id
)
select p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') as verdict
from p left join best b using (page_id)
"""
