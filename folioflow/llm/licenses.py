"""Licence scans: text units against licence templates by Dice over word bigrams.

Units are the whole text, its paragraphs, its lines and runs of adjacent lines,
lower-cased and without punctuation.  For sets of word bigrams A (unit) and B
(template)

    dice = 2 |A and B| / (|A| + |B|)

can only reach ``threshold`` t when ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``.
These bounds prune: first units by their number of words (distinct words bound
distinct bigrams from below), then templates per unit by the exact sizes.
A unit also shares ``t / (2 - t)`` of B at least.  Runs are only made where the
whole text does so, have a number of words within the bounds, and at least that
many bigrams of B, repeats included, in and between their lines.  All of it is one narrow pass of built-in expressions; the shuffle that follows
carries one small row per document and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import running_sums, table, text_or_empty

THRESHOLD = 0.8

# Notices and texts of public licences, by SPDX id where there is one.
TEMPLATES = (
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
    compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
    an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
    specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
    provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
    above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
    General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
    option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
    without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
    License for more details."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
    hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
    associated documentation files (the "Software"), to deal in the Software without restriction, including without
    limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
    Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of
    the Software."""),
)

DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Whole texts of the licences whose templates above are only their first part. The twin has the notices alone.
WHOLE = (
    ("BSD-2-Clause", dict(TEMPLATES)["BSD-2-Clause"] + " " + DISCLAIMER),
    ("BSD-3-Clause", dict(TEMPLATES)["BSD-2-Clause"] + """ 3. Neither the name of the copyright holder nor the names of its
    contributors may be used to endorse or promote products derived from this software without specific prior written
    permission. """ + DISCLAIMER),
    ("GPL-3.0", dict(TEMPLATES)["GPL-3.0"] + """ You should have received a copy of the GNU General Public License along
    with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("ISC", dict(TEMPLATES)["ISC"] + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
    REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
    BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
    OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
    CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", dict(TEMPLATES)["MIT"] + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
    INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
    IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE."""),
)

PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK_LINES = r"\n *(\n *)+"


def normal(text: Column) -> Column:
    """Lower case, punctuation and white space but line ends to one space."""
    return F.regexp_replace(F.lower(text), PUNCTUATION, " ")


def unit_words(unit: Column) -> Column:
    return F.filter(F.split(F.replace(unit, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")


def pairs(words: Column) -> Column:
    joined = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) >= 2, joined).otherwise(F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    return F.array_distinct(pairs(words))


def template_rows(spark, templates) -> list[tuple[str, list[str]]]:
    """(id, bigrams) of the templates by the same expressions as the texts; as long as the list of templates."""
    if not templates:
        return []
    frame = spark.createDataFrame([(i, t) for i, t in templates], "id string, text string")
    words = frame.select("id", unit_words(normal(F.col("text"))).alias("words"))
    rows = words.select("id", bigrams(F.col("words")).alias("b")).filter("size(b) > 0").collect()
    return sorted((r.id, list(r.b)) for r in rows)


def text_units(norm: Column) -> Column:
    """(unit, text) structs: lines always, paragraphs and the document where there are several lines."""
    lines = F.split(norm, "\n")
    paragraphs = F.split(norm, BLANK_LINES)
    tagged = lambda name, texts: F.transform(texts, lambda t: F.struct(F.lit(name).alias("unit"), t.alias("text")))
    whole = F.when(F.size(lines) > 1, tagged("document", F.array(norm))).otherwise(F.array())
    parts = F.when(F.size(paragraphs) > 1, tagged("paragraph", paragraphs)).otherwise(F.array())
    return F.concat(tagged("line", lines), parts, whole)


def literal(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def reaches(known: list[tuple[str, list[str]]], low: float) -> Column:
    """Whether ``_shared`` has enough bigrams of a template."""
    found = F.lit(False)
    for _, b in known:
        found |= (F.size("_shared") >= low * len(b)) & (F.size(F.array_intersect("_shared", literal(b))) >= low * len(b))
    return found


def run_units(known: list[tuple[str, list[str]]], low: float, high: float) -> Column:
    """(unit, text) structs: runs of two lines with words and more that can reach a template, from ``_lines`` and ``_shared``."""
    size = F.size("_lines")
    words = running_sums(F.transform("_lines", lambda line: F.size(line)))

    def reached(template: list[str]) -> Column:
        least, most = low * len(template), high * len(template)
        hits = running_sums(F.transform("_lines", lambda line: F.size(F.filter(pairs(line), lambda b: b.isin(template)))))

        def ends(sums: Column) -> Column:
            def fits(i: Column, j: Column) -> Column:
                inside = lambda name: F.get(sums[name], j) - F.get(sums[name], i - 1)
                return (inside("words") - 1 >= least) & (inside("words") - 1 <= most) & (inside("hits") + (j - i) >= least)

            # Each line has a word at least, so no run has more lines than words.
            last = lambda i: F.least(size, i + F.lit(int(most) + 1))
            return F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.filter(F.sequence(i + 1, last(i)), lambda j: fits(i, j)), lambda j: F.struct(i.alias("i"), j.alias("j")))))

        found = F.flatten(F.transform(F.array(F.struct(words.alias("words"), hits.alias("hits"))), ends))
        enough = (F.size("_shared") >= least) & (F.size(F.array_intersect("_shared", literal(template))) >= least)
        return F.when((size >= 2) & enough, found).otherwise(F.array().cast("array<struct<i:int,j:int>>"))

    spans = F.array_distinct(F.concat(*[reached(b) for _, b in known]))
    text = lambda r: F.array_join(F.flatten(F.slice("_lines", r["i"], r["j"] - r["i"] + 1)), " ")
    return F.transform(spans, lambda r: F.struct(F.lit("run").alias("unit"), text(r).alias("text")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + WHOLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its id, license_id, dice, unit and n_matches (units that reach the threshold).

    Runs of lines overlap, so all that reach one license_id count as one match,
    and as none where a line, paragraph or the document has it already.
    Null and empty texts, and texts without a licence, have a null license_id,
    unit and dice and no matches.  Of several matches the highest dice counts,
    then the smallest id, then the smallest unit name.
    """
    known = template_rows(docs.sparkSession, templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = min((low * len(b) for _, b in known), default=1)
    most = max((high * len(b) for _, b in known), default=0)
    units = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), normal(text_or_empty(text_col)).alias("_norm"))
    union = sorted({b for _, template in known for b in template})
    units = units.withColumn("_words", unit_words(F.col("_norm")))
    units = units.withColumn("_shared", F.array_distinct(F.filter(pairs(F.col("_words")), lambda b: b.isin(union))))
    units = units.withColumn("_lines", F.when(reaches(known, low), F.filter(F.transform(F.split("_norm", "\n"), unit_words), lambda line: F.size(line) > 0)))
    # Where the whole text shares too little with each template, no unit can reach one.
    nothing = F.array(F.struct(F.lit("line").alias("unit"), F.lit("").alias("text")))
    every = F.concat(text_units(F.col("_norm")), run_units(known, low, high)) if known else nothing
    every = F.when(F.col("_lines").isNotNull(), every).otherwise(nothing)
    units = units.select(id_col, "_row", F.explode_outer(every).alias("u")).select(id_col, "_row", "u.unit", unit_words(F.col("u.text")).alias("_words"))
    fits = (F.size("_words") - 1 >= least) & (F.size(F.array_distinct("_words")) - 1 <= most)
    units = units.withColumn("_bigrams", F.when(fits, bigrams(F.col("_words")))).drop("_words")
    size = F.size("_bigrams")

    def scored(license_id: str, template: list[str]) -> Column:
        n = len(template)
        shared = F.size(F.array_intersect("_bigrams", literal(template)))
        dice = shared.cast("double") * 2 / (size + n)
        return F.when(size.between(low * n, high * n), F.struct((-dice).alias("miss"), F.lit(license_id).alias("license_id")))

    scores = F.array(*[scored(i, b) for i, b in known]) if known else F.array().cast("array<struct<miss:double,license_id:string>>")
    best = F.array_min(F.filter(scores, lambda s: s["miss"] <= -threshold))
    units = units.withColumn("_best", F.when(F.col("_bigrams").isNotNull(), best))
    run = F.col("unit") == "run"
    found = units.groupBy("_row", id_col).agg(
        F.min(F.when(F.col("_best").isNotNull(), F.struct("_best.miss", "_best.license_id", "unit"))).alias("_hit"),
        F.count(F.when(~run, F.col("_best"))).alias("_single"),
        F.collect_set(F.when(run, F.col("_best.license_id"))).alias("_by_run"), F.collect_set(F.when(~run, F.col("_best.license_id"))).alias("_by_single"),
    )
    matches = F.col("_single") + F.size(F.array_except("_by_run", "_by_single"))
    return found.select(id_col, F.col("_hit.license_id").alias("license_id"), (-F.col("_hit.miss")).alias("dice"), F.col("_hit.unit").alias("unit"), matches.alias("n_matches"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_VALUES = ",\n  ".join("('{}', '{}')".format(i, " ".join(t.split()).replace("'", "''")) for i, t in TEMPLATES)

OP7_SQL = rf"""
with templates(license_id, text) as (values
  {_VALUES}
), tw as (
  select license_id, list_filter(string_split(regexp_replace(lower(text), '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') as w from templates
), t as (
  select license_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from tw
), d as (
  select doc_id, regexp_replace(lower(coalesce(text, '')), '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g') as norm from documents
), u as (
  select doc_id, 'line' as unit, unnest(string_split(norm, chr(10))) as s from d
  union all select doc_id, 'document', norm from d where contains(norm, chr(10))
  union all select doc_id, 'paragraph', unnest(string_split_regex(norm, '\n *(?:\n *)+')) from d where regexp_matches(norm, '\n *\n')
), uw as (
  select doc_id, unit, list_filter(string_split(replace(s, chr(10), ' '), ' '), lambda w: w <> '') as w from u
), ub as (
  select row_number() over () as id, doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b
  from uw where len(w) > 1
), s as (
  select id, doc_id, unit, license_id, 2.0::double * len(list_intersect(ub.b, t.b)) / (len(ub.b) + len(t.b)) as dice
  from ub join t on len(ub.b) between 0.6 * len(t.b) and 1.6 * len(t.b)
), m as (select * from s where dice >= 0.8),
best as (
  select doc_id, license_id, dice, unit from m qualify row_number() over (partition by doc_id order by dice desc, license_id, unit) = 1
), n as (select doc_id, count(distinct id) as n_matches from m group by doc_id)
select d.doc_id, license_id, dice, unit, coalesce(n_matches, 0) as n_matches
from d left join best using (doc_id) left join n using (doc_id)
"""
