"""Page text and metadata: paragraphs, excerpts, court, citation, section, URL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.html import read_page
from folioflow.functions.running import line_block, neighbours, running
from folioflow.functions.ranking import top_k
from folioflow.functions.text import EXCERPT_CHARS, EXCERPT_MIN_CHARS, WHITE_SPACE, excerpt, strip_markup
from folioflow.sources.files import staged

# Fixed values of the extraction contract.
MIN_PARAGRAPH_CHARS = 30
MIN_BODY_PARAGRAPHS = 3
HEAD_CHARS = 3000
COURT_WORDS = ("supreme court", "high court", "district court", "sessions", "magistrate", "tribunal")
TITLE_COURTS = ("Supreme Court", "High Court")
# Citation forms in order of preference; the first group is the year.
CITATION_PATTERNS = (
    r"(?i)\(\s*(\d{4})\s*\)\s*\d+\s*SCC\s*\d+",
    r"(?i)AIR\s+(\d{4})\s+SC\s+\d+",
    r"(?i)\(\s*(\d{4})\s*\)\s*\d+\s*SCC\s*\(Cri\)\s*\d+",
    r"(?i)(\d{4})\s*Cri\.?\s*LJ\s*\d+",
    r"(?i)MANU/[A-Z]{2}/\d+/(\d{4})",
)
FILENAME_YEAR = r"(?i)_on_(?:\d+_)?[a-z]+_(\d{4})\.html?$"
SECTION_REF = (
    r"(?i)(?:section|sec\.?|s\.|§)\s*(\d{1,4})"
    r"|\b(\d{1,4})\s*(?:IPC|BNS|of\s+the\s+(?:Indian\s+Penal\s+Code|Bharatiya\s+Nyaya\s+Sanhita))"
)
FIRST_CODE, SECOND_CODE = (378, 402), (303, 313)
CONFIDENCE = ("high", "medium", "low")

# Pages that a task holds parsed at once.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20

# A model of so many words, with so many bytes in them, is copied to the tasks.
MODEL_WORDS, MODEL_BYTES = 1 << 19, 8 << 20

PAGE_FIELDS = "has_container boolean, paragraphs array<string>, title string, court string, headings array<string>, parse_error string"


def parse_pages(pages: DataFrame, key: str = "page_id", whole_token: bool = False) -> DataFrame:
    """One parse of every page: ``(key, has_container, paragraphs, title, court, headings, parse_error)``.

    A page that breaks the parser yields its error and no paragraphs; the
    others go on.
    """
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), *T.StructType.fromDDL(PAGE_FIELDS).fields])
    empty = {"has_container": False, "paragraphs": [], "title": None, "court": None, "headings": []}
    strings = pa.list_(pa.string())
    kinds = [pa.bool_(), strings, pa.string(), pa.string(), strings, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                rows = []
                for html in batch.column(1):
                    try:
                        found = read_page(html.as_py() or "", MIN_PARAGRAPH_CHARS, whole_token)
                        rows.append((*(found[name] for name in empty), None))
                    except Exception as problem:
                        rows.append((*empty.values(), f"{type(problem).__name__}: {problem}"))
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([batch.column(0), *columns], schema.names)

    return pages.select(key, "html").mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``PIECE_ROWS`` rows and, but for a single longer page, ``PIECE_BYTES`` bytes of pages."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (held + size > PIECE_BYTES or at - start >= PIECE_ROWS):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def extract_paragraphs(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    return parsed.select(key, F.posexplode("paragraphs").alias("paragraph_index", "text"))


def parse_warnings(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    n = F.size("paragraphs")
    found = F.array_compact(
        F.array(
            F.when(F.col("parse_error").isNotNull(), F.concat(F.lit("parser failed: "), "parse_error")),
            F.when(~F.col("has_container"), F.lit("no container found; used the whole body")),
            F.when(n < MIN_BODY_PARAGRAPHS, F.format_string("only %d paragraph(s)", n)),
            F.when(n == 0, F.lit("no paragraphs")),
        )
    )
    return parsed.select(key, F.explode(found).alias("warning"))


def assemble_documents(
    paragraphs: DataFrame, warnings: DataFrame, entries: DataFrame, key: str = "page_id"
) -> tuple[DataFrame, DataFrame]:
    """Entries with their ordered paragraphs and warnings, and the entries without any paragraph."""
    texts = paragraphs.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))).alias("paragraphs")
    )
    notes = warnings.groupBy(key).agg(F.array_sort(F.collect_set("warning")).alias("parse_warnings"))
    documents = entries.join(texts, key).join(notes, key, "left")
    documents = documents.withColumn("parse_warnings", F.coalesce("parse_warnings", F.array().cast("array<string>")))
    return documents, entries.join(texts.select(key), key, "left_anti")


def excerpts(df: DataFrame, text: str = "text", max_chars: int = EXCERPT_CHARS) -> DataFrame:
    """Adds ``excerpt`` and ``failure``: too little text to judge."""
    cut = df.withColumn("excerpt", excerpt(strip_markup(F.col(text)), max_chars))
    short = F.length("excerpt") < EXCERPT_MIN_CHARS
    return cut.withColumn(
        "failure", F.when(short, F.format_string("only %d characters of text", F.length("excerpt")))
    )


def extract_court(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, court, confidence)``: marked element, else heading with a court word, else title."""
    pattern = "|".join(COURT_WORDS)
    heading = F.try_element_at(F.filter("headings", lambda h: F.lower(h).rlike(pattern)), F.lit(1))
    title = F.lit(None).cast("string")
    for name in reversed(TITLE_COURTS):
        title = F.when(F.contains("title", F.lit(name)), F.lit(f"{name} (inferred from title)")).otherwise(title)
    return parsed.select(
        key,
        F.coalesce("court", heading, title).alias("court"),
        F.when(F.col("court").isNotNull(), "high").when(heading.isNotNull(), "medium").otherwise("low").alias("confidence"),
    )


def _first_match(text: Column, group: int) -> Column:
    """First citation by pattern order, not by position; null without a match."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in CITATION_PATTERNS])


def extract_citation(df: DataFrame, text: str = "text", filename: str = "filename") -> DataFrame:
    """Adds citation, year and their confidence.

    The head of the text first, then all of it, then the year of the filename.
    """
    head, whole = F.substring(text, 1, HEAD_CHARS), F.col(text)
    staged = df.select(
        "*", _first_match(head, 0).alias("__head"), _first_match(head, 1).alias("__head_year"),
        F.regexp_extract(filename, FILENAME_YEAR, 1).alias("__name_year"),
    )
    # The body is only searched where the head has nothing.
    staged = staged.withColumn("__body", F.when(F.col("__head").isNull(), _first_match(whole, 0)))
    staged = staged.withColumn("__body_year", F.when(F.col("__head").isNull(), _first_match(whole, 1)))
    name_year = F.nullif(F.col("__name_year"), F.lit(""))
    found = F.when(F.col("__head").isNotNull(), "high").when(F.col("__body").isNotNull(), "medium")
    return staged.select(
        *df.columns,
        F.coalesce("__head", "__body").alias("citation"),
        found.otherwise("low").alias("citation_confidence"),
        F.coalesce("__head_year", "__body_year", name_year).cast("int").alias("year"),
        found.when(name_year.isNotNull(), "medium").otherwise("low").alias("year_confidence"),
    )


# Words of a reference that may end a line, and with what the next one then goes on.
REFERENCE_ENDS = r"(?i)(section|sec\.?|s\.|§|\d|of|the|indian|penal|bharatiya|nyaya)\s*$"
REFERENCE_GOES_ON = (
    r"(?i)^(?:(?:section|sec\.?|s\.|§) \d|\d (?:ipc|bns|of)|of the|the (?:indian|bharatiya)"
    r"|indian penal|penal code|bharatiya nyaya|nyaya sanhita)"
)


def section_references(df: DataFrame, key: str, position: str, text: str = "line") -> DataFrame:
    """In-range section numbers ``(key, position, nth, section)`` found in a text column.

    The result is that of one search over the whole text of a key, its lines
    joined by line ends: a reference may go on over any number of lines, blank
    ones between them, and matches do not overlap.  Lines are only put together
    where one ends in a word of a reference that the next line with text can go
    on with, so no match reaches over the end of such a run, and a key is as
    many runs as it has other lines.  ``position`` names the line in which the
    run starts, ``nth`` counts within it.  Null and blank lines hold nothing.
    """
    lines = df.select(key, F.col(position).alias(position), F.col(text).alias("__line")).filter(F.col("__line").rlike(r"\S"))
    lines = lines.withColumn("__head", F.substring(F.regexp_replace("__line", r"^\s+", ""), 1, 9))
    lines = lines.withColumn("__tail", F.coalesce(F.regexp_extract(F.right(F.rtrim("__line", F.lit(WHITE_SPACE)), F.lit(24)), REFERENCE_ENDS, 1), F.lit("")))
    block = line_block(position)
    near = neighbours(lines, [key], position, block, {"__next": ("next", "__head"), "__last": ("previous", "__tail")})
    goes_on = lambda tail, head: F.coalesce((tail != "") & F.concat_ws(" ", tail, head).rlike(REFERENCE_GOES_ON), F.lit(False))
    marked = near.select(
        key, position, "__line", goes_on(F.col("__tail"), F.col("__next")).alias("__open"), goes_on(F.col("__last"), F.col("__head")).alias("__before")
    )
    # Read for lines that stand alone and, several times, for the few in runs.
    marked = staged(marked, "line-runs")
    alone = marked.filter("not (__open or __before)").select(key, position, F.col("__line").alias("__text"))
    starts = {"__run": ("max", F.when(~F.col("__before"), F.col(position)), True)}
    runs = running(marked.filter("__open or __before"), [key], [position], block, starts)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "__line"))), lambda x: x["__line"]), "\n")
    joined = runs.groupBy(key, "__run").agg(whole.alias("__text")).withColumnRenamed("__run", position)
    found = alone.unionByName(joined.select(key, position, "__text"))
    # Numbers are read ahead of the explode: a filter on them after it would read each one several times.
    numbers = F.transform(F.regexp_extract_all("__text", F.lit(SECTION_REF), F.lit(0)), lambda m: F.regexp_extract(m, r"\d{1,4}", 0).try_cast("int"))
    numbered = found.select(key, position, F.posexplode_outer(numbers).alias("nth", "section"))
    return numbered.filter(F.col("section").between(*FIRST_CODE) | F.col("section").between(*SECOND_CODE))


def dominant_section(references: DataFrame, docs: DataFrame, key: str, position: str) -> DataFrame:
    """Most mentioned section per document, ties to the one first seen.

    High confidence if alone or with three times the mentions of the next.
    """
    counts = references.groupBy(key, "section").agg(
        F.count("*").alias("mentions"), F.min(F.struct(position, "nth")).alias("__first")
    )
    leaders = top_k(counts, [key], [F.desc("mentions"), F.asc("__first")], 2)
    leader, second = F.col("rank") == 1, F.col("rank") == 2
    ranked = leaders.groupBy(key).agg(
        F.max(F.when(leader, F.col("section"))).alias("section"),
        F.max(F.when(leader, F.col("mentions"))).alias("mentions"),
        F.max(F.when(second, F.col("mentions"))).alias("runner_up"),
    )
    code = F.when(F.col("section").between(*SECOND_CODE), F.lit(" BNS")).otherwise(F.lit(" IPC"))
    sure = F.col("runner_up").isNull() | (F.col("mentions") >= 3 * F.col("runner_up"))
    joined = docs.select(key).distinct().join(ranked, key, "left")
    return joined.select(
        key,
        F.concat(F.col("section").cast("string"), code).alias("primary_section"),
        "mentions",
        "runner_up",
        F.when(F.col("section").isNull(), "low").when(sure, "high").otherwise("medium").alias("confidence"),
    )


def canonical_url(pages: DataFrame, domain: str, html: str = "html", known_id: str = "known_id") -> DataFrame:
    """Adds ``canonical_url`` and ``url_confidence``.

    Known id, ``og:url``, canonical link, saved-from comment, then any document
    address of the domain on the page.
    """
    host = domain.replace(".", r"\.")
    doc_id = rf"(?i){host}/doc/(\d+)/?"
    text = F.col(html)

    def present(value: Column, test: Column | None = None) -> Column:
        return F.when((value != "") & (F.lit(True) if test is None else test), value)

    def address(number: Column) -> Column:
        return F.when(number != "", F.concat(F.lit(f"https://{domain}/doc/"), number, F.lit("/")))

    og = F.regexp_extract(text, r'(?i)<meta[^>]*property="og:url"[^>]*content="([^"]*)"', 1)
    link = F.regexp_extract(text, r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)
    saved = F.regexp_extract(text, r"(?i)saved from url=\(\d+\)([^\s>]+)", 1)
    sure = F.coalesce(
        address(F.coalesce(F.col(known_id).cast("string"), F.lit(""))),
        present(og, F.contains(og, F.lit(domain))),
        present(link, F.contains(link, F.lit(domain))),
        address(F.regexp_extract(saved, doc_id, 1)),
    )
    anywhere = address(F.regexp_extract(text, doc_id, 1))
    staged = pages.withColumn("__sure", sure)
    staged = staged.withColumn("__any", F.when(F.col("__sure").isNull(), anywhere))
    confidence = F.when(F.col("__sure").isNotNull(), "high").when(F.col("__any").isNotNull(), "medium").otherwise("low")
    return staged.withColumn("canonical_url", F.coalesce("__sure", "__any")).withColumn("url_confidence", confidence).drop(
        "__sure", "__any"
    )


def confidence_summary(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Field by confidence counts; ``fields`` maps a field name to its confidence column."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(c).alias("confidence")) for f, c in fields.items()]
    long = df.select(F.inline(F.array(*pairs)))
    return long.groupBy("field").agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCE])


def relevance_scores(train: DataFrame, docs: DataFrame, key: str, text: str = "text", max_words: int = MODEL_WORDS) -> DataFrame:
    """``key``, ``relevance_score`` (0..1) and ``status`` by multinomial naive Bayes.

    ``train(key, text, label)`` may overlap ``docs``.  The model is two counts
    per word and four totals, from one aggregate each; words the training
    texts do not have say nothing.  Log-odds are cut at +-30, far beyond the
    six decimals of the score.

    A stored model of up to ``max_words`` words is copied to the tasks, where
    the words of a text are summed as they lie: one row per text is shuffled.
    A larger one is joined to the texts' word counts.
    """
    from folioflow.operators.quality import APPROVE_AT, REVIEW_AT

    words = lambda df, *keep: df.select(*keep, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))).alias("term"))
    one = F.col("label") == 1
    counts = words(train, "label").groupBy("term").agg(F.count_if(one).alias("pos"), F.count_if(~one).alias("neg"))
    counts = staged(counts, "relevance-counts")
    totals = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("*").alias("terms"))
    prior = train.agg(F.log((F.count_if(one) + 1.0) / (F.count_if(~one) + 1.0)).alias("odds"))
    pos, neg, terms = (totals.select(c).scalar() for c in ("pos", "neg", "terms"))
    odds = F.log((F.col("pos") + 1.0) / (pos + terms)) - F.log((F.col("neg") + 1.0) / (neg + terms))
    weights = counts.select("term", odds.alias("odds"))
    size = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    if size.n <= max_words and size.bytes <= MODEL_BYTES:
        found = words(docs, key).join(F.broadcast(weights), "term")
        sums = found.groupBy(key).agg(F.sum("odds").alias("odds"))
    else:
        tf = words(docs, key).groupBy(key, "term").agg(F.count("*").alias("tf"))
        sums = tf.join(weights, "term").groupBy(key).agg(F.sum(F.col("tf") * F.col("odds")).alias("odds"))
    total = prior.select("odds").scalar() + F.coalesce("odds", F.lit(0.0))
    score = F.round(1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0)))), 6)
    scored = docs.select(key).join(sums, key, "left").select(key, score.alias("relevance_score"))
    status = F.when(F.col("relevance_score") >= APPROVE_AT, "approved").when(F.col("relevance_score") >= REVIEW_AT, "needs-review")
    return scored.withColumn("status", status.otherwise("rejected"))
