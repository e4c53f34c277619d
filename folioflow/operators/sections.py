"""Statute text as lines: page cleaning, contents removal, section split.

All operators work on a line table ``(act_id, page_no, line_no, line)``; one
act may hold a large share of all lines, so nothing here sorts or collects a
whole act in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.running import dealt, line_block, running, task_parts
from folioflow.functions.text import WHITE_SPACE, strip
from folioflow.sources.files import staged

# Fixed patterns of the layout, applied to single lines.
PAGE_NUMBER = r"^\s*\d+\s*$"
TOC_MARKER = r"(?i)ARRANGEMENT\s+OF\s+(SECTIONS|CLAUSES)"
CHAPTER = r"^\s*CHAPTER\s+([IVXLCDM]+|\d+)\s*$"
ANY_HEADING = r"^\s*(Section\s+)?(\d{1,3}[A-Z]{0,2})\.\s+(.{0,200})$"

MIN_REPEATS = 3
MIN_BODY_CHARS = 20
GAP_LIMIT = 5

# Places the pages of one line are dealt to.
PAGE_SALTS = 64

DOC = "act_id"


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1 in its document."""
    kept = [c for c in docs.columns if c != text]
    lines = docs.select(*kept, F.posexplode_outer(F.split(text, "\n")).alias("__pos", "line"))
    return lines.filter("line is not null").select(*kept, (F.col("__pos") + 1).alias("line_no"), "line")


def _is_page_number(stripped: Column) -> Column:
    """Whether a line is a page number; the pattern only looks at lines that begin with a digit."""
    return F.ascii(stripped).between(48, 57) & F.col("line").rlike(PAGE_NUMBER)


def repeating_lines(lines: DataFrame, group: str, page: str, min_repeats: int = MIN_REPEATS, parts: int | None = None) -> DataFrame:
    """Trimmed lines found on several distinct pages of a group; page numbers do not count.

    ``parts`` is the number of partitions the lines are counted in.  Few lines
    occur twice, so they are not combined ahead of the first shuffle.
    """
    # Exploded so that a computed line is made once, not once for every test below.
    trimmed = lines.select(group, page, F.explode_outer(F.array(strip(F.col("line")))).alias("line"))
    wanted = trimmed.filter((F.col("line") != "") & ~_is_page_number(F.col("line")))
    # The pages of a line that all pages share are dealt to several tasks, each of which sends one count on.
    spread = dealt(wanted.withColumn("__salt", F.pmod(F.hash(page), F.lit(PAGE_SALTS))), parts, group, "line", "__salt")
    pages = spread.groupBy(group, "line", "__salt", page).agg(F.lit(1).alias("__one"))
    counts = pages.groupBy(group, "line", "__salt").agg(F.count("*").alias("__n"))
    total = dealt(counts, parts, group, "line").groupBy(group, "line").agg(F.sum("__n").alias("n_pages"))
    return total.filter(F.col("n_pages") >= min_repeats)


def clean_lines(lines: DataFrame, repeating: DataFrame, group: str) -> DataFrame:
    """Lines without page numbers and repeating lines; blanks and tabs squeezed."""
    stripped = strip(F.col("line"))
    # Blank lines never repeat; a key of their own each keeps them from meeting in one task.
    own = F.concat(F.lit(" "), F.col("line_no").cast("string"))
    keyed = lines.withColumn("__key", F.when(stripped == "", own).otherwise(stripped)).filter(~_is_page_number(stripped))
    # At most a third of the lines, mostly far fewer: looked up by hash, so the lines are not sorted.
    drop = repeating.select(group, F.col("line").alias("__key")).hint("shuffle_hash")
    kept = keyed.join(drop, [group, "__key"], "left_anti")
    gaps = F.contains("line", F.lit("\t")) | F.contains("line", F.lit("  "))
    squeezed = F.rtrim(F.when(gaps, F.regexp_replace("line", r"[ \t]+", " ")).otherwise(F.col("line")), F.lit(WHITE_SPACE))
    return kept.withColumn("line", F.when(F.col("__key").startswith(" "), "").otherwise(squeezed)).drop("__key").select(*lines.columns)


def clean_pages(lines: DataFrame, repeating: DataFrame, group: str, page: list[str]) -> DataFrame:
    """Cleaned pages as texts, their lines in order."""
    cleaned = clean_lines(lines, repeating, group)
    collected = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return cleaned.groupBy(*page).agg(F.array_join(collected["line"], "\n").alias("text"))


def _toc_bounds(lines: DataFrame) -> DataFrame:
    """Per act with a contents marker: chapter-one headings after it, and the last of them."""
    marker = F.min(F.when(F.col("line").rlike(TOC_MARKER), F.col("line_no")))
    markers = lines.groupBy(DOC).agg(marker.alias("__marker")).filter("__marker is not null")
    firsts = lines.filter(F.regexp_extract("line", CHAPTER, 1).isin("I", "1")).select(DOC, "line_no")
    joined = markers.join(firsts, DOC, "left")
    after = F.when(F.col("line_no") > F.col("__marker"), F.col("line_no"))
    return joined.groupBy(DOC).agg(F.count(after).alias("n_first"), F.max(after).alias("last_first"))


def skip_toc(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines from the body on, and warnings ``(act_id, warning)``.

    After a contents marker the body starts at the last chapter-one heading,
    given two or more; with fewer the act is kept whole and warned about.
    """
    # One row per act, read by every later pass over the lines.
    bounds = staged(_toc_bounds(lines), "toc-bounds")
    starts = bounds.filter("n_first >= 2").select(DOC, F.col("last_first").alias("__start"))
    body = lines.join(starts, DOC, "left").filter(
        F.col("__start").isNull() | (F.col("line_no") >= F.col("__start"))
    )
    warning = F.when(F.col("n_first") == 1, "one_chapter_heading_after_contents").otherwise(
        "no_chapter_heading_after_contents"
    )
    return body.select(*lines.columns), bounds.filter("n_first < 2").select(DOC, warning.alias("warning"))


def _heading_parts() -> tuple[Column, Column]:
    """Number of a heading line in either form, else empty, and whether it is the long form."""
    return F.regexp_extract("line", ANY_HEADING, 2), F.regexp_extract("line", ANY_HEADING, 1) != ""


def choose_heading_style(lines: DataFrame) -> DataFrame:
    """Per act the heading form that matches more lines; the short form wins ties."""
    number, is_long = _heading_parts()
    votes = lines.groupBy(DOC).agg(
        F.count_if((number != "") & ~is_long).alias("n_standard"), F.count_if(is_long).alias("n_verbose")
    )
    style = F.when(F.col("n_verbose") > F.col("n_standard"), "verbose").otherwise("standard")
    return votes.withColumn("style", style)


def mark_headings(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """Adds ``number`` and ``heading`` on heading lines, null elsewhere."""
    number, is_long = _heading_parts()
    joined = lines.join(styles.select(DOC, (F.col("style") == "verbose").alias("__long")), DOC)
    marked = joined.withColumn("number", F.when((number != "") & (is_long == F.col("__long")), number))
    heading = F.regexp_replace(strip(F.regexp_extract("line", ANY_HEADING, 3)), r"\.+$", "")
    return marked.select(*lines.columns, "number", F.when(F.col("number").isNotNull(), heading).alias("heading"))


def _chapter_line() -> Column:
    """The line number on chapter headings.  A running maximum of it is the last one seen."""
    return F.when(F.col("line").rlike(CHAPTER), F.col("line_no"))


def _chapters(carried: DataFrame) -> DataFrame:
    """``(act_id, __chapter, chapter_number, chapter)`` per chapter heading.

    The title is the first non-blank line after the heading.
    """
    text = strip(F.col("line"))
    numbers = carried.filter(F.col("line").rlike(CHAPTER)).select(
        DOC, F.col("line_no").alias("__chapter"), F.regexp_extract("line", CHAPTER, 1).alias("chapter_number")
    )
    after = carried.filter(F.col("__chapter").isNotNull() & (text != ""))
    first = after.groupBy(DOC, "__chapter").agg(F.min("line_no").alias("line_no"))
    titles = carried.select(DOC, "line_no", text.alias("chapter")).join(first, [DOC, "line_no"])
    return numbers.join(titles.drop("line_no"), [DOC, "__chapter"], "left")


def carry_chapter(lines: DataFrame) -> DataFrame:
    """Adds to each line the last chapter strictly before it, with its title."""
    carried = running(lines, [DOC], ["line_no"], line_block(), {"__chapter": ("max", _chapter_line(), False)})
    joined = carried.join(_chapters(carried), [DOC, "__chapter"], "left")
    return joined.select(*lines.columns, "chapter_number", "chapter")


def split_sections(lines: DataFrame) -> DataFrame:
    """Sections of cleaned body lines: ``(act_id, line_no, number, heading, chapter_number, chapter, body)``.

    A section runs from its heading line to the next.  Lines of a page are
    joined by a line break, pages by a blank line.  ``line_no`` is that of the
    heading.  Short bodies are still included; see ``drop_short``.  The lines
    are read several times, so they should be a stage table.
    """
    marked = mark_headings(lines, choose_heading_style(lines))
    is_heading = F.col("number").isNotNull()
    owned = running(
        marked,
        [DOC],
        ["line_no"],
        line_block(),
        {
            "__start": ("max", F.when(is_heading, F.col("line_no")), True),
            "__chapter": ("max", _chapter_line(), False),
        },
    )
    # Read for the headings, the bodies and the chapters.
    owned = staged(owned, "act-owned-lines")
    # The heading line itself is not part of the body.
    pages = (
        owned.filter(F.col("__start").isNotNull() & ~is_heading)
        .groupBy(DOC, "__start", "page_no")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("part"))
    )
    bodies = pages.groupBy(DOC, "__start").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "part")))["part"], "\n\n").alias("body")
    )
    heads = owned.filter(is_heading).select(DOC, "__start", "number", "heading", "__chapter")
    body = F.coalesce(strip(F.regexp_replace("body", "\n{3,}", "\n\n")), F.lit(""))
    heading = F.col("heading")
    moved = heading.startswith("(") & F.contains(F.substring(heading, 1, 5), F.lit(")"))
    found = heads.join(bodies, [DOC, "__start"], "left").select(
        DOC,
        "__chapter",
        F.col("__start").alias("line_no"),
        "number",
        F.when(moved, "").otherwise(heading).alias("heading"),
        F.when(moved, F.concat(heading, F.lit("\n"), body)).otherwise(body).alias("body"),
    )
    titled = found.join(_chapters(owned), [DOC, "__chapter"], "left")
    return titled.select(DOC, "line_no", "number", "heading", "chapter_number", "chapter", "body")


def drop_short(sections: DataFrame, min_chars: int = MIN_BODY_CHARS) -> tuple[DataFrame, DataFrame]:
    """Sections with enough body, and the numbers of the dropped ones."""
    short = F.length("body") < min_chars
    return sections.filter(~short), sections.filter(short).select(DOC, "line_no", "number")


def _numeric(sections: DataFrame) -> Column:
    return F.when(F.col("number").rlike(r"^\d+$"), F.col("number").cast("int"))


def section_gaps(sections: DataFrame, limit: int = GAP_LIMIT) -> DataFrame:
    """Jumps of more than ``limit`` between consecutive plain numbers."""
    ordered = running(
        sections.withColumn("__n", _numeric(sections)),
        [DOC],
        ["line_no"],
        line_block(),
        {"__before": ("last", F.col("__n"), False)},
    )
    return ordered.filter(F.col("__n") - F.col("__before") > limit).select(
        DOC, "line_no", F.col("__before").alias("from_number"), F.col("__n").alias("to_number")
    )


def monotonic_sections(sections: DataFrame) -> DataFrame:
    """Sections whose plain number exceeds all earlier ones; suffixed numbers always stay."""
    ordered = running(
        sections.withColumn("__n", _numeric(sections)),
        [DOC],
        ["line_no"],
        line_block(),
        {"__top": ("max", F.col("__n"), False)},
    )
    keep = F.col("__n").isNull() | F.col("__top").isNull() | (F.col("__n") > F.col("__top"))
    return ordered.filter(keep).select(*sections.columns)


def annotate(lines: DataFrame) -> DataFrame:
    """Adds to each line what it is: ``chapter`` number, ``marker`` of contents, ``short`` or ``long`` section number, ``rest``.

    Cheap tests stand ahead of the patterns, which few lines match.
    """
    first = F.ascii(F.ltrim("line", F.lit(WHITE_SPACE)))
    numbered = (first.between(48, 57) | (first == ord("S"))) & F.col("line").rlike(r"^\s*(?:Section\s+)?\d{1,3}[A-Z]{0,2}\.\s")
    number, is_long = _heading_parts()
    rest = F.regexp_replace(strip(F.regexp_extract("line", ANY_HEADING, 3)), r"\.+$", "")
    chapter = F.when(F.contains("line", F.lit("CHAPTER")), F.nullif(F.regexp_extract("line", CHAPTER, 1), F.lit("")))
    return lines.select(
        *lines.columns,
        chapter.alias("chapter"),
        F.col("line").rlike(TOC_MARKER).alias("marker"),
        F.when(numbered & ~is_long, F.nullif(number, F.lit(""))).alias("short"),
        F.when(numbered & is_long, F.nullif(number, F.lit(""))).alias("long"),
        F.when(numbered, rest).alias("rest"),
    )


def _act_facts(annotated: DataFrame) -> DataFrame:
    """Per act where the body starts (0 without contents) and whether its headings are of the long form."""
    flags = annotated.filter("marker or chapter in ('I', '1') or short is not null or long is not null")
    first = F.when(F.col("chapter").isin("I", "1"), F.col("line_no"))
    flags = flags.select(DOC, "line_no", "marker", first.alias("first"), F.col("short").isNotNull().alias("is_short"), F.col("long").isNotNull().alias("is_long"))
    markers = flags.groupBy(DOC).agg(F.min(F.when(F.col("marker"), F.col("line_no"))).alias("__marker"))
    after = F.when(F.col("first") > F.col("__marker"), F.col("first"))
    starts = flags.filter("first is not null").join(markers, DOC).groupBy(DOC).agg(F.when(F.count(after) >= 2, F.max(after)).alias("__body"))
    headings = flags.filter("is_short or is_long").join(starts, DOC, "left").withColumn("__body", F.coalesce("__body", F.lit(0)))
    of_body = F.col("line_no") >= F.col("__body")
    votes = F.count_if(of_body & F.col("is_long")) > F.count_if(of_body & F.col("is_short"))
    return headings.groupBy(DOC, "__body").agg(votes.alias("__verbose"))


def parse_act_lines(lines: DataFrame) -> DataFrame:
    """Page cleaning, contents removal, section split and clean-up in one go.

    Cleaned lines are annotated once and stored; every later pass reads flags
    and runs no pattern.  One block-wise pass carries the last heading of either
    form, the last chapter and the last line with text, so the act's facts only
    choose among them.  One grouping of its lines gives the sections and the
    chapter titles, which are stored together: the check of the sections' order
    and the look-up of titles read that table only.  ``lines`` is a stored table.
    """
    cleaned = clean_lines(lines, repeating_lines(lines, DOC, "page_no", parts=task_parts(lines)), DOC)
    annotated = staged(annotate(cleaned), "act-annotated")
    at = F.col("line_no")
    is_chapter, has_text = F.col("chapter").isNotNull(), F.col("line") != ""
    measures = {
        "__short": ("max", F.when(F.col("short").isNotNull(), at), True),
        "__long": ("max", F.when(F.col("long").isNotNull(), at), True),
        "__chapter": ("max", F.when(is_chapter, at), False),
        "__text": ("max", F.when(has_text, at), False),
    }
    carried = running(annotated, [DOC], ["line_no"], line_block(), measures)
    last = F.when(F.col("__verbose"), F.col("__long")).otherwise(F.col("__short"))
    # Lines ahead of the first section have no start; only their titles are kept.
    owned = carried.join(_act_facts(annotated), DOC).filter(at >= F.col("__body"))
    owned = owned.withColumn("__start", F.when(last >= F.col("__body"), last))
    chapter = F.when(F.col("__chapter") >= F.col("__body"), F.col("__chapter"))
    is_heading = at == F.col("__start")
    head = F.struct(F.when(F.col("__verbose"), F.col("long")).otherwise(F.col("short")).alias("number"), F.col("rest").alias("heading"), chapter.alias("__chapter"))
    # The first line with text after a chapter heading is its title.
    is_title = has_text & (F.col("__text") == chapter)
    groups = owned.groupBy(DOC, "__start").agg(
        F.first(F.when(is_heading, head), ignorenulls=True).alias("head"),
        F.sort_array(F.collect_list(F.when(~is_heading, F.struct("line_no", "page_no", "line")))).alias("lines"),
        F.collect_list(F.when(is_title, F.struct(chapter.alias("__chapter"), strip(F.col("line")).alias("chapter")))).alias("titles"),
    )
    # Lines of a page are joined by a line end, pages by a blank line.
    part = "case when i = 0 then x.line when x.page_no = lines[i - 1].page_no then concat('\\n', x.line) else concat('\\n\\n', x.line) end"
    joined = F.array_join(F.expr(f"transform(lines, (x, i) -> {part})"), "")
    body = F.coalesce(strip(F.regexp_replace(joined, "\n{3,}", "\n\n")), F.lit(""))
    heading = F.col("head.heading")
    moved = heading.startswith("(") & F.contains(F.substring(heading, 1, 5), F.lit(")"))
    found = groups.withColumn("__joined", body).select(
        DOC,
        F.col("head.__chapter").alias("__chapter"),
        F.col("__start").alias("line_no"),
        F.col("head.number").alias("number"),
        F.when(moved, "").otherwise(heading).alias("heading"),
        F.when(moved, F.concat(heading, F.lit("\n"), "__joined")).otherwise(F.col("__joined")).alias("body"),
        "titles",
    )
    # Written with the short ones: a filter on the body ahead of this would build every body twice.
    found = staged(found, "act-sections")
    titles = found.select(DOC, F.inline("titles"))
    numbers = annotated.filter(is_chapter).select(DOC, at.alias("__chapter"), F.col("chapter").alias("chapter_number"))
    kept, _ = drop_short(found.filter("line_no is not null").drop("titles"))
    titled = monotonic_sections(kept).join(numbers.join(titles, [DOC, "__chapter"], "left"), [DOC, "__chapter"], "left")
    return titled.select(DOC, "line_no", "number", "heading", "chapter_number", "chapter", "body")
