"""Manifest quality: rules, reconciliation with files, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import is_blank, is_placeholder, normalize_filename
from folioflow.sources.manifest import OUTCOMES, STATUSES

# Fixed values of the manifest contract.
FILENAME_PATTERN = r"^[a-z0-9_]+\.(html|pdf)$"
FOLDER_PATTERN = r"^\d{2,}$"
SHA256_PATTERN = r"^[a-f0-9]{64}$"
ACT_ID_PATTERN = r"^[a-z0-9_]+$"
FIRST_YEAR, LAST_YEAR = 1860, 2100
TEXT_LIMITS = {"case_id": 100, "case_name": 300, "citation": 300, "court": 100, "primary_section": 50}
CHECKS = ("schema", "missing", "pairing", "normalization", "orphan", "hash_drift")
CONFIDENCE = ("low", "medium", "high")
APPROVE_AT, REVIEW_AT = 0.6, 0.4
MAX_REASONING = 500
# How much of an answer that cannot be used is shown in its note.
SHOWN_CHARS = 160
QUOTA_MARKS = ("RESOURCE_EXHAUSTED", "429", "exceeded your current quota")


def sha_or_null(col: Column) -> Column:
    return col.isNull() | col.rlike(SHA256_PATTERN)


def length_between(col: Column, low: int, high: int) -> Column:
    return F.length(col).between(low, high)


def file_rules(name: str, ending: str) -> dict[str, Column]:
    col = F.col(name)
    return {
        f"{name}_length": length_between(col, 1, 200),
        f"{name}_pattern": col.rlike(FILENAME_PATTERN),
        f"{name}_ending": col.endswith(ending),
    }


def act_rules() -> dict[str, Column]:
    """Field rules of a declared act."""
    return {
        "act_id_length": length_between(F.col("act_id"), 1, 50),
        "act_id_pattern": F.col("act_id").rlike(ACT_ID_PATTERN),
        "act_name": length_between(F.col("act_name"), 1, 200),
        "short_name": length_between(F.col("short_name"), 1, 20),
        **file_rules("filename", ".pdf"),
        "source_url": F.length("source_url") >= 1,
        "retrieved_date": F.col("retrieved_date").isNotNull(),
        "sha256": sha_or_null(F.col("sha256")),
    }


def judgment_rules() -> dict[str, Column]:
    """Field rules of a declared judgment."""
    score = F.col("relevance_score")
    return {
        "folder_length": length_between(F.col("folder"), 2, 4),
        "folder_number": F.col("folder").rlike(FOLDER_PATTERN),
        **{c: length_between(F.col(c), 1, n) for c, n in TEXT_LIMITS.items()},
        "year": F.col("year").between(FIRST_YEAR, LAST_YEAR),
        "other_sections": F.col("other_sections").isNotNull(),
        "outcome": F.col("outcome").isin(*OUTCOMES),
        "source_url": F.length("source_url") >= 1,
        **file_rules("html_filename", ".html"),
        **file_rules("pdf_filename", ".pdf"),
        "retrieved_date": F.col("retrieved_date").isNotNull(),
        "html_sha256": sha_or_null(F.col("html_sha256")),
        "pdf_sha256": sha_or_null(F.col("pdf_sha256")),
        "status": F.col("status").isin(*STATUSES),
        "relevance_score": score.isNull() | score.between(0.0, 1.0),
    }


def validate_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` per broken rule; a rule that yields null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    named = df.select(key, F.explode_outer(F.array_compact(F.array(*broken))).alias("rule"))
    return named.filter("rule is not null")


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Declared files that are not there.

    A folder that is missing as a whole gives one row, without a file name.
    """
    files = listing.select("folder", "filename").distinct()
    folders = files.select("folder").distinct().withColumn("__there", F.lit(True))
    absent = manifest.select("folder", "filename").join(files, ["folder", "filename"], "left_anti")
    marked = absent.join(folders, "folder", "left")
    return marked.select(
        "folder",
        F.when(F.col("__there"), F.col("filename")).alias("filename"),
        F.when(F.col("__there"), "file").otherwise("folder").alias("missing"),
    ).distinct()


def orphan_files(listing: DataFrame, manifest: DataFrame, acts: DataFrame) -> DataFrame:
    """Files nobody declared: number folders against the manifest, top-level PDFs against the acts."""
    folders = listing.filter(F.col("folder").rlike(r"^\d+$")).select("folder").distinct()
    stray_folders = folders.join(manifest.select("folder").distinct(), "folder", "left_anti")
    pdfs = listing.filter(F.col("folder").isNull() & F.lower("filename").endswith(".pdf")).select("filename")
    stray_pdfs = pdfs.join(acts.select("filename").distinct(), "filename", "left_anti")
    return stray_folders.select(F.lit("folder").alias("kind"), F.col("folder").alias("name")).unionByName(
        stray_pdfs.select(F.lit("pdf").alias("kind"), F.col("filename").alias("name"))
    )


def check_pairs(listing: DataFrame) -> DataFrame:
    """Folders without exactly one HTML and one PDF of the same stem; counts come first."""
    is_html, is_pdf = F.lower("filename").endswith(".html"), F.lower("filename").endswith(".pdf")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    folders = (
        listing.filter(F.col("folder").rlike(FOLDER_PATTERN))
        .groupBy("folder")
        .agg(
            F.count_if(is_html).alias("n_html"),
            F.count_if(is_pdf).alias("n_pdf"),
            F.max(F.when(is_html, stem)).alias("html_stem"),
            F.max(F.when(is_pdf, stem)).alias("pdf_stem"),
        )
    )
    problem = (
        F.when(F.col("n_html") != 1, F.concat(F.lit("html count "), F.col("n_html").cast("string")))
        .when(F.col("n_pdf") != 1, F.concat(F.lit("pdf count "), F.col("n_pdf").cast("string")))
        .when(F.col("html_stem") != F.col("pdf_stem"), F.lit("stems differ"))
    )
    return folders.select("folder", problem.alias("problem")).filter("problem is not null")


def plan_renames(files: DataFrame, name: str = "filename") -> DataFrame:
    """``source``, ``target`` and whether nothing changes."""
    planned = files.withColumn("source", F.col(name)).withColumn("target", normalize_filename(F.col(name)))
    return planned.withColumn("is_noop", F.col("source") == F.col("target"))


def rename_collisions(plans: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Plans that share their target with another file of the same scope, with the group size."""
    keys = [*scope, "target"]
    crowded = plans.groupBy(*keys).agg(F.count("*").alias("n_sources")).filter("n_sources > 1")
    return plans.join(crowded, keys)


def hash_drift(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored hashes that differ from the computed ones."""
    joined = manifest.filter("stored_sha256 is not null").join(listing.select("folder", "sha256"), "folder")
    return joined.filter("stored_sha256 <> sha256").select("folder", "stored_sha256", "sha256")


def declared_pairs(manifest: DataFrame, key: str) -> DataFrame:
    """Records whose two declared file names differ in their stems."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    html, pdf = stem(F.col("html_filename")), stem(F.col("pdf_filename"))
    return manifest.filter(html != pdf).select(key, html.alias("html_stem"), pdf.alias("pdf_stem"))


def backfill_hashes(manifest: DataFrame, listing: DataFrame, failures: DataFrame) -> DataFrame:
    """Manifest with computed hashes, unless any check failed: then it stays as it is."""
    clean = failures.agg(F.count("*").alias("n")).scalar() == 0
    computed = listing.select("folder", F.col("sha256").alias("__computed"))
    joined = manifest.join(computed, "folder", "left")
    filled = F.when(clean, F.coalesce("__computed", "stored_sha256")).otherwise(F.col("stored_sha256"))
    return joined.withColumn("stored_sha256", filled).drop("__computed")


def _no_failure(failures: DataFrame) -> Column:
    return failures.agg(F.count("*").alias("n")).scalar() == 0


def backfill_judgments(judgments: DataFrame, listing: DataFrame, failures: DataFrame) -> DataFrame:
    """Judgments with ``html_sha256`` and ``pdf_sha256`` of the files in their folder.

    Both are overwritten where both declared files are there, neither where one
    is missing, and nothing at all if any check failed.
    """
    own = lambda name, out: listing.select("folder", F.col("filename").alias(name), F.col("sha256").alias(out))
    joined = judgments.join(own("html_filename", "__html"), ["folder", "html_filename"], "left").join(
        own("pdf_filename", "__pdf"), ["folder", "pdf_filename"], "left"
    )
    fills = _no_failure(failures) & F.col("__html").isNotNull() & F.col("__pdf").isNotNull()
    filled = {"html_sha256": F.col("__html"), "pdf_sha256": F.col("__pdf")}
    return joined.select(*[F.when(fills, filled[c]).otherwise(F.col(c)).alias(c) if c in filled else c for c in judgments.columns])


def backfill_acts(acts: DataFrame, listing: DataFrame, failures: DataFrame) -> DataFrame:
    """Acts with the ``sha256`` of their file, which lies outside any folder; unless any check failed."""
    computed = listing.filter("folder is null").select("filename", F.col("sha256").alias("__computed"))
    joined = acts.join(computed, "filename", "left")
    filled = F.when(_no_failure(failures), F.coalesce("__computed", "sha256")).otherwise(F.col("sha256"))
    return joined.select(*[filled.alias(c) if c == "sha256" else c for c in acts.columns])


def verification_summary(spark, findings: dict[str, DataFrame]) -> DataFrame:
    """Count per check over all six checks; a check without findings shows zero."""
    categories = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    counted = None
    for check, rows in findings.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "n")
        counted = part if counted is None else counted.unionByName(part)
    totals = counted.groupBy("check").agg(F.sum("n").alias("n"))
    return categories.join(totals, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"))


def audit_placeholders(
    df: DataFrame, key: str, fields: tuple[str, ...], status: str | None = "approved"
) -> DataFrame:
    """Records with fields still to be filled in, and which."""
    rows = df if status is None else df.filter(F.col("status") == status)
    missing = F.array_compact(F.array(*[F.when(is_placeholder(F.col(f)), F.lit(f)) for f in fields]))
    return rows.select(key, missing.alias("missing")).filter(F.size("missing") > 0)


def bootstrap_manifest(listing: DataFrame, as_of_year: int) -> DataFrame:
    """Draft manifest rows from ``listing(folder, filename)``.

    First file of each kind by name; names, year and document id are guessed
    from the stem of the HTML file, or of the PDF without one.
    """
    is_html, is_pdf = F.lower("filename").endswith(".html"), F.lower("filename").endswith(".pdf")
    folders = (
        listing.filter(F.col("folder").rlike(FOLDER_PATTERN))
        .groupBy("folder")
        .agg(
            F.min(F.when(is_html, F.col("filename"))).alias("html"),
            F.min(F.when(is_pdf, F.col("filename"))).alias("pdf"),
            (F.count_if(is_html) == 1).alias("__one_html"),
            (F.count_if(is_pdf) == 1).alias("__one_pdf"),
        )
    )
    html_stem = F.regexp_replace("html", r"\.[^.]*$", "")
    pdf_stem = F.regexp_replace("pdf", r"\.[^.]*$", "")
    staged = folders.select(
        "*",
        F.coalesce(html_stem, pdf_stem, F.lit("unknown")).alias("stem"),
        F.coalesce(F.when(html_stem.rlike(r"^\d+$"), html_stem), F.when(pdf_stem.rlike(r"^\d+$"), pdf_stem)).alias(
            "source_doc_id"
        ),
    )
    stem = F.col("stem")
    years = F.filter(
        F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.rlike(r"^(18[6-9]\d|19\d{2}|20\d{2})$")
    )
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return staged.select(
        "folder",
        F.when(slug == "", F.concat(F.lit("folder_"), "folder")).otherwise(F.substring(slug, 1, 100)).alias("case_id"),
        guess_case_name(stem).alias("case_name"),
        F.coalesce(F.try_element_at(years, F.lit(-1)).cast("int"), F.lit(as_of_year)).alias("year"),
        "source_doc_id",
        F.coalesce("html", F.lit("todo_missing.html")).alias("html_filename"),
        F.coalesce("pdf", F.lit("todo_missing.pdf")).alias("pdf_filename"),
        (F.col("__one_html") & F.col("__one_pdf")).alias("pair_ok"),
        F.lit("pending").alias("status"),
    )


# What may stand behind the case name in a file name.
NAME_END = r"(?:\s+\d{4}\s*)?(?:(?i:[\s,]+on\s+)\d{1,2}[\s,]+\w+[\s,]+\d{4}\s*)?$"


def guess_case_name(stem: Column) -> Column:
    """Readable name of a stem: its words with capitals, ``v.`` between the parties, no year or date at the end."""
    name = F.btrim(F.regexp_extract(F.translate(stem, "_", " "), r"(?s)^(.*?)" + NAME_END, 1), F.lit(" ,.;"))
    words = F.split(name, r"\s+")

    def shown(word: Column, i: Column) -> Column:
        between = (F.lower(word) == "vs") & (i > 0) & (i < F.size(words) - 1)
        return F.when(between | (F.lower(word) == "v."), "v.").otherwise(F.initcap(word))

    return F.when(stem.rlike(r"^\d+$"), F.lit("TODO: case name")).otherwise(F.array_join(F.transform(words, shown), " "))


def merge_fills(
    base: DataFrame, fills: DataFrame, fields: tuple[str, ...], min_confidence: str = "high", force: bool = False
) -> DataFrame:
    """What becomes of each fill: ``(folder, field, old_value, new_value, outcome)``.

    ``fills(folder, field, value, confidence)``; a null confidence is a flat
    fill, which no threshold holds back.  Outcomes: ``applied``,
    ``low_confidence``, ``blank``, ``existing``, ``unchanged``, ``not_found``.
    """
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value")) for f in fields]
    current = base.select("folder", F.inline(F.array(*pairs)), F.lit(True).alias("__known"))
    wanted = fills.filter(F.col("field").isin(*fields))
    joined = wanted.join(current, ["folder", "field"], "left")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence")), F.lit(0))
    low = F.col("confidence").isNotNull() & (F.greatest(rank, F.lit(1)) < CONFIDENCE.index(min_confidence) + 1)
    same = F.col("old_value").eqNullSafe(F.col("value"))
    kept = ~is_placeholder(F.col("old_value")) & F.lit(not force)
    outcome = (
        F.when(F.col("__known").isNull(), "not_found")
        .when(low, "low_confidence")
        .when(is_blank(F.col("value")), "blank")
        .when(same, "unchanged")
        .when(kept, "existing")
        .otherwise("applied")
    )
    return joined.select("folder", "field", "old_value", F.col("value").alias("new_value"), outcome.alias("outcome"))


def apply_fills(base: DataFrame, decisions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Manifest with the applied fills."""
    applied = decisions.filter("outcome = 'applied'").groupBy("folder").agg(
        *[F.max(F.when(F.col("field") == f, F.col("new_value"))).alias(f"__{f}") for f in fields]
    )
    types = dict(base.dtypes)
    joined = base.join(applied, "folder", "left")
    return joined.select(
        *[F.coalesce(F.col(f"__{c}").cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def fill_outcomes(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("outcome").agg(F.count("*").alias("n"))


def select_pending(df: DataFrame, force: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Entries to process: the pending ones, or all; only those of a key set if given."""
    rows = df if only is None else df.join(only.select("folder").distinct(), "folder", "left_semi")
    return rows if force else rows.filter(F.col("status") == "pending")


def select_stale(current: DataFrame, processed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose key and content hash the previous output does not have."""
    return current.join(processed.select(*keys).distinct(), list(keys), "left_anti")


def merge_verdicts(manifest: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Apply classifier verdicts ``(folder, response, failure)``.

    A response must be a JSON object with exactly the three known keys, a
    score in 0..1 and a reasoning of 1..500 characters.  Anything else sends
    the entry to review with a note; a quota failure leaves it untouched.
    """
    parsed = F.from_json("response", "is_relevant boolean, relevance_score double, reasoning string")
    keys = F.array_sort(F.json_object_keys("response"))
    rows = verdicts.select("folder", "response", "failure", parsed.alias("v"), keys.alias("keys"))
    reasoning = F.trim(F.col("v.reasoning"))
    valid = (
        F.col("failure").isNull()
        & (F.col("keys") == F.array(*[F.lit(k) for k in ("is_relevant", "reasoning", "relevance_score")]))
        & F.col("v.is_relevant").isNotNull()
        & F.col("v.relevance_score").between(0.0, 1.0)
        & F.length(reasoning).between(1, MAX_REASONING)
    )
    note = F.concat(
        F.lit("classifier failure: "),
        F.coalesce("failure", F.concat(F.lit("answer is not a complete verdict: "), F.substring("response", 1, SHOWN_CHARS))),
    )
    quota = F.lit(False)
    for mark in QUOTA_MARKS:
        quota = quota | F.contains(note, F.lit(mark))
    settled = rows.select(
        "folder",
        F.coalesce(valid, F.lit(False)).alias("__valid"),
        F.col("v.relevance_score").alias("__score"),
        reasoning.alias("__reasoning"),
        note.alias("__note"),
        quota.alias("__quota"),
    ).filter(F.col("__valid") | ~F.coalesce("__quota", F.lit(False)))
    joined = manifest.join(settled, "folder", "left")
    ok, failed = F.coalesce("__valid", F.lit(False)), F.coalesce(~F.col("__valid"), F.lit(False))
    status = (
        F.when(ok & (F.col("__score") >= APPROVE_AT), "approved")
        .when(ok & (F.col("__score") >= REVIEW_AT), "needs-review")
        .when(ok, "rejected")
        .when(failed, "needs-review")
        .otherwise(F.col("status"))
    )
    old_notes = F.nullif(F.col("manual_review_notes"), F.lit(""))
    return joined.select(
        *[c for c in manifest.columns if c not in ("status", "relevance_score", "classifier_reasoning", "manual_review_notes")],
        status.alias("status"),
        F.when(ok, F.col("__score")).otherwise(F.col("relevance_score")).alias("relevance_score"),
        F.when(ok, F.col("__reasoning")).otherwise(F.col("classifier_reasoning")).alias("classifier_reasoning"),
        F.when(failed, F.concat_ws(" | ", old_notes, F.col("__note"))).otherwise(F.col("manual_review_notes")).alias(
            "manual_review_notes"
        ),
    )
