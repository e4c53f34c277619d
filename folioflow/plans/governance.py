"""Registered queries over manifests, listings and JSON-lines stages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow import fixtures as fx
from folioflow.functions.ranking import duplicate_keys
from folioflow.operators import quality as q
from folioflow.session import stage_path
from folioflow.sources import files, manifest as mf

FILL_FIELDS = ("citation", "source_url", "year")
AUDIT_FIELDS = ("citation", "source_url", "html_filename")


def declared(spark, sf):
    return fx.manifest(spark, sf).withColumnRenamed("html_filename", "filename")


def trimmed_manifest(spark, sf):
    padded = fx.manifest(spark, sf).withColumn("citation", F.concat(F.lit(" \t"), "citation", F.lit("\n ")))
    return mf.trim_strings(padded)


def corpus_listing(spark, sf):
    return files.list_pages(fx.table(spark, sf, "pages")).withColumn("length", F.col("length").cast("bigint"))


LINE_SCHEMA = T.StructType([T.StructField("source_type", T.StringType()), T.StructField("k", T.LongType())])


def json_lines(spark, sf):
    return fx.table(spark, sf, "events").selectExpr(
        "event_id",
        """case when event_id % 10 = 0 then substr(props, 1, 4)
             when event_id % 10 = 1 then '  '
             when event_id % 10 = 2 then concat('{"source_type":"note","k":', get_json_object(props, '$.k'), '}')
             else concat('{"source_type":"', case when event_id % 2 = 0 then 'act' else 'judgment' end, '","k":', get_json_object(props, '$.k'), '}')
           end as line""",
    )


def tolerant_lines(spark, sf):
    known = F.col("record.source_type").isin("act", "judgment")
    parsed = files.parse_json_lines(json_lines(spark, sf), "line", LINE_SCHEMA, known)
    return parsed.select("event_id", "outcome", F.when(F.col("outcome") == "ok", F.col("record.k")).alias("k"))


def strict_lines(spark, sf):
    """Write the good lines as a JSON stage and read them back strictly."""
    path = stage_path(spark, "lines")
    files.write_stage(fx.table(spark, sf, "events").select(F.col("props").alias("value")), path, "text")
    read = files.read_jsonl_strict(spark, path, T.StructType([T.StructField("k", T.LongType())]))
    return read.groupBy("k").agg(F.count("*").alias("n"))


def stage_roundtrip(spark, sf):
    path = stage_path(spark, "manifest")
    files.write_stage(fx.manifest(spark, sf), path)
    return spark.read.parquet(path)


def rules():
    return {
        "filename": F.col("html_filename").rlike(q.FILENAME_PATTERN),
        "folder": F.col("folder").rlike(q.FOLDER_PATTERN),
        "sha256": q.sha_or_null(F.col("stored_sha256")),
        "status": F.col("status").isin(*mf.STATUSES),
        "year": F.col("year").between(q.FIRST_YEAR, q.LAST_YEAR),
        "citation_length": q.length_between(F.col("citation"), 1, 300),
        "url_length": F.length("source_url") >= 1,
    }


def rule_violations(spark, sf):
    return q.validate_rules(fx.manifest(spark, sf), "folder", rules())


# Views of both record types, in words that both engines understand.
ACTS = """lower(replace(p_name, ' ', case when p_partkey % 9 = 0 then ' ' else '_' end)) as act_id,
  case when p_partkey % 8 = 0 then repeat('n', 201) else p_name end as act_name,
  case when p_partkey % 7 = 0 then concat(p_brand, ' ', p_brand, ' and more') else p_brand end as short_name,
  case p_partkey % 10 when 0 then 'Act.PDF' when 1 then concat('act_', cast(p_partkey as {t}), '.html') else concat('act_', cast(p_partkey as {t}), '.pdf') end as filename,
  case when p_partkey % 6 = 0 then '' else concat('https://example.org/', cast(p_partkey as {t})) end as source_url,
  case when p_partkey % 25 <> 0 then date '2024-01-01' + cast(p_partkey % 300 as int) end as retrieved_date,
  case p_partkey % 4 when 0 then null when 1 then upper({sha}(p_name{bits})) else {sha}(p_name{bits}) end as sha256"""
JUDGMENTS = """case when page_id % 11 = 0 then concat('f', cast(page_id as {t})) when page_id < 10 then concat('0', cast(page_id as {t})) else cast(page_id as {t}) end as folder,
  case when page_id % 31 = 0 then '' else concat('case_', cast(page_id as {t})) end as case_id,
  case when page_id % 14 = 0 then repeat('n', 301) else concat('A', cast(page_id as {t}), ' v. B') end as case_name,
  case when page_id % 13 = 0 then '' else concat('(2020) 1 SCC ', cast(page_id as {t})) end as citation,
  case when page_id % 19 = 0 then repeat('c', 101) else 'High Court' end as court, cast(1850 + page_id % 260 as int) as year,
  case when page_id % 23 = 0 then null else cast(378 + page_id % 25 as {t}) end as primary_section,
  case when page_id % 29 <> 0 then {array} end as other_sections,
  case page_id % 6 when 0 then 'conviction-upheld' when 1 then 'conviction-set-aside' when 2 then 'bail-granted' when 3 then 'bail-denied' when 4 then 'other' else 'unknown' end as outcome,
  url as source_url, case when page_id % 2 = 0 then cast(page_id as {t}) end as source_doc_id,
  case page_id % 16 when 0 then 'Bad Name.HTML' when 1 then concat('page_', cast(page_id as {t}), '.pdf') else concat('page_', cast(page_id as {t}), '.html') end as html_filename,
  case page_id % 18 when 0 then '' when 1 then concat('page_', cast(page_id as {t}), '.html') else concat('page_', cast(page_id as {t}), '.pdf') end as pdf_filename,
  case when page_id % 37 <> 0 then date '2024-01-01' + cast(page_id % 300 as int) end as retrieved_date,
  case page_id % 5 when 0 then null when 1 then 'abc' else {sha}(html{bits}) end as html_sha256,
  case page_id % 4 when 0 then null when 1 then upper({sha}(url{bits})) else {sha}(url{bits}) end as pdf_sha256,
  case page_id % 5 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' when 3 then 'needs-review' else 'done' end as status,
  case when page_id % 3 <> 0 then cast(page_id % 13 as double) / 10 end as relevance_score,
  cast(null as {t}) as classifier_reasoning, case when page_id % 4 = 0 then 'seen' end as manual_review_notes"""
SPARK_WORDS = {"t": "string", "sha": "sha2", "bits": ", 256", "array": "array('379', cast(page_id % 9 as string))"}
DUCK_WORDS = {"t": "varchar", "sha": "sha256", "bits": "", "array": "['379', cast(page_id % 9 as varchar)]"}


def declared_acts(spark, sf):
    fx.table(spark, sf, "part").createOrReplaceTempView("governance_part")
    return spark.sql(f"select p_partkey, {ACTS.format(**SPARK_WORDS)} from governance_part")


def judgments(spark, sf):
    fx.table(spark, sf, "pages").createOrReplaceTempView("governance_pages")
    return spark.sql(f"select page_id, {JUDGMENTS.format(**SPARK_WORDS)} from governance_pages")


def act_violations(spark, sf):
    return q.validate_rules(declared_acts(spark, sf), "p_partkey", q.act_rules())


def judgment_violations(spark, sf):
    return q.validate_rules(judgments(spark, sf), "page_id", q.judgment_rules())


def stored_judgments(spark, sf):
    """Written with padding, read back under the closed schema."""
    path = stage_path(spark, "judgments")
    rows = judgments(spark, sf).drop("page_id").withColumn("citation", F.concat(F.lit(" \t"), "citation", F.lit("\n")))
    rows.withColumn("unknown_field", F.lit(1)).write.json(path)
    return mf.read_manifest(spark, path, mf.JUDGMENT_SCHEMA)


def repeated_names(spark, sf):
    return duplicate_keys(fx.manifest(spark, sf), "html_filename")


def missing(spark, sf):
    return q.missing_files(declared(spark, sf), fx.listing(spark, sf))


def orphans(spark, sf):
    return q.orphan_files(fx.file_listing(spark, sf), fx.manifest(spark, sf), fx.declared_acts(spark, sf))


def pairs(spark, sf):
    return q.check_pairs(fx.file_listing(spark, sf))


def part_files(spark, sf):
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey", "concat(' ', p_name, '; (v', cast(p_partkey % 3 as string), ')__', p_brand, '.', 'PDF') as filename"
    )


def renames(spark, sf):
    bare = fx.table(spark, sf, "part").filter("p_partkey % 100 = 0").selectExpr("-p_partkey as p_partkey", "p_name as filename")
    planned = q.plan_renames(part_files(spark, sf).unionByName(bare))
    return planned.select("p_partkey", "source", "target", "is_noop")


def collisions(spark, sf):
    return q.rename_collisions(q.plan_renames(part_files(spark, sf))).select("p_partkey", "target", "n_sources")


def drift(spark, sf):
    return q.hash_drift(fx.manifest(spark, sf), fx.listing(spark, sf))


def backfill(spark, sf):
    m, listing = fx.manifest(spark, sf), fx.listing(spark, sf)
    none = q.hash_drift(m.filter("stored_sha256 is null"), listing)
    filled = q.backfill_hashes(m, listing, none).withColumn("checks", F.lit("clean"))
    kept = q.backfill_hashes(m, listing, q.hash_drift(m, listing)).withColumn("checks", F.lit("failed"))
    return filled.unionByName(kept).select("folder", "checks", "stored_sha256")


def hashed_files(spark, sf):
    return fx.file_listing(spark, sf).withColumn("sha256", F.sha2(F.concat_ws("/", "folder", "filename"), 256))


def backfill_pairs(spark, sf):
    """Judgments once without a failed check, once with some."""
    m = fx.manifest(spark, sf).selectExpr("folder", "html_filename", "pdf_filename", "stored_sha256 as html_sha256", "case when year % 2 = 0 then stored_sha256 end as pdf_sha256")
    drifted = q.hash_drift(fx.manifest(spark, sf), fx.listing(spark, sf))
    filled = q.backfill_judgments(m, hashed_files(spark, sf), drifted.filter("false")).withColumn("checks", F.lit("clean"))
    kept = q.backfill_judgments(m, hashed_files(spark, sf), drifted).withColumn("checks", F.lit("failed"))
    return filled.unionByName(kept).drop("html_filename", "pdf_filename")


def backfill_act_files(spark, sf):
    acts = fx.declared_acts(spark, sf).withColumn("sha256", F.when(F.length("filename") % 2 == 0, F.sha2("filename", 256)))
    return q.backfill_acts(acts, hashed_files(spark, sf), acts.filter("false"))


def check_summary(spark, sf):
    violations = rule_violations(spark, sf)
    return q.verification_summary(
        spark,
        {
            "schema": violations.filter("rule <> 'filename'"),
            "normalization": violations.filter("rule = 'filename'"),
            "missing": missing(spark, sf),
            "orphan": orphans(spark, sf),
            "hash_drift": drift(spark, sf),
            "pairing": q.declared_pairs(fx.manifest(spark, sf), "folder"),
        },
    )


def placeholders(spark, sf):
    found = q.audit_placeholders(fx.manifest(spark, sf), "folder", AUDIT_FIELDS)
    return found.select("folder", F.array_join("missing", ",").alias("missing"))


BOOT_FILES = """
 case page_id % 6 when 0 then cast(page_id * 1000 as {text})
   when 1 then concat('ram_vs_state_of_x_on_12_march_', cast(1950 + page_id % 70 as {text}))
   when 2 then concat('ram KUMAR_vs_state_', cast(1900 + page_id % 150 as {text}))
   when 3 then 'a_1234_b_1875_c-d' when 4 then '_no__year_here_' else 'only_pdf_2001' end"""


def bootstrap(spark, sf):
    stems = fx.table(spark, sf, "pages").selectExpr(
        "page_id", "lpad(cast(page_id as string), 6, '0') as folder", BOOT_FILES.format(text="string") + " as stem"
    )
    listing = stems.selectExpr(
        "folder",
        """explode(filter(array(
             case when page_id % 6 <> 5 then concat(stem, '.html') end,
             case when page_id % 3 = 0 or page_id % 6 = 5 then concat(stem, '.pdf') end,
             case when page_id % 8 = 0 then 'zz_extra.html' end), x -> x is not null)) as filename""",
    )
    return q.bootstrap_manifest(listing, 2024)


def fills(spark, sf):
    labels = fx.table(spark, sf, "labels")
    return labels.selectExpr(
        "lpad(cast(doc_id as string), 6, '0') as folder",
        """inline(array(
             named_struct('field', 'citation', 'value', case when doc_id % 9 = 0 then ' ' else concat('(2021) 1 SCC ', cast(doc_id as string)) end,
               'confidence', case doc_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' end),
             named_struct('field', 'source_url', 'value', case when doc_id % 7 = 0 then null else concat('https://example.org/', cast(doc_id as string)) end,
               'confidence', cast(case when doc_id % 2 = 0 then 'high' end as string)),
             named_struct('field', 'year', 'value', cast(1850 + doc_id % 260 as string), 'confidence', 'medium')))""",
    )


def decisions(spark, sf):
    return q.merge_fills(fx.manifest(spark, sf), fills(spark, sf), FILL_FIELDS, "medium")


def fill_decisions(spark, sf):
    return decisions(spark, sf)


def fill_counts(spark, sf):
    forced = q.merge_fills(fx.manifest(spark, sf), fills(spark, sf), FILL_FIELDS, "high", force=True)
    return q.fill_outcomes(decisions(spark, sf)).withColumn("mode", F.lit("medium")).unionByName(
        q.fill_outcomes(forced).withColumn("mode", F.lit("high_forced"))
    )


def filled_manifest(spark, sf):
    m = fx.manifest(spark, sf)
    return q.apply_fills(m, decisions(spark, sf), FILL_FIELDS).select("folder", *FILL_FIELDS)


def pending(spark, sf):
    m, listing = fx.manifest(spark, sf), fx.listing(spark, sf)
    first = q.select_pending(m).select("folder", F.lit("pending").alias("kind"))
    some = q.select_pending(m, force=True, only=listing).select("folder", F.lit("forced").alias("kind"))
    done = m.filter("stored_sha256 is not null").select("folder", F.col("stored_sha256").alias("sha256"))
    stale = q.select_stale(listing, done, ("folder", "sha256")).select("folder", F.lit("stale").alias("kind"))
    return first.unionByName(some).unionByName(stale)


VERDICT = """case page_id % 9
   when 0 then '{{"is_relevant": true, "relevance_score": 0.9, "reasoning": "on topic"}}'
   when 1 then '{{"is_relevant": true, "relevance_score": 0.45, "reasoning": " partly "}}'
   when 2 then '{{"is_relevant": false, "relevance_score": 0.1, "reasoning": "off topic"}}'
   when 3 then '{{"is_relevant": true, "relevance_score": 1.2, "reasoning": "too sure"}}'
   when 4 then '{{"is_relevant": true, "relevance_score": 0.7}}'
   when 5 then '{{"is_relevant": true, "relevance_score": 0.7, "reasoning": "x", "extra": 1}}'
   when 6 then '{{"is_relevant": tr' else null end"""
FAILURE = "case page_id % 9 when 7 then 'call failed: 429 RESOURCE_EXHAUSTED' when 8 then 'only 12 characters of text' end"


def verdicts(spark, sf):
    rows = fx.table(spark, sf, "pages").selectExpr(
        "lpad(cast(page_id as string), 6, '0') as folder", VERDICT.format() + " as response", f"{FAILURE} as failure"
    )
    m = fx.manifest(spark, sf).select(
        "folder",
        "status",
        F.lit(None).cast("double").alias("relevance_score"),
        F.lit(None).cast("string").alias("classifier_reasoning"),
        F.when(F.col("status") == "approved", "seen").alias("manual_review_notes"),
    )
    return q.merge_verdicts(m, rows)


RULES_SQL = f"""v as (
 select folder, 'filename' as rule from manifest where not regexp_matches(html_filename, '^[a-z0-9_]+[.](html|pdf)$')
 union all select folder, 'folder' from manifest where not regexp_matches(folder, '^[0-9]{{2,}}$')
 union all select folder, 'sha256' from manifest where stored_sha256 is not null and not regexp_matches(stored_sha256, '^[a-f0-9]{{64}}$')
 union all select folder, 'status' from manifest where status not in ('pending', 'approved', 'rejected', 'needs-review')
 union all select folder, 'year' from manifest where year not between 1860 and 2100
 union all select folder, 'citation_length' from manifest where length(citation) not between 1 and 300
 union all select folder, 'url_length' from manifest where length(source_url) < 1)"""
MISSING_SQL = """ms as (select distinct m.folder, case when m.folder in (select folder from listing) then m.html_filename end as filename,
   case when m.folder in (select folder from listing) then 'file' else 'folder' end as missing
 from manifest m where not exists (select 1 from listing l where l.folder = m.folder and l.filename = m.html_filename))"""
ORPHAN_SQL = """orp as (select distinct 'folder' as kind, folder as name from file_listing where folder is not null and folder not in (select folder from manifest)
 union all select 'pdf', filename from file_listing where folder is null and filename not in (select filename from declared_acts))"""
NORM_SQL = """case when not contains(source, '.') then source else
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(source, '^(.*)\\.([^.]*)$', 1)), '[.,&''"():;?!/\\\\]', '', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')
  || '.' || lower(regexp_extract(source, '^(.*)\\.([^.]*)$', 2)) end"""
PART_SQL = "select p_partkey, concat(' ', p_name, '; (v', cast(p_partkey % 3 as varchar), ')__', p_brand, '.', 'PDF') as source from part"
FILLS_SQL = """fl as (select lpad(cast(doc_id as varchar), 6, '0') as folder, 'citation' as field, case when doc_id % 9 = 0 then ' ' else concat('(2021) 1 SCC ', cast(doc_id as varchar)) end as value,
   case doc_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' end as confidence from labels
 union all select lpad(cast(doc_id as varchar), 6, '0'), 'source_url', case when doc_id % 7 = 0 then null else concat('https://example.org/', cast(doc_id as varchar)) end, case when doc_id % 2 = 0 then 'high' end from labels
 union all select lpad(cast(doc_id as varchar), 6, '0'), 'year', cast(1850 + doc_id % 260 as varchar), 'medium' from labels),
 cur as (select folder, 'citation' as field, citation as old_value from manifest union all select folder, 'source_url', source_url from manifest union all select folder, 'year', cast(year as varchar) from manifest),
 j as (select f.*, c.old_value, c.folder is not null as known, case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 end as rk from fl f left join cur c on c.folder = f.folder and c.field = f.field)"""


def outcome_sql(min_rank: int, force: bool) -> str:
    keep = "false" if force else "not (old_value is null or trim(old_value) = '' or starts_with(trim(old_value), 'TODO'))"
    return f"""case when not known then 'not_found' when rk < {min_rank} then 'low_confidence' when value is null or trim(value) = '' then 'blank'
 when old_value is not distinct from value then 'unchanged' when {keep} then 'existing' else 'applied' end"""


FILE_RULES = """{f}_length: length({f}) between 1 and 200; {f}_pattern: regexp_matches({f}, '^[a-z0-9_]+[.](html|pdf)$'); {f}_ending: ends_with({f}, '.{e}')"""
ACT_RULES = f"""act_id_length: length(act_id) between 1 and 50; act_id_pattern: regexp_matches(act_id, '^[a-z0-9_]+$');
 act_name: length(act_name) between 1 and 200; short_name: length(short_name) between 1 and 20; {FILE_RULES.format(f='filename', e='pdf')};
 source_url: length(source_url) >= 1; retrieved_date: retrieved_date is not null; sha256: sha256 is null or regexp_matches(sha256, '^[a-f0-9]{{64}}$')"""
JUDGMENT_RULES = f"""folder_length: length(folder) between 2 and 4; folder_number: regexp_matches(folder, '^[0-9]{{2,}}$');
 case_id: length(case_id) between 1 and 100; case_name: length(case_name) between 1 and 300; citation: length(citation) between 1 and 300;
 court: length(court) between 1 and 100; primary_section: length(primary_section) between 1 and 50; year: year between 1860 and 2100;
 other_sections: other_sections is not null; outcome: outcome in ('conviction-upheld', 'conviction-set-aside', 'bail-granted', 'bail-denied', 'other');
 source_url: length(source_url) >= 1; {FILE_RULES.format(f='html_filename', e='html')}; {FILE_RULES.format(f='pdf_filename', e='pdf')};
 retrieved_date: retrieved_date is not null; html_sha256: html_sha256 is null or regexp_matches(html_sha256, '^[a-f0-9]{{64}}$');
 pdf_sha256: pdf_sha256 is null or regexp_matches(pdf_sha256, '^[a-f0-9]{{64}}$'); status: status in ('pending', 'approved', 'rejected', 'needs-review');
 relevance_score: relevance_score is null or relevance_score between 0 and 1"""


def violations_sql(view: str, key: str, rules: str) -> str:
    named = [r.strip().split(": ", 1) for r in rules.split(";")]
    return f"with v as ({view}) " + " union all ".join(f"select {key}, '{n}' as rule from v where not coalesce({c}, false)" for n, c in named)


ACTS_VIEW = f"select p_partkey, {ACTS.format(**DUCK_WORDS)} from part"
JUDGMENTS_VIEW = f"select page_id, {JUDGMENTS.format(**DUCK_WORDS)} from pages"

PLANS = {
    "a1_read_judgments": (stored_judgments, f"select * exclude (page_id) from ({JUDGMENTS_VIEW})"),
    "b1_act_rules": (act_violations, violations_sql(ACTS_VIEW, "p_partkey", ACT_RULES)),
    "b1_judgment_rules": (judgment_violations, violations_sql(JUDGMENTS_VIEW, "page_id", JUDGMENT_RULES)),
    "a1_read_manifest": (trimmed_manifest, fx.duck("manifest", body="select * replace (regexp_replace(citation, '^\\s+|\\s+$', '', 'g') as citation) from manifest")),
    "a2_list_corpus": (
        corpus_listing,
        """select page_id, lpad(cast(page_id as varchar), 6, '0') as folder, 'page_' || page_id || '.html' as filename, strlen(html) as length,
 sha256(html) as sha256, 'html' as extension, 'page_' || page_id as stem from pages""",
    ),
    "a3_jsonl_tolerant": (
        tolerant_lines,
        """select event_id, case event_id % 10 when 0 then 'invalid_json' when 1 then 'blank' when 2 then 'rejected' else 'ok' end as outcome,
 case when event_id % 10 > 2 then cast(json_extract_string(props, '$.k') as bigint) end as k from events""",
    ),
    "a4_jsonl_strict": (
        strict_lines,
        "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
    ),
    "a5_write_stage": (stage_roundtrip, fx.duck("manifest", body="select * from manifest")),
    "b1_validate_rules": (rule_violations, fx.duck("manifest", body=f"with {RULES_SQL} select * from v")),
    "b2_duplicate_keys": (
        repeated_names,
        fx.duck("manifest", body="select html_filename, count(*) as n from manifest group by 1 having count(*) > 1"),
    ),
    "b3_missing_files": (missing, fx.duck("manifest", "listing", body=f"with {MISSING_SQL} select * from ms")),
    "b4_orphan_files": (
        orphans,
        fx.duck("manifest", "file_listing", "declared_acts", body=f"with {ORPHAN_SQL} select * from orp"),
    ),
    "b5_check_pairs": (
        pairs,
        fx.duck("file_listing", body="""with g as (select folder, count(*) filter (lower(filename) like '%.html') as h, count(*) filter (lower(filename) like '%.pdf') as p,
   max(regexp_replace(filename, '\\.[^.]*$', '')) filter (lower(filename) like '%.html') as hs, max(regexp_replace(filename, '\\.[^.]*$', '')) filter (lower(filename) like '%.pdf') as ps
   from file_listing where folder is not null group by 1)
 select folder, case when h <> 1 then 'html count ' || h when p <> 1 then 'pdf count ' || p else 'stems differ' end as problem from g where h <> 1 or p <> 1 or hs <> ps"""),
    ),
    "b6_plan_renames": (
        renames,
        f"""with s as ({PART_SQL} union all select -p_partkey, p_name from part where p_partkey % 100 = 0)
 select p_partkey, source, {NORM_SQL} as target, source = {NORM_SQL} as is_noop from s""",
    ),
    "b7_rename_collisions": (
        collisions,
        f"""with s as ({PART_SQL}), t as (select p_partkey, {NORM_SQL} as target from s)
 select * from (select p_partkey, target, count(*) over (partition by target) as n_sources from t) where n_sources > 1""",
    ),
    "b8_hash_drift": (
        drift,
        fx.duck("manifest", "listing", body="select m.folder, stored_sha256, sha256 from manifest m join listing l on l.folder = m.folder where stored_sha256 <> sha256"),
    ),
    "b9_backfill_hashes": (
        backfill,
        fx.duck("manifest", "listing", body="""select m.folder, 'clean' as checks, coalesce(l.sha256, m.stored_sha256) as stored_sha256 from manifest m left join listing l on l.folder = m.folder
 union all select folder, 'failed', stored_sha256 from manifest"""),
    ),
    "b9_backfill_judgments": (
        backfill_pairs,
        fx.duck("manifest", "listing", "file_listing", body="""select m.folder, 'clean' as checks,
  case when h.filename is not null and p.filename is not null then sha256(m.folder || '/' || html_filename) else stored_sha256 end as html_sha256,
  case when h.filename is not null and p.filename is not null then sha256(m.folder || '/' || pdf_filename) when year % 2 = 0 then stored_sha256 end as pdf_sha256
 from manifest m left join file_listing h on h.folder = m.folder and h.filename = html_filename left join file_listing p on p.folder = m.folder and p.filename = pdf_filename
 union all select folder, 'failed', stored_sha256, case when year % 2 = 0 then stored_sha256 end from manifest"""),
    ),
    "b9_backfill_acts": (
        backfill_act_files,
        fx.duck("file_listing", "declared_acts", body="""select a.filename, case when f.filename is not null then sha256(f.filename) when length(a.filename) % 2 = 0 then sha256(a.filename) end as sha256
 from declared_acts a left join file_listing f on f.folder is null and f.filename = a.filename"""),
    ),
    "b10_verification_summary": (
        check_summary,
        fx.duck("manifest", "listing", "file_listing", "declared_acts", body=f"""with {RULES_SQL}, {MISSING_SQL}, {ORPHAN_SQL}
 select 'schema' as "check", count(*) as n from v where rule <> 'filename' union all select 'missing', count(*) from ms union all select 'pairing', count(*) from manifest where regexp_extract(html_filename, '^(.*)[.]', 1) <> regexp_extract(pdf_filename, '^(.*)[.]', 1)
 union all select 'normalization', count(*) from v where rule = 'filename' union all select 'orphan', count(*) from orp
 union all select 'hash_drift', count(*) from manifest m join listing l on l.folder = m.folder where stored_sha256 <> sha256"""),
    ),
    "b11_audit_placeholders": (
        placeholders,
        fx.duck("manifest", body="""select folder, 'citation' as missing from manifest where status = 'approved' and (trim(citation) = '' or starts_with(citation, 'TODO'))"""),
    ),
    "b12_bootstrap_manifest": (
        bootstrap,
        f"""with s as (select page_id, lpad(cast(page_id as varchar), 6, '0') as folder, {BOOT_FILES.format(text='varchar')} as stem from pages),
 f as (select folder, stem || '.html' as fn from s where page_id % 6 <> 5 union all select folder, stem || '.pdf' from s where page_id % 3 = 0 or page_id % 6 = 5 union all select folder, 'zz_extra.html' from s where page_id % 8 = 0),
 g as (select folder, min(fn) filter (fn like '%.html') as html, min(fn) filter (fn like '%.pdf') as pdf, count(*) filter (fn like '%.html') = 1 and count(*) filter (fn like '%.pdf') = 1 as pair_ok from f group by 1),
 h as (select *, regexp_replace(coalesce(html, pdf), '\\.[^.]*$', '') as stem, regexp_replace(html, '\\.[^.]*$', '') as hs, regexp_replace(pdf, '\\.[^.]*$', '') as ps from g),
 n as (select *, trim(regexp_replace(regexp_replace(regexp_replace(replace(stem, '_', ' '), '(?i)\\s+vs\\s+', ' v. ', 'g'), '(?i)[\\s,]+on\\s+\\d{{1,2}}[\\s,]+\\w+[\\s,]+\\d{{4}}\\s*$', '', 'g'), '\\s+\\d{{4}}\\s*$', '', 'g'), ' ,.;') as nm,
  list_filter(regexp_extract_all(stem, '\\d+'), lambda d: regexp_matches(d, '^(18[6-9]\\d|19\\d{{2}}|20\\d{{2}})$')) as ys from h)
 select folder, trim(regexp_replace(lower(stem), '[^a-z0-9_]+', '_', 'g'), '_') as case_id,
  case when regexp_matches(stem, '^\\d+$') then 'TODO: case name' else array_to_string(list_transform(list_filter(string_split(nm, ' '), lambda w: w <> ''), lambda w: case when lower(w) = 'v.' then 'v.' else upper(w[1]) || lower(w[2:]) end), ' ') end as case_name,
  cast(coalesce(ys[-1], '2024') as int) as year,
  case when regexp_matches(hs, '^\\d+$') then hs when regexp_matches(ps, '^\\d+$') then ps end as source_doc_id,
  coalesce(html, 'todo_missing.html') as html_filename, coalesce(pdf, 'todo_missing.pdf') as pdf_filename, pair_ok, 'pending' as status from n""",
    ),
    "b13_merge_fills": (
        fill_decisions,
        fx.duck("manifest", body=f"with {FILLS_SQL} select folder, field, old_value, value as new_value, {outcome_sql(2, False)} as outcome from j"),
    ),
    "b13_fill_outcomes": (
        fill_counts,
        fx.duck("manifest", body=f"""with {FILLS_SQL} select {outcome_sql(2, False)} as outcome, count(*) as n, 'medium' as mode from j group by 1
 union all select {outcome_sql(3, True)}, count(*), 'high_forced' from j group by 1"""),
    ),
    "b13_filled_manifest": (
        filled_manifest,
        fx.duck("manifest", body=f"""with {FILLS_SQL}, a as (select folder, field, value from j where {outcome_sql(2, False)} = 'applied')
 select m.folder, coalesce((select value from a where a.folder = m.folder and field = 'citation'), citation) as citation,
  coalesce((select value from a where a.folder = m.folder and field = 'source_url'), source_url) as source_url,
  coalesce((select cast(value as int) from a where a.folder = m.folder and field = 'year'), year) as year from manifest m"""),
    ),
    "b14_select_pending": (
        pending,
        fx.duck("manifest", "listing", body="""select folder, 'pending' as kind from manifest where status = 'pending'
 union all select folder, 'forced' from manifest where folder in (select folder from listing)
 union all select folder, 'stale' from listing l where not exists (select 1 from manifest m where m.folder = l.folder and m.stored_sha256 = l.sha256)"""),
    ),
    "b15_merge_verdicts": (
        verdicts,
        fx.duck("manifest", body=f"""with p as (select lpad(cast(page_id as varchar), 6, '0') as folder, page_id % 9 as c, {VERDICT.format()} as response, {FAILURE} as failure from pages)
 select m.folder, case c when 0 then 'approved' when 1 then 'needs-review' when 2 then 'rejected' when 3 then 'needs-review' when 4 then 'needs-review' when 5 then 'needs-review' when 6 then 'needs-review' when 8 then 'needs-review' else m.status end as status,
  case c when 0 then 0.9::double when 1 then 0.45::double when 2 then 0.1::double end as relevance_score,
  case c when 0 then 'on topic' when 1 then 'partly' when 2 then 'off topic' end as classifier_reasoning,
  case when c in (3, 4, 5, 6, 8) then concat(case when m.status = 'approved' then 'seen | ' else '' end, 'classifier failure: ', coalesce(failure, 'answer is not a complete verdict: ' || substr(response, 1, 160)))
   when m.status = 'approved' then 'seen' end as manual_review_notes
 from manifest m left join p on p.folder = m.folder"""),
    ),
}
