"""Views that give the provided tables the record shapes of the workloads.

Each view exists twice: as a DataFrame here and as DuckDB text in ``DUCK``,
so that every result can be recomputed by an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.running import numbered, task_parts
from folioflow.session import configure
from folioflow.sources.files import spread


# Tables with long texts, and their keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


# Numbers in a vector of the embeddings table.
DIM = 64

QUERY_LOG_COLUMNS = [
    "event_id as request_id",
    "ts",
    "cast(ts as date) as log_date",
    "sha2(concat('fixture-salt:', cast(user_id as string)), 256) as hashed_ip",
    """case event_id % 3
   when 0 then concat('What is topic ', get_json_object(props, '$.k'), '?')
   when 1 then concat('  what  IS topic ', get_json_object(props, '$.k'), '? ')
   else concat('what is topic ', get_json_object(props, '$.k')) end as question""",
    "event_type = 'error' as rejected",
    "event_type = 'view' as cache_hit",
    "case when event_type = 'signup' and event_id % 7 = 0 then null else value * 10 end as latency_ms",
    "case when event_type in ('error', 'view') then null else cast(200 + event_id % 800 as int) end as prompt_tokens",
    "case when event_type in ('error', 'view') or event_id % 11 = 0 then null else cast(50 + event_id % 300 as int) end as output_tokens",
]


def project_query_log(events: DataFrame) -> DataFrame:
    """The log projection; works on a batch table and on a stream alike."""
    return events.selectExpr(*QUERY_LOG_COLUMNS)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_query_log(table(spark, sf_dir, "events"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk: one page in 23 lies in another folder."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "concat(case when page_id % 23 = 0 then '9' else '' end, lpad(cast(page_id as string), 6, '0')) as folder",
        "concat('page_', cast(page_id as string), '.html') as filename",
        "url",
        "sha2(html, 256) as sha256",
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk with pairs, strays and top-level acts: (folder, filename)."""
    return table(spark, sf_dir, "pages").selectExpr(
        "concat(case when page_id % 23 = 0 then '9' else '' end, lpad(cast(page_id as string), 6, '0')) as case_folder",
        """explode(filter(array(
             concat('page_', cast(page_id as string), '.html'),
             case when page_id % 7 <> 0 then concat(case when page_id % 10 = 0 then 'x_' else 'page_' end, cast(page_id as string), '.pdf') end,
             case when page_id % 15 = 0 then concat('copy_', cast(page_id as string), '.HTML') end,
             case when page_id % 31 = 0 then concat('act_', cast(page_id as string), '.pdf') end
           ), x -> x is not null)) as filename""",
    ).selectExpr("case when filename like 'act%' then null else case_folder end as folder", "filename")


def declared_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "concat(case when page_id % 62 = 0 then 'act_' else 'form_' end, cast(page_id as string), '.pdf') as filename"
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared documents, with bad names, placeholders, drifted hashes, odd years, folders without files."""
    return table(spark, sf_dir, "pages").selectExpr(
        "concat(case when page_id % 17 = 0 then '8' else '' end, lpad(cast(page_id as string), 6, '0')) as folder",
        "url as source_url",
        "case when page_id % 19 = 0 then 'Bad Name.HTML' else concat('page_', cast(page_id as string), '.html') end as html_filename",
        "concat(case when page_id % 21 = 0 then 'other_' else 'page_' end, cast(page_id as string), '.pdf') as pdf_filename",
        """case when page_id % 13 = 0 then 'TODO: citation' when page_id % 29 = 0 then ''
            else concat('(2020) ', cast(page_id % 12 + 1 as string), ' SCC ', cast(page_id as string)) end as citation""",
        "case when page_id % 5 = 0 then null when page_id % 11 = 0 then repeat('0', 64) else sha2(html, 256) end as stored_sha256",
        "case page_id % 4 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' else 'needs-review' end as status",
        "cast(1850 + page_id % 260 as int) as year",
    )


def act_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute-like text as lines: contents list, chapters, running title, footnotes."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.selectExpr("l_suppkey as act_id", "l_partkey as part", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "part", "l_extendedprice"]
    rows = numbered(rows, ["act_id"], order, F.floor(F.col("l_orderkey") / 50_000), "rn", task_parts(items))
    return rows.selectExpr(
        "act_id",
        "rn as line_no",
        "cast(floor((rn - 1) / 20) as int) as page_no",
        """case when rn = 1 then 'ARRANGEMENT OF SECTIONS'
             when rn = 2 or rn = 8 then 'CHAPTER I'
             when rn % 60 = 8 then concat('CHAPTER ', cast(rn as string))
             when rn % 20 = 0 then 'THE FIXTURE GAZETTE'
             when rn % 20 = 19 then cast(rn as string)
             when rn % 35 = 11 then '1. 1st day of July'
             when rn % 6 = 3 then concat(cast(cast(floor(rn / 6) as int) + 1 as string),
                  case when rn % 4 = 3 then 'A' else '' end, '. Heading ', cast(part as string))
             else concat('body text of line ', cast(rn as string), ' citing section ', cast(378 + part % 25 as string))
           end as line""",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers with valid, invalid and zero-padded markers."""
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").selectExpr(
        "conv_id * 1000 + turn as query_id",
        "5 as n_sources",
        """concat(text, ' [', cast(turn % 7 as string), '] and [', cast(conv_id % 6 + 1 as string),
             '] then [0', cast(turn % 9 as string), '] .') as answer_text""",
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question."""
    return table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text as query")


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "value"))
    means = cells.groupBy("label", "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    # One row per vector dimension is collected, whatever the number of vectors.
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return means.groupBy("label").agg(ordered["mean"].alias("query_vec")).select(
        F.col("label").cast("bigint").alias("query_id"), "query_vec", "label"
    )


DUCK = {
    "query_log": """
query_log as (select event_id as request_id, ts, cast(ts as date) as log_date,
 sha256(concat('fixture-salt:', cast(user_id as varchar))) as hashed_ip,
 case event_id % 3 when 0 then concat('What is topic ', json_extract_string(props, '$.k'), '?')
   when 1 then concat('  what  IS topic ', json_extract_string(props, '$.k'), '? ')
   else concat('what is topic ', json_extract_string(props, '$.k')) end as question,
 event_type = 'error' as rejected, event_type = 'view' as cache_hit,
 case when event_type = 'signup' and event_id % 7 = 0 then null else value * 10 end as latency_ms,
 case when event_type in ('error','view') then null else cast(200 + event_id % 800 as int) end as prompt_tokens,
 case when event_type in ('error','view') or event_id % 11 = 0 then null else cast(50 + event_id % 300 as int) end as output_tokens
from events)""",
    "listing": """
listing as (select page_id, case when page_id % 23 = 0 then '9' else '' end || lpad(cast(page_id as varchar), 6, '0') as folder,
 concat('page_', cast(page_id as varchar), '.html') as filename, url, sha256(html) as sha256
from pages)""",
    "file_listing": """
file_listing as (
 select case when page_id % 23 = 0 then '9' else '' end || lpad(cast(page_id as varchar), 6, '0') as folder, concat('page_', cast(page_id as varchar), '.html') as filename from pages
 union all select case when page_id % 23 = 0 then '9' else '' end || lpad(cast(page_id as varchar), 6, '0'), concat(case when page_id % 10 = 0 then 'x_' else 'page_' end, cast(page_id as varchar), '.pdf') from pages where page_id % 7 <> 0
 union all select case when page_id % 23 = 0 then '9' else '' end || lpad(cast(page_id as varchar), 6, '0'), concat('copy_', cast(page_id as varchar), '.HTML') from pages where page_id % 15 = 0
 union all select null, concat('act_', cast(page_id as varchar), '.pdf') from pages where page_id % 31 = 0)""",
    "declared_acts": """
declared_acts as (select concat(case when page_id % 62 = 0 then 'act_' else 'form_' end, cast(page_id as varchar), '.pdf') as filename from pages)""",
    "manifest": """
manifest as (select case when page_id % 17 = 0 then '8' else '' end || lpad(cast(page_id as varchar), 6, '0') as folder, url as source_url,
 case when page_id % 19 = 0 then 'Bad Name.HTML' else concat('page_', cast(page_id as varchar), '.html') end as html_filename,
 concat(case when page_id % 21 = 0 then 'other_' else 'page_' end, cast(page_id as varchar), '.pdf') as pdf_filename,
 case when page_id % 13 = 0 then 'TODO: citation' when page_id % 29 = 0 then '' else concat('(2020) ', cast(page_id % 12 + 1 as varchar), ' SCC ', cast(page_id as varchar)) end as citation,
 case when page_id % 5 = 0 then null when page_id % 11 = 0 then repeat('0', 64) else sha256(html) end as stored_sha256,
 case page_id % 4 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' else 'needs-review' end as status,
 cast(1850 + page_id % 260 as int) as year
from pages)""",
    "act_lines": """
act_lines as (select act_id, rn as line_no, cast(floor((rn - 1) / 20) as int) as page_no,
 case when rn = 1 then 'ARRANGEMENT OF SECTIONS'
      when rn = 2 or rn = 8 then 'CHAPTER I'
      when rn % 60 = 8 then concat('CHAPTER ', cast(rn as varchar))
      when rn % 20 = 0 then 'THE FIXTURE GAZETTE'
      when rn % 20 = 19 then cast(rn as varchar)
      when rn % 35 = 11 then '1. 1st day of July'
      when rn % 6 = 3 then concat(cast(cast(floor(rn / 6) as int) + 1 as varchar), case when rn % 4 = 3 then 'A' else '' end, '. Heading ', cast(part as varchar))
      else concat('body text of line ', cast(rn as varchar), ' citing section ', cast(378 + part % 25 as varchar))
 end as line
from (select l_suppkey as act_id, l_partkey as part, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rn from lineitem) t)""",
    "answers": """
answers as (select conv_id * 1000 + turn as query_id, 5 as n_sources,
 concat(text, ' [', cast(turn % 7 as varchar), '] and [', cast(conv_id % 6 + 1 as varchar), '] then [0', cast(turn % 9 as varchar), '] .') as answer_text
from conversations where role = 'assistant')""",
    "text_queries": """
text_queries as (select item_id as query_id, text as query from benchmark)""",
    "expected_docs": """
expected_docs as (select b.item_id as query_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text))""",
    "vec_queries": """
vec_queries as (select cast(label as bigint) as query_id, list(mean order by dim) as query_vec, label from (
  select label, dim, avg(value) as mean from (select label, unnest(embedding)::double as value, unnest(range(len(embedding))) as dim from embeddings) group by 1, 2) group by label)""",
}


def duck(*names: str, body: str, recursive: bool = False) -> str:
    """One DuckDB statement: the named views as CTEs, then ``body``.

    ``body`` may start with further CTEs, each ending in a comma-free line, by
    beginning with ``with``.
    """
    body = body.strip()
    ctes = ",".join(DUCK[n] for n in names)
    head = "with recursive " if recursive else "with "
    if body.lower().startswith("with "):
        rest = body[5:]
        return f"{head}{ctes + ',' if ctes else ''} {rest}"
    return f"{head}{ctes} {body}" if ctes else body
