"""Registered queries that score retrieval, citations and rejections."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.operators import evaluate, retrieve
from folioflow.plans.logs import rounded
from folioflow.plans.retrieval import BM25_CTES, chunks


def questions(spark, sf):
    return fx.table(spark, sf, "benchmark").selectExpr(
        "concat('q', cast(item_id - case when item_id % 20 = 19 then 1 else 0 end as string)) as id",
        """case item_id % 5 when 0 then 'ingredient' when 1 then 'sentencing_bail' when 2 then 'ipc_bns_mapping'
             when 3 then 'out_of_scope' else 'other' end as category""",
        "case when item_id % 5 = 3 and item_id % 2 = 0 or item_id % 7 = 0 then cast(array() as array<string>) else array(concat('IPC-', cast(item_id as string))) end as expected_sections",
        "case when item_id % 5 = 3 then cast(array() as array<string>) else array(concat('src', cast(item_id % 25 as string))) end as expected_cases",
        "case when item_id % 6 = 0 then array('theme') else cast(array() as array<string>) end as expected_themes",
        "item_id % 5 = 3 as expected_to_reject",
    )


def eval_rules(spark, sf):
    cases = fx.table(spark, sf, "documents").select(F.col("source").alias("case_name"))
    return evaluate.validate_eval(questions(spark, sf), cases)


def expected_docs(spark, sf):
    passages = fx.table(spark, sf, "benchmark").selectExpr("item_id as query_id", "text as passage")
    return evaluate.contains_passage(passages, fx.table(spark, sf, "documents").select("doc_id", "text"))


def bm25_hits(spark, sf):
    hits = retrieve.bm25_topk(chunks(spark, sf), fx.text_queries(spark, sf), 20)
    return hits.withColumnRenamed("chunk_id", "item")


def recall(spark, sf):
    expected = expected_docs(spark, sf).withColumnRenamed("doc_id", "item")
    return rounded(evaluate.recall_at_k(bm25_hits(spark, sf), expected, 5), recall=6)


def citations(spark, sf):
    cited = bm25_hits(spark, sf).filter("rank <= 3").select(
        "query_id", F.concat(F.lit("Doc  No. "), F.col("item").cast("string")).alias("name")
    )
    wanted = expected_docs(spark, sf).select("query_id", F.concat(F.lit("doc no "), F.col("doc_id").cast("string")).alias("name"))
    extra = fx.text_queries(spark, sf).filter("query_id % 4 = 0").select("query_id", F.lit("DOC-NO-unknown").alias("name"))
    return rounded(evaluate.citation_pr(cited, wanted.unionByName(extra)), precision=6, recall=6)


def outcomes(spark, sf):
    log = fx.query_log(spark, sf).select("rejected", (F.col("request_id") % 10 < 3).alias("expected_to_reject"))
    return rounded(evaluate.rejection_accuracy(log), rejection_accuracy=6)


def categories(spark, sf):
    scored = fx.query_log(spark, sf).selectExpr(
        "case request_id % 4 when 0 then 'ingredient' when 1 then 'sentencing_bail' when 2 then 'ipc_bns_mapping' else 'out_of_scope' end as category",
        "(request_id % 5) / 4.0D as recall",
        "case when cache_hit then 1.0D else 0.0D end as precision",
        "latency_ms",
    )
    report = evaluate.category_report(scored, ("recall", "precision"))
    return rounded(report, recall=6, precision=6, p50_latency_ms=6, p95_latency_ms=6, p99_latency_ms=6)


PLANS = {
    "j1_validate_eval": (
        eval_rules,
        """with q as (select 'q' || (item_id - case when item_id % 20 = 19 then 1 else 0 end) as id, item_id, item_id % 5 = 4 as badcat, item_id % 5 = 3 as rej,
  (item_id % 5 = 3 and item_id % 2 = 0 or item_id % 7 = 0) as nosec, item_id % 5 = 3 as nocase, item_id % 6 <> 0 as notheme from benchmark)
 select id, 'category' as rule from q where badcat union all select id, 'reject_with_expectations' from q where rej and not (nosec and nocase and notheme)
 union all select id, 'no_expected_section' from q where not rej and nosec
 union all select id, 'id_not_unique' from q group by id having count(*) > 1
 union all (select distinct id, 'unknown_case' from q where not nocase and 'src' || (item_id % 25) not in (select source from documents))""",
    ),
    "j2_expected_docs": (expected_docs, fx.duck("expected_docs", body="select * from expected_docs")),
    "j2_recall_at_k": (
        recall,
        fx.duck("text_queries", "expected_docs", body=f"""with {BM25_CTES},
 x as (select e.query_id, count(*) as n_expected, count(b.chunk_id) as n_found from expected_docs e left join bmr b on b.query_id = e.query_id and b.chunk_id = e.doc_id and b.rank <= 5 group by 1)
 select *, round(n_found / n_expected, 6) as recall from x"""),
    ),
    "j3_citation_pr": (
        citations,
        fx.duck("text_queries", "expected_docs", body=f"""with {BM25_CTES},
 c as (select query_id, 'doc no ' || chunk_id as k from bmr where rank <= 3),
 e as (select query_id, 'doc no ' || doc_id as k from expected_docs union select query_id, 'doc no unknown' from text_queries where query_id % 4 = 0),
 j as (select coalesce(c.query_id, e.query_id) as query_id, count(c.k) as n_cited, count(e.k) as n_expected, count(*) filter (c.k is not null and e.k is not null) as n_right from c full outer join e on e.query_id = c.query_id and e.k = c.k group by 1)
 select *, case when n_cited > 0 then round(n_right / n_cited, 6) end as precision, case when n_expected > 0 then round(n_right / n_expected, 6) end as recall from j"""),
    ),
    "j4_rejection_accuracy": (
        outcomes,
        fx.duck("query_log", body="""select count(*) as n, count(*) filter (request_id % 10 < 3 and not rejected) as wrongly_answered, count(*) filter (request_id % 10 >= 3 and rejected) as wrongly_rejected,
 round(avg(((request_id % 10 < 3) = rejected)::int), 6) as rejection_accuracy from query_log"""),
    ),
    "j5_category_report": (
        categories,
        fx.duck("query_log", body="""with s as (select case request_id % 4 when 0 then 'ingredient' when 1 then 'sentencing_bail' when 2 then 'ipc_bns_mapping' else 'out_of_scope' end as category,
  (request_id % 5) / 4.0::double as recall, cache_hit::int::double as precision, latency_ms from query_log),
 l as (select category, latency_ms, row_number() over (partition by category order by latency_ms) - 1 as pos, count(*) over (partition by category) as n from s where latency_ms is not null),
 m as (select category, count(*) as n, avg(recall) as recall, avg(precision) as precision from s group by 1)
 select m.category, m.n, round(recall, 6) as recall, round(precision, 6) as precision,
  (select round(max(latency_ms), 6) from l where l.category = m.category and pos = round_even(0.5::double * (l.n - 1), 0)) as p50_latency_ms,
  (select round(max(latency_ms), 6) from l where l.category = m.category and pos = round_even(0.95::double * (l.n - 1), 0)) as p95_latency_ms,
  (select round(max(latency_ms), 6) from l where l.category = m.category and pos = round_even(0.99::double * (l.n - 1), 0)) as p99_latency_ms from m
 union all select 'composite', cast(sum(n) as bigint), round(avg(recall), 6), round(avg(precision), 6), null, null, null from m"""),
    ),
}
