"""Registered queries over embeddings, index tables and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import fixtures as fx
from folioflow.operators import bm25, embed, index, nearest, retrieve
from folioflow.plans.logs import rounded
from folioflow.session import configure, stage_path

MODEL, TASK, VERSION = "hashed-tf-64", "RETRIEVAL_DOCUMENT", "2024.01"


def chunks(spark, sf):
    """Documents as chunks."""
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def hashed_chunks(spark, sf):
    return embed.with_content_hash(chunks(spark, sf), MODEL, TASK)


def cached_keys(spark, sf):
    return hashed_chunks(spark, sf).filter("chunk_id % 2 = 0").select("content_hash")


def content_key(spark, sf):
    return hashed_chunks(spark, sf).select("chunk_id", "content_hash")


def cache_split(spark, sf):
    hits, misses = embed.split_cached(hashed_chunks(spark, sf), cached_keys(spark, sf))
    hits = hits.select("chunk_id", F.lit("hit").alias("status"))
    return hits.unionByName(misses.select("chunk_id", F.lit("miss").alias("status")))


def missing_texts(spark, sf):
    _, misses = embed.split_cached(hashed_chunks(spark, sf), cached_keys(spark, sf))
    return embed.distinct_texts(misses).select("content_hash", F.length("text").alias("n_chars"))


def embedded(spark, sf):
    made = embed.embed_batches(chunks(spark, sf), "chunk_id", dim=64)
    cells = made.select("chunk_id", "error", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0")
    return rounded(cells, value=6)


def normalized(spark, sf):
    scaled = vectors(spark, sf).withColumn(
        "embedding", F.transform("embedding", lambda x: x * F.when(F.col("chunk_id") % 50 == 0, 0).otherwise(3))
    )
    cells = embed.normalize_vectors(scaled).select("chunk_id", F.posexplode("embedding").alias("dim", "value"))
    return cells.withColumn("value", F.round("value", 6) + 0.0)


def vector_checks(spark, sf):
    damaged = vectors(spark, sf).withColumn(
        "embedding",
        F.when(F.col("chunk_id") % 9 == 0, F.lit(None))
        .when(F.col("chunk_id") % 9 == 1, F.slice("embedding", 1, 63))
        .otherwise(F.col("embedding")),
    )
    good, bad = embed.check_vectors(damaged, 64)
    return good.select("chunk_id", F.lit("ok").alias("state")).unionByName(
        bad.select("chunk_id", F.col("reason").alias("state"))
    )


def materialized(spark, sf):
    docs = hashed_chunks(spark, sf)
    cache = (
        docs.join(vectors(spark, sf).drop("label"), "chunk_id")
        .groupBy("content_hash")
        .agg(F.min_by("embedding", "chunk_id").alias("embedding"))
        .select("content_hash", "embedding", F.lit(MODEL).alias("model"), F.lit(TASK).alias("task_type"))
    )
    out = embed.materialize_embeddings(docs, cache)
    return out.select("chunk_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "model", "task_type")


def bucketed_cache(spark, sf):
    """The vectors of every second chunk under their content hash, as a bucketed table."""
    docs = hashed_chunks(spark, sf)
    cache = (
        docs.join(vectors(spark, sf).drop("label"), "chunk_id")
        .groupBy("content_hash")
        .agg(F.min_by("embedding", "chunk_id").alias("embedding"))
        .select("content_hash", "embedding", F.lit(MODEL).alias("model"), F.lit(TASK).alias("task_type"))
    )
    path = stage_path(configure(spark), "vector-cache")
    return embed.write_cache(cache, f"vector_cache_{path[-32:]}", path, 8)


def bucketed_split(spark, sf):
    hits, misses = embed.split_cached(hashed_chunks(spark, sf).select("chunk_id", "content_hash"), bucketed_cache(spark, sf))
    return hits.select("chunk_id", F.lit("hit").alias("status")).unionByName(misses.select("chunk_id", F.lit("miss").alias("status")))


def bucketed_vectors(spark, sf):
    out = embed.materialize_embeddings(hashed_chunks(spark, sf), bucketed_cache(spark, sf))
    return out.select("chunk_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "model", "task_type")


def coverage(spark, sf):
    return embed.embedding_coverage(chunks(spark, sf), vectors(spark, sf))


def tokenized(spark, sf):
    return index.tokenize(chunks(spark, sf)).select(
        "chunk_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def postings(spark, sf):
    return index.build_postings(chunks(spark, sf)).postings


def index_stats(spark, sf):
    built = index.build_postings(chunks(spark, sf))
    terms = built.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df"))
    return rounded(
        terms.select(
            "*",
            built.stats.select("n_docs").scalar().alias("n_docs"),
            built.stats.select("avg_len").scalar().alias("avg_len"),
        ),
        avg_len=6,
    )


def stored_index(spark, sf):
    """The chunk table's index, written and read again."""
    path = stage_path(configure(spark), "stored-index")
    bm25.write_segments(chunks(spark, sf), path)
    return bm25.read_segments(spark, path)


def stored_postings(spark, sf):
    return stored_index(spark, sf).postings.withColumn("tf", F.col("tf").cast("long"))


def bm25_hits(spark, sf):
    return retrieve.bm25_topk(chunks(spark, sf), fx.text_queries(spark, sf), 20)


def bm25_stored(spark, sf):
    return retrieve.bm25_topk(stored_index(spark, sf), fx.text_queries(spark, sf), 20)


def numbered_chunks(spark, sf):
    docs = chunks(spark, sf).withColumn("ordinal", F.col("chunk_id"))
    again = docs.filter("chunk_id % 10 = 0").select(
        "chunk_id", F.concat(F.lit("second "), "text").alias("text"), (F.col("ordinal") + 10_000_000).alias("ordinal")
    )
    return docs.unionByName(again)


def numbered_vectors(spark, sf):
    vecs = vectors(spark, sf).drop("label").withColumn("ordinal", F.col("chunk_id"))
    again = vecs.filter("chunk_id % 7 = 0").select(
        "chunk_id",
        F.transform("embedding", lambda x: (-x).cast("float")).alias("embedding"),
        (F.col("ordinal") + 10_000_000).alias("ordinal"),
    )
    return vecs.unionByName(again)


def vector_table(spark, sf):
    joined, _, _ = index.build_vector_table(numbered_chunks(spark, sf), numbered_vectors(spark, sf))
    return joined.select(
        "chunk_id", F.md5("text").alias("text_md5"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first")
    )


def vector_table_report(spark, sf):
    _, repeated, missing = index.build_vector_table(numbered_chunks(spark, sf), numbered_vectors(spark, sf))
    return repeated.select("chunk_id", F.lit("duplicate").alias("problem"), "n").unionByName(
        missing.select("chunk_id", F.lit("no_vector").alias("problem"), F.lit(1).cast("bigint").alias("n"))
    )


def cosine(spark, sf):
    return retrieve.vector_topk(vectors(spark, sf), fx.vec_queries(spark, sf), fx.DIM, 20)


def cosine_filtered(spark, sf):
    return retrieve.vector_topk(vectors(spark, sf), fx.vec_queries(spark, sf), fx.DIM, 5, where={"label": 2})


def mixed_vectors(spark, sf):
    """All vectors, and next to them one in five cut short, null or with a NaN."""
    vecs, queries = vectors(spark, sf).select("chunk_id", "embedding"), fx.vec_queries(spark, sf).select("query_id", "query_vec")
    broken = vecs.filter("chunk_id % 5 = 0").selectExpr(
        "-1 - chunk_id as chunk_id",
        "case chunk_id % 3 when 0 then slice(embedding, 1, 7) when 1 then cast(null as array<float>) else concat(slice(embedding, 2, 63), array(float('nan'))) end as embedding",
    )
    short = queries.selectExpr("-1 - query_id as query_id", "slice(query_vec, 1, 3) as query_vec")
    return vecs.unionByName(broken), queries.unionByName(short)


def cosine_mixed(spark, sf):
    return retrieve.vector_topk(*mixed_vectors(spark, sf), fx.DIM, 20)


def lsh_recall(spark, sf):
    """How much of the exact result the hashed search finds, for every vector whose id is divisible by 50."""
    entries = vectors(spark, sf).select("chunk_id", "embedding")
    queries = entries.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = retrieve.vector_topk(entries, queries, fx.DIM, 20)
    return nearest.recall(nearest.lsh_topk(entries, queries, 20), exact)


def rejected(spark, sf):
    return retrieve.rejected_vectors(*mixed_vectors(spark, sf), fx.DIM)


def metadata_rows(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.lit(VERSION).alias("corpus_version"),
        F.length("text").alias("char_count"),
        F.greatest(F.lit(1), F.bround(F.length("text") / 4.0).cast("int")).alias("approx_token_count"),
        F.struct(
            F.lit("judgment").alias("source_type"),
            F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("court"),
            F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 200 + 1800).cast("int")).alias("year"),
            F.array(F.col("lang"), (F.col("doc_id") % 400).cast("string")).alias("other_sections"),
        ).alias("metadata"),
    )
    flat = index.flatten_metadata(docs)
    return flat.select("chunk_id", F.explode("metadata").alias("key", "value"))


def index_check(spark, sf):
    # Every 50th vector refers to a chunk the text index does not know.
    vecs = vectors(spark, sf).select(
        F.when(F.col("chunk_id") % 50 == 0, -F.col("chunk_id") - 1).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("label") < 5, "act").when(F.col("label") < 9, "judgment").alias("source_type"),
    )
    built = index.build_postings(chunks(spark, sf))
    return index.verify_indexes(vecs, built.docs)


def smoke(spark, sf):
    hits = retrieve.bm25_topk(chunks(spark, sf), fx.text_queries(spark, sf), 5)
    hits = hits.withColumn(
        "reference", F.concat(F.lit("("), F.lit("2024) SCC 12345, "), (F.col("chunk_id") % 500).cast("string"), F.lit(" IPC"))
    )
    expected = fx.text_queries(spark, sf).select(
        "query_id", F.expr("transform(sequence(0, 120), i -> cast((query_id * 13 + i) % 500 as string))").alias("sections")
    )
    return index.smoke_check(hits, expected)


def ranked_pair(spark, sf):
    """Two overlapping rankings of vectors: all of them, and one label only."""
    everything = retrieve.vector_topk(vectors(spark, sf), fx.vec_queries(spark, sf), fx.DIM, 20)
    labelled = retrieve.vector_topk(vectors(spark, sf), fx.vec_queries(spark, sf), fx.DIM, 20, where={"label": 2})
    return (
        everything.withColumn("payload", F.lit("all")),
        labelled.withColumn("payload", F.lit("label")),
    )


def fusion(spark, sf):
    return retrieve.rrf(*ranked_pair(spark, sf))


def gate(spark, sf):
    by_vector = retrieve.vector_topk(vectors(spark, sf), fx.vec_queries(spark, sf), fx.DIM, 20)
    by_text = retrieve.bm25_topk(chunks(spark, sf), fx.text_queries(spark, sf), 20)
    queries = fx.text_queries(spark, sf).select("query_id").unionByName(
        spark.range(100_000, 100_003).select(F.col("id").alias("query_id"))
    )
    return retrieve.scope_gate(queries, by_vector, by_text)


def hybrid(spark, sf):
    vecs = embed.embed_batches(chunks(spark, sf), "chunk_id").select("chunk_id", "embedding")
    texts = fx.text_queries(spark, sf)
    query_vecs = embed.embed_batches(texts, "query_id", "query").select("query_id", F.col("embedding").alias("query_vec"))
    queries = texts.join(query_vecs, "query_id")
    return retrieve.retrieve(queries, chunks(spark, sf), vecs, fx.DIM)


def class_scores(spark, sf):
    best = retrieve.vector_topk(vectors(spark, sf), fx.vec_queries(spark, sf), fx.DIM, 1)
    labels = fx.vec_queries(spark, sf).select("query_id", (F.col("label") % 2 == 0).alias("in_scope"))
    return labels.join(best.select("query_id", "score"), "query_id")


def calibration(spark, sf):
    report, _ = retrieve.calibrate_threshold(class_scores(spark, sf))
    return rounded(report, median_in=6, median_out=6, gap=6, midpoint=6, overlap=6)


def calibration_offenders(spark, sf):
    _, wrong = retrieve.calibrate_threshold(class_scores(spark, sf))
    return wrong


def query_keys(spark, sf):
    log = fx.query_log(spark, sf)
    return log.select("request_id", retrieve.normalize_query(F.concat("question", F.lit("!?"))).alias("normalized"))


def cache_table(spark, sf):
    """One entry per topic: current, outdated or without an answer."""
    topics = fx.query_log(spark, sf).select(F.regexp_extract("question", r"(\d+)", 1).alias("topic")).distinct()
    return topics.select(
        F.sha2(F.concat(F.lit("what is topic "), "topic"), 256).alias("cache_key"),
        F.when(F.col("topic").cast("int") % 5 != 0, F.concat(F.lit("answer "), "topic")).alias("answer_text"),
        F.when(F.col("topic").cast("int") % 3 == 0, "2023.12").otherwise(VERSION).alias("corpus_version"),
    )


def exact_lookup(spark, sf):
    queries = fx.query_log(spark, sf).select("request_id", F.col("question").alias("query"))
    found = retrieve.exact_cache_lookup(queries, cache_table(spark, sf), VERSION)
    return found.select("request_id", "cache_hit", "answer_text")


def semantic_lookup(spark, sf):
    entries = vectors(spark, sf).select(
        F.col("chunk_id").alias("cached_id"),
        F.col("embedding").alias("cached_vec"),
        F.when(F.col("chunk_id") % 4 == 0, "2023.12").otherwise(VERSION).alias("corpus_version"),
    )
    queries = vectors(spark, sf).select(
        F.col("chunk_id").alias("query_id"),
        F.transform("embedding", lambda x: F.round(x.cast("double") * 5, 0) / 5).alias("query_vec"),
    )
    return retrieve.semantic_cache_lookup(queries, entries, VERSION, fx.DIM)


def answer_writes(spark, sf):
    log = fx.query_log(spark, sf)
    earlier = log.filter("ts < timestamp '2024-01-15'").select(
        F.col("question").alias("query"), F.concat(F.lit("a"), F.col("request_id").cast("string")).alias("answer_text"), F.struct("ts", "request_id").alias("written_at")
    )
    later = log.filter("ts >= timestamp '2024-01-15' and not rejected").select(
        F.col("question").alias("query"), F.concat(F.lit("b"), F.col("request_id").cast("string")).alias("answer_text"), F.struct("ts", "request_id").alias("written_at")
    )
    empty = retrieve.with_cache_key(earlier).selectExpr("cache_key", "answer_text", "'' as corpus_version", "written_at").filter("false")
    cache = retrieve.store_answers(empty, earlier, "2023.12")
    return retrieve.store_answers(cache, later, VERSION).select("cache_key", "answer_text", "corpus_version")


def tok(x: str) -> str:
    return f"list_filter(string_split_regex(replace(lower({x}), '§', 'section '), '[^a-z0-9_]+'), lambda t: length(t) >= 2)"


BM25_CTES = f"""d as (select doc_id, {tok('text')} as toks from documents),
 st as (select count(*) as n, avg(len(toks)) as avgdl from d),
 post as (select term, doc_id, count(*) as tf, any_value(dl) as dl from (select doc_id, len(toks) as dl, unnest(toks) as term from d) group by 1, 2),
 dfs as (select term, count(*) as df from post group by 1),
 qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({tok('query')}) as term from text_queries) group by 1, 2),
 bm as (select query_id, post.doc_id as chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf / (tf + 1.5::double * (1 - 0.75::double + 0.75::double * dl / avgdl))), 6) as score
   from post join qt on qt.term = post.term join dfs on dfs.term = post.term, st group by 1, 2),
 bmr as (select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from bm)"""


def cos_sql(extra: str = "", k: int = 20) -> str:
    return f"""select * from (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from (
 select q.query_id, e.vec_id as chunk_id, round(greatest(0, list_cosine_similarity(q.query_vec::double[], e.embedding::double[])), 6) as score
 from vec_queries q, embeddings e {extra})) where rank <= {k}"""


def hex_bucket(h: str) -> str:
    digits = " + ".join(f"(instr('0123456789abcdef', substr({h}, {i}, 1)) - 1) * {16 ** (4 - i)}" for i in range(1, 5))
    return f"(({digits}) % 64)"


def emb_ctes(name: str, source: str, key: str, text: str) -> str:
    """Hashed token counts and unit values of a text table."""
    return f"""{name}_c as (select id, {hex_bucket('md5(term)')} as dim, count(*) as c from (select {key} as id, unnest({tok(text)}) as term from {source}) group by 1, 2),
 {name}_n as (select id, sqrt(sum(c * c)::double) as norm from {name}_c group by 1),
 {name}_v as (select a.id, a.dim, a.c / b.norm as value from {name}_c a join {name}_n b on a.id = b.id)"""


HASH = f"sha256('{MODEL}' || chr(0) || '{TASK}' || chr(0) || text)"

PLANS = {
    "e1_content_hash": (content_key, f"select doc_id as chunk_id, {HASH} as content_hash from documents"),
    "e2_split_cached": (
        cache_split,
        f"""with h as (select doc_id as chunk_id, {HASH} as k from documents)
 select chunk_id, case when k in (select k from h where chunk_id % 2 = 0) then 'hit' else 'miss' end as status from h""",
    ),
    "e2_distinct_misses": (
        missing_texts,
        f"""with h as (select doc_id as chunk_id, text, {HASH} as k from documents)
 select k as content_hash, cast(any_value(length(text)) as int) as n_chars from h where k not in (select k from h where chunk_id % 2 = 0) group by 1""",
    ),
    "e3_embed_batches": (
        embedded,
        f"with {emb_ctes('d', 'documents', 'doc_id', 'text')} select id as chunk_id, cast(null as varchar) as error, cast(dim as int) as dim, round(value, 6) as value from d_v",
    ),
    "e4_l2_normalize": (
        normalized,
        """with s as (select vec_id as chunk_id, list_transform(embedding, lambda x: x::double * (case when vec_id % 50 = 0 then 0 else 3 end)) as v from embeddings),
 n as (select chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x::double * x::double))) as norm from s),
 c as (select chunk_id, norm, unnest(v) as x, unnest(range(len(v))) as i from n)
 select chunk_id, cast(i as int) as dim, round(case when norm > 0 then x::double / norm else x::double end, 6) + 0.0::double as value from c""",
    ),
    "e5_check_vectors": (
        vector_checks,
        "select vec_id as chunk_id, case vec_id % 9 when 0 then 'missing' when 1 then 'dimension' else 'ok' end as state from embeddings",
    ),
    "e6_materialize_embeddings": (
        materialized,
        f"""with h as (select doc_id as chunk_id, {HASH} as k from documents),
 c as (select h.k, arg_min(embedding, h.chunk_id) as v from h join embeddings e on e.vec_id = h.chunk_id group by 1)
 select h.chunk_id, round(c.v[1]::double, 6) as first, '{MODEL}' as model, '{TASK}' as task_type from h join c on c.k = h.k""",
    ),
    "e6_bucketed_cache": (
        bucketed_vectors,
        f"""with h as (select doc_id as chunk_id, {HASH} as k from documents),
 c as (select h.k, arg_min(embedding, h.chunk_id) as v from h join embeddings e on e.vec_id = h.chunk_id group by 1)
 select h.chunk_id, round(c.v[1]::double, 6) as first, '{MODEL}' as model, '{TASK}' as task_type from h join c on c.k = h.k""",
    ),
    "e2_bucketed_cache": (
        bucketed_split,
        f"""with h as (select doc_id as chunk_id, {HASH} as k from documents)
 select chunk_id, case when k in (select k from h join embeddings on vec_id = chunk_id) then 'hit' else 'miss' end as status from h""",
    ),
    "e7_embedding_coverage": (
        coverage,
        """select count(vec_id) as embedded, count(*) as total, count(*) - count(vec_id) as missing, count(vec_id) >= count(*) as complete
 from documents left join embeddings on vec_id = doc_id""",
    ),
    "f1_tokenize": (
        tokenized,
        f"select doc_id as chunk_id, cast(len({tok('text')}) as int) as n_tokens, array_to_string({tok('text')}, ' ') as tokens from documents",
    ),
    "f2_postings": (
        postings,
        f"""with d as (select doc_id, {tok('text')} as toks from documents)
 select term, doc_id as chunk_id, cast(any_value(dl) as int) as dl, count(*) as tf from (select doc_id, len(toks) as dl, unnest(toks) as term from d) group by 1, 2""",
    ),
    "f2_stored_postings": (
        stored_postings,
        f"""with d as (select doc_id, {tok('text')} as toks from documents)
 select term, doc_id as chunk_id, cast(any_value(dl) as int) as dl, count(*) as tf from (select doc_id, len(toks) as dl, unnest(toks) as term from d) group by 1, 2""",
    ),
    "f2_index_stats": (
        index_stats,
        f"""with d as (select doc_id, {tok('text')} as toks from documents),
 p as (select term, count(distinct doc_id) as df from (select doc_id, unnest(toks) as term from d) group by 1)
 select count(*) as n_terms, cast(sum(df) as bigint) as n_postings, max(df) as max_df, (select count(*) from d) as n_docs, (select round(avg(len(toks)), 6) from d) as avg_len from p""",
    ),
    "f3_bm25_topk": (
        bm25_hits,
        fx.duck("text_queries", body=f"with {BM25_CTES} select query_id, chunk_id, score, rank from bmr where rank <= 20"),
    ),
    "f3_bm25_index": (
        bm25_stored,
        fx.duck("text_queries", body=f"with {BM25_CTES} select query_id, chunk_id, score, rank from bmr where rank <= 20"),
    ),
    "f4_vector_table": (
        vector_table,
        """select doc_id as chunk_id, md5(text) as text_md5, round((case when vec_id % 7 = 0 then -embedding[1] else embedding[1] end)::double, 6) as first
 from documents join embeddings on vec_id = doc_id""",
    ),
    "f4_vector_table_report": (
        vector_table_report,
        """select doc_id as chunk_id, 'duplicate' as problem, 2::bigint as n from documents where doc_id % 10 = 0
 union all select doc_id, 'no_vector', 1 from documents where doc_id not in (select vec_id from embeddings)""",
    ),
    "f5_vector_topk": (cosine, fx.duck("vec_queries", body=cos_sql())),
    "f5_vector_mixed_dims": (cosine_mixed, fx.duck("vec_queries", body=cos_sql())),
    # Approximate by design: no twin, its recall is tested.
    "f5_vector_lsh": (lsh_recall, None),
    "f5_rejected_vectors": (
        rejected,
        """select 'chunk' as side, -1 - vec_id as id, case vec_id % 3 when 0 then 'dimension' when 1 then 'missing' else 'not_finite' end as reason from embeddings where vec_id % 5 = 0
 union all select distinct 'query', -1 - label::bigint, 'dimension' from embeddings""",
    ),
    "f6_vector_topk_filtered": (cosine_filtered, fx.duck("vec_queries", body=cos_sql("where e.label = 2", 5))),
    "f7_flatten_metadata": (
        metadata_rows,
        f"""with m as (select doc_id, unnest([
   {{'k': 'source_type', 'v': 'judgment'}}, {{'k': 'court', 'v': case when doc_id % 3 <> 0 then source end}},
   {{'k': 'year', 'v': case when doc_id % 4 <> 0 then cast(doc_id % 200 + 1800 as varchar) end}},
   {{'k': 'other_sections', 'v': lang || ',' || cast(doc_id % 400 as varchar)}}, {{'k': 'corpus_version', 'v': '{VERSION}'}},
   {{'k': 'char_count', 'v': cast(length(text) as varchar)}},
   {{'k': 'approx_token_count', 'v': cast(cast(greatest(1, round_even(length(text) / 4.0, 0)) as int) as varchar)}}]) as p from documents)
 select doc_id as chunk_id, p.k as key, p.v as value from m where p.v is not null""",
    ),
    "f8_verify_indexes": (
        index_check,
        f"""with t as (select doc_id from documents where len({tok('text')}) > 0),
 v as (select case when vec_id % 50 = 0 then -vec_id - 1 else vec_id end as id, case when label < 5 then 'act' when label < 9 then 'judgment' end as source_type from embeddings),
 c as (select (select count(*) from v where id not in (select doc_id from t)) as ov, (select count(*) from t where doc_id not in (select id from v)) as ot,
   (select count(*) from v) as nv, (select count(*) from t) as nt)
 select case when ov > 0 then 'error' else 'ok' end as severity, 'only_in_vectors' as finding, ov as n from c
 union all select case when ot > 0 then 'info' else 'ok' end, 'only_in_text', ot from c
 union all select case when nv = 0 then 'error' else 'ok' end, 'vector_rows', nv from c
 union all select case when nt = 0 then 'error' else 'ok' end, 'text_rows', nt from c
 union all select 'ok', 'type:' || coalesce(source_type, '?'), count(*) from v group by source_type""",
    ),
    "f9_smoke_check": (
        smoke,
        fx.duck("text_queries", body=f"""with {BM25_CTES},
 s as (select distinct query_id, unnest(regexp_extract_all('(2024) SCC 12345, ' || cast(chunk_id % 500 as varchar) || ' IPC', '\\b(\\d{{1,3}})\\b', 1)) as section from bmr where rank <= 5),
 e as (select distinct query_id, cast((query_id * 13 + i) % 500 as varchar) as section from text_queries, range(121) r(i)),
 f as (select e.query_id, count(*) as n from e join s on s.query_id = e.query_id and s.section = e.section group by 1)
 select q.query_id, coalesce(f.n, 0) as n_found, coalesce(f.n > 0, false) as passed from text_queries q left join f on f.query_id = q.query_id"""),
    ),
    "g1_rrf": (
        fusion,
        fx.duck("vec_queries", body=f"""with l as (select query_id, chunk_id, rank, 0 as list_no, 'all' as payload from ({cos_sql()})
  union all select query_id, chunk_id, rank, 1, 'label' from ({cos_sql('where e.label = 2')}))
 select query_id, chunk_id, round(sum(1.0::double / (60 + rank - 1)), 9) as score, arg_min(payload, list_no) as payload from l group by 1, 2"""),
    ),
    "g2_scope_gate": (
        gate,
        fx.duck("text_queries", "vec_queries", body=f"""with {BM25_CTES},
 b as (select query_id, max(score) as best from ({cos_sql()}) group by 1),
 q as (select query_id from text_queries union all select unnest([100000, 100001, 100002])),
 t as (select distinct query_id from bmr)
 select q.query_id, coalesce(best, 0.0::double) as top_similarity,
  not ((best is null and t.query_id is null) or (best is not null and best < 0.6)) as accepted
 from q left join b on b.query_id = q.query_id left join t on t.query_id = q.query_id"""),
    ),
    "g3_retrieve": (
        hybrid,
        fx.duck("text_queries", body=f"""with {BM25_CTES}, {emb_ctes('dv', 'documents', 'doc_id', 'text')}, {emb_ctes('qv', 'text_queries', 'query_id', 'query')},
 cs as (select q.id as query_id, d.id as chunk_id, round(sum(q.value * d.value), 6) as score from qv_v q join dv_v d on d.dim = q.dim group by 1, 2),
 csr as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from cs) where rank <= 20),
 l as (select query_id, chunk_id, rank from csr union all select query_id, chunk_id, rank from bmr where rank <= 20),
 fz as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank - 1)), 9) as score from l group by 1, 2),
 fr as (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from fz),
 best as (select query_id, max(score) as s from csr group by 1),
 g as (select q.query_id, coalesce(s, 0.0::double) as top_similarity,
   not ((s is null and q.query_id not in (select query_id from bmr)) or (s is not null and s < 0.6)) as accepted from text_queries q left join best b on b.query_id = q.query_id)
 select g.query_id, accepted, top_similarity, case when accepted then rank end as rank, case when accepted then chunk_id end as chunk_id, case when accepted then score end as score
 from g left join fr on fr.query_id = g.query_id and fr.rank <= 5 where accepted or coalesce(rank, 1) = 1"""),
    ),
    "g4_calibrate_threshold": (
        calibration,
        fx.duck("vec_queries", body=f"""with s as (select query_id, (select label from vec_queries v where v.query_id = c.query_id) % 2 = 0 as in_scope, score from ({cos_sql(k=1)}) c),
 b as (select count(*) filter (in_scope) as n_in, min(score) filter (in_scope) as min_in, max(score) filter (in_scope) as max_in,
  count(*) filter (not in_scope) as n_out, min(score) filter (not in_scope) as min_out, max(score) filter (not in_scope) as max_out,
  round(median(score) filter (in_scope), 6) as median_in, round(median(score) filter (not in_scope), 6) as median_out from s)
 select *, min_in > max_out as separable, case when min_in > max_out then round(min_in - max_out, 6) end as gap,
  case when min_in > max_out then round((min_in + max_out) / 2, 6) end as midpoint,
  case when not min_in > max_out then round(max_out - min_in, 6) end as overlap,
  case when not min_in > max_out then (select count(*) from s where in_scope and score < b.max_out + 0.01::double) end as lost_above_max_out,
  case when not min_in > max_out then (select count(*) from s where not in_scope and score > b.min_in - 0.01::double) end as leaked_below_min_in from b"""),
    ),
    "g4_calibration_offenders": (
        calibration_offenders,
        fx.duck("vec_queries", body=f"""with s as (select query_id, (select label from vec_queries v where v.query_id = c.query_id) % 2 = 0 as in_scope, score from ({cos_sql(k=1)}) c)
 select * from s where (not in_scope and score > (select min(score) from s where in_scope)) or (in_scope and score < (select max(score) from s where not in_scope))"""),
    ),
    "g5_normalize_query": (
        query_keys,
        fx.duck("query_log", body="""select request_id, regexp_replace(trim(regexp_replace(lower(question || '!?'), '\\s+', ' ', 'g')), '[.!?,;:]+$', '') as normalized from query_log"""),
    ),
    "g6_exact_cache_lookup": (
        exact_lookup,
        fx.duck("query_log", body=f"""with k as (select request_id, sha256(regexp_replace(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), '[.!?,;:]+$', '')) as cache_key from query_log),
 t as (select distinct regexp_extract(question, '(\\d+)', 1) as topic from query_log),
 c as (select sha256('what is topic ' || topic) as cache_key, 'answer ' || topic as answer_text from t where cast(topic as int) % 5 <> 0 and cast(topic as int) % 3 <> 0)
 select request_id, answer_text is not null as cache_hit, answer_text from k left join c on c.cache_key = k.cache_key"""),
    ),
    "g7_semantic_cache_lookup": (
        semantic_lookup,
        """with q as (select vec_id as query_id, list_transform(embedding, lambda x: round(x::double * 5, 0) / 5) as qv from embeddings),
 s as (select query_id, vec_id as cached_id, round(list_cosine_similarity(qv, embedding::double[]), 6) as score from q, embeddings where vec_id % 4 <> 0 and list_sum(list_transform(qv, lambda x: x * x)) > 0)
 select query_id, cached_id, score from (select *, row_number() over (partition by query_id order by score desc, cached_id) as rn from s) where rn = 1 and score > 0.92""",
    ),
    "g8_store_answers": (
        answer_writes,
        fx.duck("query_log", body=f"""with w as (select sha256(regexp_replace(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), '[.!?,;:]+$', '')) as cache_key,
   ts, request_id, (case when ts < timestamp '2024-01-15' then 'a' else 'b' end) || cast(request_id as varchar) as answer_text,
   case when ts < timestamp '2024-01-15' then '2023.12' else '{VERSION}' end as corpus_version from query_log where ts < timestamp '2024-01-15' or not rejected)
 select cache_key, answer_text, corpus_version from (select *, row_number() over (partition by cache_key order by ts desc, request_id desc) as rn from w) where rn = 1"""),
    ),
}
