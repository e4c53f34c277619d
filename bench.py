"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line on stdout.

Every query runs once cold and then warm; the warm time counts, the cold one
is reported next to it.  Results go to the noop sink, so whole results are
computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioflow.plans.catalog import QUERIES  # noqa: E402
from folioflow.session import local_session, stage_run  # noqa: E402

HEADLINE = (
    "f3_bm25_topk",
    "f5_vector_topk",
    "g3_retrieve",
    "i4_summary",
    "i5_daily_series",
    "i6_top_questions",
    "i9_admission",
    "c1_extract_paragraphs",
    "c4_repeating_lines",
    "c8_parse_act_lines",
    "d1_chunk_sections",
    "d2_pack_paragraphs",
    "e3_embed_batches",
    "a7_upsert_latest",
    "b13_merge_fills",
    "h2_verify_citations",
)


def run(query, spark, sf: str) -> float:
    with stage_run(spark):
        start = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "folioflow-bench")
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "events", "lineitem")}
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(QUERIES[name], spark, sf), 3)
        warm[name] = round(min(run(QUERIES[name], spark, sf) for _ in range(2)), 3)
        print(f"{name:28s} cold {cold[name]:7.2f}  warm {warm[name]:7.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
