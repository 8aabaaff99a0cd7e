"""Seconds per headline query; the last line printed is one JSON object.

Corpus tables and the index are built first and reported apart (``build``);
each query is then run cold and warm, and the warm time is its value.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarrylight.operators.index import stored_postings  # noqa: E402
from quarrylight.operators.retrieve import shard_documents  # noqa: E402
from quarrylight.plans import catalog  # noqa: E402
from quarrylight.plans.catalog_normalize import normalized  # noqa: E402
from quarrylight.plans.catalog_ops import policies  # noqa: E402
from quarrylight.session import build_session  # noqa: E402
from quarrylight.sources.corpus import Corpus  # noqa: E402

HEADLINE = (
    "program_search", "program_search_exact", "program_search_fallback", "source_search", "text_rank", "postings",
    "query_expansion", "answers", "evidence_cards", "rerank", "normalize_documents", "payload_type", "validation_errors",
    "extract_candidate_urls", "canonicalize_urls", "create_sources", "link_claims", "apply_extractions", "domain_quality",
    "admission_decisions", "crawl_plan", "run_items_dry", "backlog_report", "run_summary", "run_history", "dashboard",
    "candidate_pools", "baseline_eval", "ndcg_at_k", "corpus_violations", "rate_limit", "quota_usage", "crawl_health_windows",
    "source_detail", "snippets",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "quarrylight.input.partitions": cpus, "quarrylight.index.shard_docs": "1024", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    c = Corpus(spark, folder)
    build = {}
    for name in ("page_urls", "domains", "page_sources", "documents", "sources", "programs", "claim_refs", "crawl_jobs",
                 "requests", "payloads", "run_items"):
        build[name] = timed(lambda: getattr(c, name))
    build["normalized"] = timed(lambda: normalized(c))
    build["policies"] = timed(lambda: policies(c))
    build["term_index"] = timed(lambda: stored_postings(c))
    build["search_shelf"] = timed(lambda: shard_documents(c))

    cold, warm = {}, {}
    for name in names:
        def run(name=name):
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

        cold[name], warm[name] = timed(run), timed(run)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "cold": cold, "build": build,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
