"""Benchmark: prints one JSON line with seconds per query.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` choose data and cores, ``BENCH_QUERIES`` a
comma-separated subset. The search index is written once by ``build_index`` and timed there,
as an archive builds it once; every other query runs its whole plan. Results are fully computed
through the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from vocarium.plans import catalog
from vocarium.plans.views import shared_views
from vocarium.session import build_session

HEADLINE = (
    "chunk_utterances", "hybrid_search", "bm25_search", "quote_search", "knn_search", "knn_sign_bits", "knn_lsh",
    "rrf_merge", "chunk_diff", "inventory_sync", "reconcile_index", "gallery_dedupe", "md5_dedupe_links",
    "words_in_chunk", "resolve_quote_start", "chunk_set_hash", "history_dedupe", "retry_backoff", "folder_path",
    "dq_report", "dq_repair_plan", "normalise_utterances", "hashed_embedding", "stream_outbox_apply",
    "stream_queue_depth", "stream_task_state",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session("bench", cores, int(cores) if cores.isdigit() else 8, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # JVM start is not part of any query

    timings: dict[str, float] = {}
    start = time.perf_counter()
    shared_views(spark, folder)["search_index"]
    timings["build_index"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        catalog.runnable(name)(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
