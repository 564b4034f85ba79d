"""Time the headline queries; prints one JSON line.

Every query runs to completion into Spark's ``noop`` sink: one cold run, then the
median of ``BENCH_REPEATS`` warm runs (1 by default).  ``value`` sums the warm medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliolens.plans.queries import QUERIES  # noqa: E402
from foliolens.session import build_session  # noqa: E402

HEADLINE = (
    "filter_sort_limit", "newest_long_articles", "run_stats", "flatten_content", "barrier_classify",
    "article_info", "keywords_topk", "keyword_counts", "clean_text", "summary", "export_rows",
    "author_articles", "listing_to_article", "keep_first_by_url", "event_counters", "session_stats",
    "rate_audit", "stream_counters",
)


def timed(run) -> float:
    begin = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(
        "foliolens-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    warm, cold = {}, {}
    for name in names:
        cold[name] = round(timed(lambda: QUERIES[name](spark, folder)), 3)
        runs = [timed(lambda: QUERIES[name](spark, folder)) for _ in range(repeats)]
        warm[name] = round(statistics.median(runs), 3)
    pages, documents = (spark.read.parquet(f"{folder}/{name}.parquet").count() for name in ("pages", "documents"))
    rates = {}
    if "run_stats" in warm:
        rates["pages_per_sec_run_stats"] = round(pages / warm["run_stats"], 1)
    if "keywords_topk" in warm:
        rates["documents_per_sec_keywords_topk"] = round(documents / warm["keywords_topk"], 1)
    result = {
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "sf": os.path.basename(folder.rstrip("/")), "cold": cold, "cpus": int(cpus), **rates,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
