"""Time the headline queries; prints one JSON line.

Writing the chunks and postings that the search queries read is timed on its own, as
``index_corpus``. Every other query is timed as it runs after that.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from daftar.catalog import QUERIES
from daftar.catalog.base import Tables
from daftar.session import local_session

HEADLINE = (
    "normalize_for_index", "tokens", "chunk_documents", "strip_html", "redact_documents", "plan_rules",
    "lexical_search", "lexical_search_idf", "dense_search", "hybrid_search", "rerank", "fit_context", "evaluate",
    "cache_lookup", "threshold_sweep", "auc", "stage_summary", "counter_increases", "sliding_window_admission",
    "upsert", "source_urls",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["check_dims"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start workers
    seconds = {}
    start = time.perf_counter()
    tables = Tables(spark, sf_dir)
    tables.index.write.format("noop").mode("overwrite").save()
    seconds["index_corpus"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
