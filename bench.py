"""Headline queries, timed: BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from lorespark import registry  # noqa: E402

HEADLINE = [
    "v1_bm25", "v1_bm25_fields", "v2_all_terms", "v2_phrase", "v9_lexical_search", "v26_search", "v17_evidence", "v3_knn_exact", "v3_knn_graph", "v3_scan_codes", "v10_hybrid_merge",
    "c1_snapshot_diff", "c13_carry_forward", "u2_dedup_content", "g3_g4_resolution", "g6_bfs", "g11_g12_impact", "g14_links_by_name", "n1_html_units", "n2_chunks", "a1_chunk_kind_counts", "a5_status_rollup", "w1_top_per_key", "x1_debounce",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["a3_table_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's parts
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
