"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is written to Spark's no-op sink, so every row and column is computed. It runs ``$BENCH_RUNS`` times (2 unless
set) and the best time counts, so that compiling and warming up are left out; ``cold`` has the first run's times.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quireflow import plans
from quireflow.plans import views
from quireflow.session import configure

HEADLINE = [
    "pattern_rollup", "search_whole_word", "search_page_counts", "redact_text", "paginate_text", "bates_number", "split_by_size",
    "merge_documents", "page_text", "paragraphs", "detect_tables", "table_rows", "document_blocks", "import_report", "build_threads",
    "html_paragraphs", "html_flat_text", "compress_report", "glyph_usage", "edit_history", "chunk_text", "knn",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quireflow-bench")
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark.read.parquet(f"{folder}/region.parquet").count()
    names = sys.argv[1:] or HEADLINE
    registered, times, cold, pages = plans.queries(), {}, {}, 0
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name], cold[name] = round(min(taken), 3), round(taken[0], 3)
    if not sys.argv[1:]:
        pages = views.Views(spark, folder).page_keys().count()  # every page, with or without a match
    out = {"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}
    out |= {"cold": cold, "cold_value": round(sum(cold.values()), 3), "cpus": int(cpus)}
    if pages:
        out["pages"] = pages
        for name in ("search_whole_word", "pattern_rollup"):
            out[f"{name}_pages_per_sec_per_core"] = round(pages / times[name] / int(cpus), 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
