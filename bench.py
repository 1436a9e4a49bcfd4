"""Headline queries at one scale; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then three times; the median counts. Results
go to Spark's no-op sink, so that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from dataquay.plans import QUERIES, Tables
from dataquay.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINES = (
    "infer_lineitem",
    "infer_column_type",
    "infer_char_size",
    "profile_columns",
    "profile_columns_quick",
    "profile_deciles",
    "visible_sources",
    "sources_with_attributes",
    "source_document",
    "list_sources",
    "sort_page",
    "page_deep",
    "fk_join",
    "fk_orphans",
    "upsert",
    "partial_update",
    "permission_upsert",
    "typed_convert",
    "csv_scan",
    "export_csv",
    "strip_accents",
    "upload_completeness",
    "upload_missing_parts",
    "anonymize",
    "privacy_risk",
    "l_diversity_lines",
    "stream_upload_completeness",
)


def run(name: str, tables: Tables) -> float:
    start = time.perf_counter()
    QUERIES[name].run(tables).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session("bench", CPUS, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    tables = Tables(spark, SF_DIR)
    seconds = {}
    for name in HEADLINES:
        run(name, tables)
        seconds[name] = round(statistics.median(run(name, tables) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
