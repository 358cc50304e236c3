"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

BENCH_QUERIES=all times every registered query, or takes a comma-separated
list. Each query runs once to warm up and BENCH_RUNS times (3) for the median;
rows go to Spark's no-op sink, so nothing but the query is timed.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from drayage.plans.catalog import load_all  # noqa: E402
from drayage.session import build_session  # noqa: E402

HEADLINE = (
    "dataflow_orders df_filter df_derive df_lookup_first df_exists df_aggregate agg_functions dedup_first df_split "
    "df_surrogate_key computed_columns reconcile_summary reconcile_mismatches conform_cast column_mapping null_profile "
    "column_profile duplicate_keys orphan_keys quality_scorecard dependency_waves incremental_load scd2_history "
    "merge_upsert changelog_replay copy_tables evaluate_all_controls findings_summary findings_by_domain "
    "findings_urgent infer_document_schema flatten_documents document_find token_rollup dependency_gate "
    "report_classify markdown_table_rows plan_steps_extract list_to_table alert_failures stream_dedup"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    registered = load_all()
    names = list(registered) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)

    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    with contextlib.redirect_stdout(sys.stderr):
        for name in names:
            rows[name] = registered[name].run(spark, folder).count()  # warm-up
            times = []
            for _ in range(runs):
                start = time.perf_counter()
                registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
            seconds[name] = round(statistics.median(times), 3)
            print(f"{name:28s} {seconds[name]:8.3f}s {rows[name]:>9d} rows", flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
