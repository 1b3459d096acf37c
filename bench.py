"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. The refresh (raw rows to stored fact) is
timed as a query of its own; the marts and slices then read the stored layers, as they do in use. Every query is
run to its last row into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerspark import registry  # noqa: E402
from ledgerspark.plans.daily import mart_daily_metric_runs, mart_daily_metric_values  # noqa: E402
from ledgerspark.session import build_session  # noqa: E402

HEADLINE = [
    "merchant_normalization",
    "transaction_features",
    "recurring_transactions",
    "fact_transactions",
    "mart_anomalies",
    "mart_recurring_spend",
    "mart_monthly_spend",
    "mart_monthly_kpis",
    "mart_category_metrics",
    "mart_spend_kpis",
    "mart_data_quality",
    "mart_merchant_review",
    "mart_metric_summary",
    "kpi_row",
    "top_merchants",
    "change_table",
    "merchant_candidates",
    "cache_upsert",
    "median_aggregate",
    "dq_grain_report",
    "lexical_score",
    "build_search_documents",
    "hybrid_search",
    "embedding_backfill",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "ledgerspark-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    context = registry.context(spark, folder)
    seconds: dict[str, float] = {}

    def clock(name, work) -> None:
        started = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - started, 3)

    clock("refresh_layers", lambda: context.layers)
    clock("refresh_search_tables", lambda: (context.documents, context.embedding_cache))
    for name in HEADLINE:
        build = registry.ENTRIES[name][0]
        clock(name, lambda build=build: run(build(context)))
    clock("mart_daily_metric_runs", lambda: run(mart_daily_metric_runs(context.fact)))
    clock("mart_daily_metric_values", lambda: run(mart_daily_metric_values(context.fact)))
    for name in ("metric_rollup", "metric_trend", "summary_record"):
        build = registry.ENTRIES[name][0]
        clock(name, lambda build=build: run(build(context)))
    print(
        json.dumps(
            {
                "metric": "ledgerspark_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
