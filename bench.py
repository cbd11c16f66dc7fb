"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is built and run to a no-op sink; `value` is the sum. Throughput of the replay is
reported as transactions per second next to it. The JVM is warmed up beforehand, unmeasured,
with three of the queries on the smallest tables (class loading and compilation).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ledgerproof.plans import QUERIES
from ledgerproof.plans.tables import tables

HEADLINES = (
    "b2_tie_order_format1",
    "b3_tie_order_sheets",
    "b7_running_balance",
    "b14_statement_summary",
    "b12_closed_form_summary",
    "d1_duplicates",
    "d8_cashback_vote",
    "a14_strategy_winner",
    "f11_header_scan",
    "f14_all_metrics",
    "s1_wallet_csv",
    "c1_amount_clean",
    "j7_customer_lineage",
    "a3_analysis_raw",
    "a10_exposure",
    "a11_verdict_stats",
    "w3_mismatch_context",
    "w5_endpoints",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerproof-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = tables(spark, folder)
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in ("b2_tie_order_format1", "f14_all_metrics", "s1_wallet_csv"):
        QUERIES[name](spark, small if os.path.isdir(small) else folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = {r["format"]: r["count"] for r in t.txn.groupBy("format").count().collect()}
    rate = {
        "format_1": rows["format_1"] / times["b2_tie_order_format1"],
        "sheets": rows["excel"] / times["b3_tie_order_sheets"],
        "all": sum(rows.values()) / times["b7_running_balance"],
    }
    print(
        json.dumps(
            {
                "metric": "verification_and_report_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "txns_per_second": {k: round(v) for k, v in rate.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
