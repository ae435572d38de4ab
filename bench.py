"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then, in turn with the others, `BENCH_RUNS` times; its figure is
the median. Results are written to the noop sink, so that all of them are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

#: Reports, features, workflow, preparation, metrics, drift: the reference's own work.
HEADLINE = [
    "txn_features", "extreme_amount", "daily_anomaly", "user_totals_all", "user_totals_recent200", "daily_amounts_by_type",
    "recent_alerts", "alert_with_label", "admission_gate", "adaptive_contamination", "label_upsert", "notification_outbox",
    "payload_validation", "impute_fill", "stratified_split", "roc_auc", "ensemble_decision", "velocity_features", "psi",
    "ks_statistic",
]


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def main() -> None:
    from ledgerlark.plans.queries import QUERIES

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for run in range(RUNS + 1):
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if run:
                times[name].append(time.perf_counter() - start)
    medians = {name: round(statistics.median(t), 3) for name, t in times.items()}
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(medians.values()), 3), "unit": "sec", "queries": medians,
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
