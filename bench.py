"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores. Results go to
Spark's no-op sink, so every column of every row is computed. Each query runs twice and the
faster run counts, plan building included; ``member_scores`` builds all its zones each time,
the other score queries read zones built before.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES, shared_lake

HEADLINE = (
    "drop_exact_duplicates",
    "customers_silver",
    "loans_silver",
    "repayments_silver",
    "delinquent_members",
    "record_enquiry_detail",
    "profile_repayments",
    "purpose_frequencies",
    "duplicate_keys",
    "duplicate_lines",
    "exclude_keys",
    "wide_view_silver",
    "wide_view_cleaned",
    "payment_points",
    "default_points",
    "health_points",
    "grade_counts",
    "score_by_loan",
    "member_scores",
    "run_from_files",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("creditmill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_lake(spark, sf_dir)
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
