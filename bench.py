"""Times the headline queries on the data of $BENCH_SF_DIR with $BENCH_CPUS threads; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from keelvault.plans.catalogue import QUERIES

HEADLINE = ["hub_order_initial", "hub_multi_source", "hub_incremental_global_hwm", "link_order_customer", "link_multi_source", "sat_initial_multi_batch", "sat_incremental_multi_batch", "sat_v1_end_dated", "stage_ghost", "vault_pipeline"]
RUNS = 3


def main() -> None:
    directory, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):  # the first compiles
            began = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(sorted(taken[1:])[RUNS // 2], 3)
    print(json.dumps({"metric": "vault_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
