"""Times headline queries after a warm-up, each as the median of three; prints one JSON line. `--plans` adds exchanges per plan."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from stationlake import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
NAMES = ("net_flow", "turnover", "stockout_episodes", "service_reliability", "availability_stats", "coverage_stations", "dynamic_gini", "ghost_vehicles", "idle_share", "audit_systems", "network_changes", "join_exogenous", "outage_redundancy", "ripley_k", "synchrony")
#: Timed too, but not part of the total.
MORE = ("audit_static", "morans_i", "local_moran_inference", "outage_rates", "id_persistence", "cluster_density", "coverage_stats", "two_step_fca")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, exchanges = catalogue.queries(), {}, {}
    for name in (*NAMES, *MORE):
        runs = []
        for i in range(RUNS + 1 if name in NAMES else 2):
            began = time.time()
            df = queries[name](spark, SF_DIR)
            df.write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
        if "--plans" in sys.argv:
            exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    line = {"metric": "total seconds of the headline queries", "value": round(sum(took[n] for n in NAMES), 3), "unit": "sec", "queries": {n: took[n] for n in NAMES}, "more": {n: took[n] for n in MORE}, "sf": os.path.basename(SF_DIR).removeprefix("sf")}
    print(json.dumps(line | ({"exchanges": exchanges} if exchanges else {})))


if __name__ == "__main__":
    main()
