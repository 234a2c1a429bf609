"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from oddsloom.plans.registry import QUERIES

HEADLINE = ["w01_rolling_features", "w03_trade_features", "a01_edge_by_bucket", "a02_edge_grid", "x14_oos_edges", "a03_simulate_grid", "w08_equity_curve", "m26_fee_aware_pnl", "j07_next_print", "w18_logit_rsi", "w25_forward_labels", "x01_walk_book", "a08_canonical_fills"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = []
        for _ in range(2):  # the first run compiles
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.time() - start)
        took[name] = round(min(best), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
