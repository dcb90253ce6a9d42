"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from tetraspark.plans import catalog

HEADLINE = ["bgp_star", "bgp_join", "group_by_revenue", "optional", "filter_exists", "aggregates", "order_limit", "subselect", "graph_variable", "path_sequence", "construct", "events_by_user", "store_filter", "simple_intersection"]


def main() -> None:
    at, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_, took = catalog.queries(), {}
    all_[HEADLINE[0]](spark, at).write.format("noop").mode("overwrite").save()  # the session's own start
    for name in HEADLINE:
        start = time.perf_counter()
        all_[name](spark, at).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([\d.]+)", at)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
