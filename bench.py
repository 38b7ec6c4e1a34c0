"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The engine's own queries; recursive ones are run less often.
HEADLINE = ["flagship", "filter", "join", "join_weights", "antijoin", "set_minus_keeps_multiplicity", "distinct", "counts", "histogram", "group_min", "sum_in_weight", "reduce", "reduce_top2", "triangles", "incremental_delete", "closure_tree", "distances_cyclic"]
SLOW = {"closure_tree", "distances_cyclic", "incremental_delete"}
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from zedweave.queries import QUERIES

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took = {}
    for name in HEADLINE:
        once(name)  # compiles
        took[name] = round(median(once(name) for _ in range(1 if name in SLOW else RUNS)), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
