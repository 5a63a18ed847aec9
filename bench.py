"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8). Each query runs once to warm up and then
BENCH_RUNS times (default 3); its figure is the median. Results go to the noop sink: every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidewater import registry
from tidewater.session import builder

HEADLINE = [
    "keyed_aggregate", "global_aggregate", "max_by_min_by", "top_n_bottom_n", "linear_trend", "grouping_by", "custom_aggregate", "co_aggregate2", "co_aggregate3",
    "hash_join", "hash_join_builder", "word_count", "tf_idf", "distinct", "keyed_distinct", "rolling_aggregate", "tumbling_window", "sliding_window", "session_window",
    "windowed_co_aggregate", "map_stateful", "ttl_evict", "sql_group_having", "sql_inner_join", "sql_join_chain", "sql_math",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        builder("bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
        .master(f"local[{cpus}]").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2], "lineitem_rows_per_sec": round(rows / took["keyed_aggregate"]), "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
