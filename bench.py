"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from loomgraph.plans.queries import QUERIES

HEADLINE = [
    "match_hop", "match_chain", "match_expand_into", "match_optional", "variable_length_paths", "traverse_breadth_first", "group_by", "statistics", "percentile", "top_skip_limit",
    "predicates", "time_buckets", "series_lag_moving", "vector_neighbours", "vector_centroids", "full_text", "algo_wcc", "algo_triangle_count", "algo_page_rank", "algo_degree", "cypher_group", "cypher_pattern_predicates", "sql_out_size", "sql_match",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["group_by"](spark, folder).collect()  # starts the executors' threads and compiles the scan
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total wall seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
