"""Times the headline queries; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from graphloom.plans import queries as plans

HEADLINE = ("gor_affinity", "gor_pair_counts", "triples_distinct", "stripe", "text_tokens", "node_upsert", "edge_upsert", "inferred_edges", "wordcloud")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start-up is no part of a query
    took = {}
    for name in HEADLINE:
        start = time.time()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
