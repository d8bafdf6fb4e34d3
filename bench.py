"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("state_at", "reconstruct_report", "row_history", "search_time_range", "search_column_eq", "search_changed_column", "latest_n_per_pk", "merge_and_trim", "undo_update", "hour_coverage")


def merge_inputs(spark, rows: int):
    """A snapshot of so many rows and changes to every hundredth, written once as Parquet."""
    import tempfile

    root = tempfile.mkdtemp(prefix="spark-bench-")
    image = lambda k, s: F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"payload":"'), F.lit(s), F.lit('"}'))
    k = F.col("id")
    spark.range(rows).select(k.cast("string").alias("pk_values"), image(k, "x" * 40).alias("row_image")).write.parquet(f"{root}/b")
    c = F.col("id") * 100
    spark.range(rows // 100).select(F.col("id").alias("event_id"), F.lit("1999-01-01").cast("timestamp").alias("event_timestamp"), F.lit(2).alias("event_type"), c.cast("string").alias("pk_values"), image(c, "y" * 40).alias("row_after")).write.parquet(f"{root}/c")
    return spark.read.parquet(f"{root}/b"), spark.read.parquet(f"{root}/c")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.operators import timetravel
    from tidemark.plans.registry import QUERIES as OWN

    times, cold = {}, {}

    def measure(name, make):
        for store in (cold, times):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - start, 3)

    for name in QUERIES:
        measure(name, lambda name=name: OWN[name](spark, SF_DIR))
    for label, rows in (("merge_100k", 100_000), ("merge_1m", 1_000_000), ("merge_10m", 10_000_000)):
        base, changes = merge_inputs(spark, rows)
        measure(label, lambda: timetravel.state_at(base, changes, "2000-01-01"))
    print(json.dumps({"metric": "warm seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
