"""What a task holds doesn't grow with the tables."""

import re

from pyspark.sql import functions as F

from tidemark.operators import timetravel, undo
from tidemark.plans import sources_and_streams, views
from tidemark.plans.registry import QUERIES
from tidemark.sources import archive
from tidemark.streaming import stateful


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_snapshot_are_spread(spark):
    state = spark.range(4000).select(F.col("id").cast("string").alias("pk_values"), F.lit("passthrough").alias("action"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in timetravel.inserted_last(state).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_shuffles_begin_with_partitions_by_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(views, "PART_BYTES", 10_000)
    views.accounts(spark, sf_dir)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == views.width(spark, sf_dir) > 4
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_no_window_holds_a_servers_events(spark, sf_dir):
    text = plan(stateful.annotated(sources_and_streams.controlled_feed(spark, sf_dir)))
    assert not any("end_pos" in w for w in re.findall(r"windowspecdefinition\(server_id#\d+, length.*?specifiedwindowframe", text))


def test_parts_of_a_feed_are_bounded(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(sources_and_streams, "BATCH_EVENTS", 100)
    feed = spark.range(1000).withColumnRenamed("id", "event_id")
    runs = list(sources_and_streams.in_parts(feed, str(tmp_path)))
    sizes = [spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()]
    assert len(runs) == 3 and len(sizes) >= 10 and max(sizes) <= 120


def test_undo_keeps_columns(spark, sf_dir):
    log = views.accounts(spark, sf_dir)
    snapshots = spark.sql(sources_and_streams.TYPED_SNAPSHOTS)
    out = undo.statements(log, snapshots, kept=["pk_values"])
    assert out.columns[-1] == "pk_values" and out.count() == log.count()


def test_states_of_a_ladder_read_a_log_that_lies_there(spark, sf_dir):
    assert "l_shipdate" not in plan(QUERIES["ladder_states"](spark, sf_dir))


def test_events_that_come_twice_are_archived_once(spark, sf_dir, tmp_path):
    log = views.accounts(spark, sf_dir)
    archive.write_archive(log.unionByName(log.filter("event_id % 3 = 0")), str(tmp_path), "s1", once=True)
    there = archive.read_archive(spark, str(tmp_path)).select("event_id")
    assert there.count() == there.distinct().count() == log.count()
