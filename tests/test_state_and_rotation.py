"""Ladders, rotation that stops anywhere, streams with state, early stop and key search: laws and what the plans read."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retention, timetravel
from tidemark.operators import search as S
from tidemark.operators.ladder import Ladder
from tidemark.operators.rotation import Rotation
from tidemark.plans.sources_and_streams import controlled_feed, in_parts
from tidemark.plans.views import accounts, orders_baseline, orders_log
from tidemark.sources import archive
from tidemark.streaming import ingest, stateful


def rows_read(df) -> int:
    """Rows that the scans of a plan give, after it has run."""
    df.collect()
    found = df._jdf.queryExecution().executedPlan()
    total, stack = 0, [found]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        if "QueryStage" in node.getClass().getSimpleName():
            stack.append(node.plan())
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_ladder(spark, sf_dir, tmp_path):
    log, base = orders_log(spark, sf_dir), orders_baseline(spark, sf_dir)
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    ladder = Ladder(spark, str(tmp_path / "ladder"))
    ladder.start(base, "1998-01-01 00:00:00")
    moment, days = datetime(1998, 1, 1), 25
    for i in range(1, 7):
        ladder.climb(log, moment + timedelta(days=days * i))
    rungs = ladder.rungs()
    assert [r.level for r in rungs] == [-1, 2, 1] and len(rungs[1].parents) == 2  # six climbs: four and two
    for at in (moment, moment + timedelta(days=30), moment + timedelta(days=150, hours=5), datetime(2001, 1, 1)):
        got = {tuple(r) for r in ladder.state_at(log, at).collect()}
        assert got == {tuple(r) for r in timetravel.state_at(base, log, at).collect()}
    with pytest.raises(ValueError):
        ladder.climb(log, moment + timedelta(days=9))
    with pytest.raises(ValueError):
        ladder.state_at(log, moment - timedelta(days=1))
    text = ladder.state_at(log, moment + timedelta(days=151))._jdf.queryExecution().optimizedPlan().toString()
    assert "event_timestamp" in text and "1998-05-31" in text  # the log's filter begins at the last rung


@pytest.mark.parametrize("phase", ["archived", "counted", "listed", "dropped"])
def test_rotation_stops_anywhere(spark, tmp_path, phase):
    rows = [(i, datetime(2024, 1, 1, i % 5, i % 60), "app", "t", str(i % 7)) for i in range(200)]
    schema = "event_id long, event_timestamp timestamp, schema_name string, table_name string, pk_values string"
    archive.write_archive(spark.createDataFrame(rows[:150], schema), str(tmp_path / "live"), "s1")
    rotation = Rotation(spark, str(tmp_path / "live"), str(tmp_path / "archive"), "s1")

    def stop(at):
        if at == phase:
            raise InterruptedError(at)

    def everything():
        live = archive.read_archive(spark, str(tmp_path / "live"))
        return sorted(r.event_id for r in live.select("event_id").unionByName(rotation.archived().select("event_id")).collect())

    with pytest.raises(InterruptedError):
        rotation.run("2024-01-08 03:00:00", "7 days", stop)
    assert set(everything()) == set(range(150))
    late = spark.createDataFrame(rows[150:], schema).withColumns({"server_id": F.lit("s1"), "event_date": F.to_date("event_timestamp"), "event_hour": F.hour("event_timestamp")})
    late.select(*archive.columns(late), *archive.PARTITIONS).write.partitionBy(*archive.PARTITIONS).mode("append").parquet(str(tmp_path / "live"))
    rotation.run("2024-01-08 03:00:00", "7 days")
    assert everything() == list(range(200))
    assert {r.event_timestamp.hour for r in rotation.archived().collect()} == {0, 1, 2}
    assert {r.partition_name: r.row_count for r in rotation.ledger().collect()} == {f"p_202401010{h}": 40 for h in range(3)}


def test_rotation_waits_for_uploads(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 2)) for i in range(10)]
    archive.write_archive(spark.createDataFrame(rows, "event_id long, event_timestamp timestamp"), str(tmp_path / "live"), "s1")
    rotation = Rotation(spark, str(tmp_path / "live"), str(tmp_path / "archive"), "s1", "bucket")
    assert rotation.run("2024-02-01 00:00:00", "7 days") == [] and archive.read_archive(spark, str(tmp_path / "live")).count() == 10
    rotation.uploaded([datetime(2024, 1, 1, 1)], datetime(2024, 2, 1))
    # Archived again, the hour has to be uploaded again, so a run that finds its events still live doesn't drop it.
    assert rotation.run("2024-02-01 00:00:00", "7 days") == []
    hours = [datetime(2024, 1, 1, h) for h in (0, 1)]
    rotation.uploaded(hours, datetime(2024, 2, 1))
    assert rotation.drop("2024-02-01 00:00:00", "7 days") == hours
    assert rotation.archived().count() == 10


def test_stream_is_the_batch(spark, sf_dir, tmp_path):
    """Parts with restarts and replays give what the feed at rest gives."""
    feed = controlled_feed(spark, sf_dir)
    for _ in in_parts(feed, str(tmp_path / "in"), 2):
        stream = stateful.annotated_stream(ingest.read_feed(spark, str(tmp_path / "in" / "*"), feed.schema), 1)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    names = ["event_id", "gtid", "connection_id", "schema_version", "previous_uuid", "replaced", "rows", "query"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(names).collect()), key=repr)
    want = sorted(map(tuple, stateful.annotated(feed, 1).select(names).collect()), key=repr)
    assert got == want and sum(r[5] for r in got) > 2


def test_buffer_is_newest_after_each_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = spark.createDataFrame([], "event_id long, event_timestamp timestamp, size long").schema
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000)), rng.choice([None, 0, 10, 70])) for i in range(600)] + [(700, None, 5)]
    rng.shuffle(rows)
    buffer = stateful.Buffer(str(tmp_path / "b"), "30 hours", 150, 4000)
    for n in range(4):
        batch = spark.createDataFrame(rows[n * 151 : (n + 1) * 151], schema)
        for _ in range(2):  # a batch that is run again changes nothing
            buffer(batch, n)
        so_far = spark.createDataFrame(rows[: (n + 1) * 151], schema)
        last = max(r[1] for r in rows[: (n + 1) * 151] if r[1])
        want = retention.newest(retention.recent(so_far, last, "30 hours"), 150, 4000)
        assert {r.event_id for r in buffer.read(spark, schema).collect()} == {r.event_id for r in want.collect()}
    stored = spark.read.parquet(str(tmp_path / "b" / "rows")).count()
    assert stored < 400  # hours beyond the caps are gone from the disk


def test_first_n_reads_few_hours(spark, sf_dir, tmp_path):
    log = accounts(spark, sf_dir)
    archive.write_archive(log, str(tmp_path), "s1")
    stored = archive.read_archive(spark, str(tmp_path))
    hours = stored.groupBy(F.date_trunc("hour", "event_timestamp").alias("hour")).agg(F.count("*").alias("events"))
    for s in (S.Search(), S.Search(table="wallets"), S.Search(pk="11"), S.Search(until="2024-01-03 00:00:00"), S.Search(pk="none")):
        found = S.first_n_of_hours(stored, 20, hours, s)
        assert [r.event_id for r in found.collect()] == [r.event_id for r in S.first_n(S.matching(stored, s), 20).collect()]
    assert 20 <= rows_read(S.first_n_of_hours(stored, 20, hours, S.Search(table="wallets"))) < stored.count() / 3


def test_key_search_skips_row_groups(spark, tmp_path):
    """Keys in order and in small row groups with bloom filters: a search for one reads a small part of an hour."""
    log = spark.range(60_000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id % 3600) AS event_timestamp", "'app' AS schema_name", "'t' AS table_name", "2 AS event_type", "cast(id * 7919 % 60000 AS STRING) AS pk_values", "repeat(cast(id AS STRING), 20) AS row_after")
    archive.write_archive(log, str(tmp_path / "k"), "s1", by_key=True, group_bytes=100_000)
    archive.write_archive(log, str(tmp_path / "p"), "s1")
    one = lambda name: S.matching(archive.read_archive(spark, str(tmp_path / name)), S.Search(pk="4711"))
    assert [r.event_id for r in one("k").collect()] == [r.event_id for r in one("p").collect()] and one("k").count() == 1
    assert 0 < rows_read(one("k")) < 0.3 * 60_000 < rows_read(one("p"))


def test_state_in_dump_order(spark, sf_dir):
    state = timetravel.inserted_last(timetravel.state_at(orders_baseline(spark, sf_dir), orders_log(spark, sf_dir), "1999-06-01 00:00:00")).collect()
    new = [r.action == "inserted" for r in state]
    keys = [r.pk_values for r in state if r.action == "inserted"]
    assert new == sorted(new) and keys == sorted(keys) and len(keys) > 3
