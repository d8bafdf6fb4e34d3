"""Streams with a memory: what a server's log says once and means for all that follows, and a buffer with a budget.

A log's events carry their transaction and schema version only implicitly: a transaction record opens it, a DDL statement
changes the schema, and both hold until the next one. Streams keep that as state of the server, so that batches and restarts
make no difference; annotated() says the same of a log at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.normalise import ddl_rows, normalise
from tidemark.operators.retention import newest
from tidemark.schema import DDL, DELETE, INSERT, UPDATE
from tidemark.session import remove, share_package
from tidemark.sources.baseline import exists

#: What a server's state holds: the last event's place, and what holds from there on.
CARRIED = "binlog_file string, end_pos long, gtid string, connection_id long, schema_version int, server_uuid string"
#: What annotated streams and logs have besides the columns of the feed.
ADDED = "schema_version int, previous_uuid string, replaced boolean"


def sets_version() -> Column:
    """The schema version that a DDL event begins, if it does; TRUNCATE changes no schema, nor does a failed snapshot."""
    return F.when((F.col("event_type") == DDL) & (F.coalesce("ddl_type", F.lit("")) != "TRUNCATE TABLE"), F.col("snapshot_id"))


def annotated(feed: DataFrame, before: int = 0) -> DataFrame:
    """A feed at rest, each event once: gtid and connection_id as they hold in its file, schema_version as the DDL before it in
    its server's log left it (`before` at first), previous_uuid and whether the server is another than before."""
    own = feed.dropDuplicates(["server_id", "binlog_file", "end_pos"])
    keys = ["server_id", "binlog_file"]
    # What a file takes over from those before it: a row for each file, so that no task has a server's whole log.
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("end_pos")))
    files = feed.groupBy(*keys).agg(last(sets_version()).alias("_version"), last(F.col("server_uuid")).alias("_uuid"))
    earlier = W.partitionBy("server_id").orderBy(F.length("binlog_file"), "binlog_file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select(*[F.col(c).alias(f"_{c}") for c in keys], *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in ("_version", "_uuid")])
    file = W.partitionBy(*keys).orderBy("end_pos")
    so_far, behind = file.rowsBetween(W.unboundedPreceding, 0), file.rowsBetween(W.unboundedPreceding, -1)
    out = own.withColumns({
        "_own_version": F.last(sets_version(), ignorenulls=True).over(so_far), "_own_uuid": F.last("server_uuid", ignorenulls=True).over(behind),
        "gtid": F.last("gtid", ignorenulls=True).over(so_far), "connection_id": F.last("connection_id", ignorenulls=True).over(so_far),
    })
    out = out.join(files, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]), "left")
    out = out.withColumns({"schema_version": F.coalesce("_own_version", "_version", F.lit(before)), "previous_uuid": F.coalesce("_own_uuid", "_uuid")})
    out = out.drop("_own_version", "_own_uuid", "_version", "_uuid", *[f"_{c}" for c in keys])
    return out.withColumn("replaced", F.coalesce(F.col("server_uuid") != F.col("previous_uuid"), F.lit(False)))


class Carry(StatefulProcessor):
    """Annotates a server's events batch by batch. Events at or before the last place are replays and go."""

    def __init__(self, before: int, kept_ms: int | None):
        self.before, self.kept_ms = before, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("carried", CARRIED, self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True)
        held = self.kept.get() if self.kept.exists() else None
        file, pos, gtid, connection, version, uuid = held if held is not None else (None, None, None, None, self.before, None)
        own["_length"] = own.binlog_file.str.len()
        own = own.sort_values(["_length", "binlog_file", "end_pos"]).drop_duplicates(["binlog_file", "end_pos"])
        if file is not None:
            later = (own._length > len(file)) | (own._length == len(file)) & ((own.binlog_file > file) | (own.binlog_file == file) & (own.end_pos > pos))
            own = own[later]
        if not len(own):
            return
        own = own.reset_index(drop=True)
        same = own.binlog_file == file
        for name, value in (("gtid", gtid), ("connection_id", connection)):
            column = own.groupby("binlog_file", sort=False)[name].ffill()
            own[name] = column.where(column.notna() | ~same, value) if value is not None else column
        own["schema_version"] = own.pop("version").ffill().fillna(version).astype("int32")
        seen = own.server_uuid.ffill()
        own["previous_uuid"] = seen.shift(1).fillna(uuid) if uuid is not None else seen.shift(1)
        own["replaced"] = own.server_uuid.notna() & own.previous_uuid.notna() & (own.server_uuid != own.previous_uuid)
        last = own.iloc[-1]
        none = lambda x: None if pd.isna(x) else x
        number = none(last.connection_id)
        self.kept.update((last.binlog_file, int(last.end_pos), none(last.gtid), None if number is None else int(number), int(last.schema_version), none(seen.iloc[-1]) or uuid))
        yield own.drop(columns="_length")

    def close(self) -> None:
        pass


def annotated_stream(feed: DataFrame, before: int = 0, kept_ms: int | None = None) -> DataFrame:
    """annotated() of a stream. A server's events come in log order from batch to batch; within a batch any order does. State
    is kept by server, as schema versions cross its files, and is bounded by the servers; a batch's events of one server are
    one task's, so that the trigger's limits bound memory. kept_ms: the state of a server that sends nothing for so long goes; such a
    stream looks for it in batches of its own, so that it never ends by itself."""
    spark = feed.sparkSession
    share_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [c for c in feed.columns if c != "rows"]
    sent = feed.select(*columns, F.to_json("rows").alias("rows"), sets_version().cast("double").alias("version"))
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.name == "rows" else f.dataType) for f in [*[feed.schema[c] for c in columns], feed.schema["rows"]]])
    out = T.StructType([*plain.fields, *T.StructType.fromDDL(ADDED).fields])
    done = sent.groupBy("server_id").transformWithStateInPandas(Carry(before, kept_ms), out, "Append", "None" if kept_ms is None else "ProcessingTime")
    return done.withColumn("rows", F.from_json("rows", feed.schema["rows"].dataType)).select(*feed.columns, *T.StructType.fromDDL(ADDED).names)


def normalising(snapshots: Callable[[SparkSession], DataFrame], log_sink: str, ddl_sink: str, reject_sink: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over annotated_stream(): row changes as the change log, DDL and what is rejected apart. snapshots is
    asked anew in each batch, so that a schema version that came with an earlier one is known. A batch that is run again
    replaces its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = batch.filter(F.col("event_type").isin(INSERT, UPDATE, DELETE))
        good, bad = normalise(rows, snapshots(batch.sparkSession))
        good.write.mode("overwrite").parquet(f"{log_sink}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{reject_sink}/batch={number}")
        ddl_rows(batch.filter(F.col("event_type") == DDL).drop("ddl_type", "rows")).write.mode("overwrite").parquet(f"{ddl_sink}/batch={number}")
        batch.unpersist()

    return write


class Buffer:
    """The newest events of a stream within an age, a number and a size, as files by batch and hour.

    After each batch a small table says how many events and bytes each hour has. It is made from the one before, which stays
    until the next is there, so that a batch that is run again starts from the same. The caps are drawn against it: hours that lie wholly beyond
    them are deleted, and read() trims the one hour that a cap cuts, so that what it gives is what newest() gives of all that
    came. Age counts from the newest event so far."""

    def __init__(self, root: str, max_age: str | None = None, max_events: int | None = None, max_bytes: int | None = None, size_col: str = "size"):
        self.root, self.max_age, self.max_events, self.max_bytes, self.size_col = root, max_age, max_events, max_bytes, size_col

    def oldest(self, newest_time: Column) -> Column:
        return newest_time - F.expr(f"interval {self.max_age}") if self.max_age else F.lit("0001-01-01").cast("timestamp")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter("event_timestamp IS NOT NULL").withColumn("hour", F.expr("unix_seconds(cast(event_timestamp as timestamp)) div 3600"))
        rows.write.mode("overwrite").partitionBy("hour").parquet(f"{self.root}/rows/batch={number}")
        written = spark.read.schema(rows.schema).parquet(f"{self.root}/rows/batch={number}")
        own = written.groupBy("hour").agg(F.count("*").alias("events"), F.sum(F.coalesce(self.size_col, F.lit(0))).cast("long").alias("bytes"), F.max("event_timestamp").alias("newest")).withColumn("batches", F.array(F.lit(number)))
        before = f"{self.root}/hours/batch={number - 1}"
        if number > 0 and exists(spark, f"{before}/_SUCCESS"):
            own = own.unionByName(spark.read.parquet(before).filter("NOT gone").drop("gone"))
        hours = own.groupBy("hour").agg(F.sum("events").alias("events"), F.sum("bytes").alias("bytes"), F.max("newest").alias("newest"), F.array_distinct(F.flatten(F.collect_list("batches"))).alias("batches"))
        newer = W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, -1)  # a row for each hour of the buffer
        latest = W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        gone = F.col("newest") < self.oldest(F.max("newest").over(latest))
        for name, cap in (("events", self.max_events), ("bytes", self.max_bytes)):
            if cap is not None:
                gone |= F.coalesce(F.sum(name).over(newer), F.lit(0)) > cap
        hours.withColumn("gone", gone).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/hours/batch={number}")
        state = spark.read.parquet(f"{self.root}/hours/batch={number}")
        for r in state.filter("gone").toLocalIterator():
            for b in r.batches:
                remove(spark, f"{self.root}/rows/batch={b}/hour={r.hour}")
        remove(spark, f"{self.root}/hours/batch={number - 2}")

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """What the buffer holds after the last batch."""
        stored = spark.read.schema(T.StructType([*schema.fields, *T.StructType.fromDDL("batch int, hour long").fields])).parquet(f"{self.root}/rows")
        last = stored.agg(F.max("event_timestamp").alias("last"))
        kept = stored.join(F.broadcast(last)).filter(F.col("event_timestamp") >= self.oldest(F.col("last"))).select(schema.names)
        return newest(kept, self.max_events, self.max_bytes, self.size_col)
