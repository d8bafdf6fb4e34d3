"""Continuous ingest: the batch operators on micro-batches, with Spark's checkpoints as the only progress."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from datetime import datetime
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.operators.normalise import ddl_rows, split_metadata, split_payload
from tidemark.schema import CHANGELOG, DDL, DELETE, INSERT, UPDATE


def read_feed(spark: SparkSession, path: str, schema=CHANGELOG, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start_after(feed: DataFrame, binlog_file: str, pos: int) -> DataFrame:
    """Where a fresh checkpoint begins; a resumed one knows better by itself and skips nothing that follows."""
    return feed.filter((F.col("binlog_file") > binlog_file) | ((F.col("binlog_file") == binlog_file) & (F.col("end_pos") > pos)))


def replay_dedup(feed: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Drops events that come again within the watermark. Rows of one event share positions: keys need an ordinal or id."""
    return feed.withWatermark("event_timestamp", late).dropDuplicatesWithinWatermark(keys)


def ingest(feed: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends to Parquet exactly once; by default all that is there now."""
    writer = feed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def route(log_sink: str, ddl_sink: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: control records apart. Transaction records only move the position, DDL goes to its own table. A
    batch that is run again replaces its own folder, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter(F.col("event_type").isin(INSERT, UPDATE, DELETE)).write.mode("overwrite").parquet(f"{log_sink}/batch={number}")
        ddl = batch.filter(F.col("event_type") == DDL)
        (ddl_rows(ddl) if "query" in batch.columns else ddl).write.mode("overwrite").parquet(f"{ddl_sink}/batch={number}")
        batch.unpersist()

    return write


def split_sinks(server_id: str, metadata_sink: str, payload_sink: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: metadata without values, and full rows by table and day. A batch that is run again replaces its
    own folder, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col("event_type").isin(INSERT, UPDATE, DELETE)).persist()
        split_metadata(rows, server_id).write.mode("overwrite").parquet(f"{metadata_sink}/batch={number}")
        split_payload(rows, server_id).write.mode("overwrite").partitionBy("server_id", "schema_table", "date").parquet(f"{payload_sink}/batch={number}")
        rows.unpersist()

    return write


def schema_versions(batch: DataFrame, versions: DataFrame, before: int = 0) -> DataFrame:
    """The schema version of each event by position: that of the last DDL before it in its file, TRUNCATE excepted, else
    `before`, the version that held when the batch began. versions: (binlog_file, end_pos, snapshot_id, ddl_type)."""
    marks = versions.filter("ddl_type <> 'TRUNCATE TABLE'").select("binlog_file", "end_pos", "snapshot_id")
    both = batch.drop("schema_version").withColumn("snapshot_id", F.lit(None).cast("int")).withColumn("_event", F.lit(True)).unionByName(marks.withColumn("_event", F.lit(False)), allowMissingColumns=True)
    w = W.partitionBy("binlog_file").orderBy("end_pos", "_event").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("schema_version", F.coalesce(F.last("snapshot_id", ignorenulls=True).over(w), F.lit(before)))
    return out.filter("_event").drop("_event", "snapshot_id")


def identity_changes(feed: DataFrame) -> DataFrame:
    """Events at which a server's uuid is another than before: the source was replaced."""
    w = W.partitionBy("server_id").orderBy("event_timestamp", "event_id")
    return feed.withColumn("previous_uuid", F.lag("server_uuid").over(w)).filter(F.col("server_uuid") != F.col("previous_uuid"))


def pending_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are not completed; failed ones come again."""
    return files.join(ledger.filter("status = 'completed'").select("binlog_file").distinct(), "binlog_file", "left_anti")


def batch_sizes(progress: DataFrame) -> DataFrame:
    """(size_class, batches): batches by the power of two of their rows."""
    return progress.filter("rows > 0").groupBy(F.floor(F.log2("rows")).cast("int").alias("size_class")).agg(F.count("*").alias("batches"))


def observed(feed: DataFrame) -> DataFrame:
    """The feed with what Progress reports of each batch."""
    return feed.observe("ingest", F.count("*").alias("received"), F.count_if(F.col("event_type").isin(INSERT, UPDATE, DELETE)).alias("indexed"), F.max("event_timestamp").alias("last_event"))


PROGRESS = "query string, batch long, rows long, rows_a_second double, state_rows long, received long, indexed long, last_event timestamp, lag_seconds double, error string"


class Progress(StreamingQueryListener):
    """Keeps a row for each batch, PROGRESS: rows, speed, state, what observed() counts, the time of the last event and how far
    it lies behind. Errors have a row too. Only the last of them are kept here; with a path they go to a table, many batches
    at a time, the rest when a query ends or at flush()."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None, kept: int = 1000, at_once: int = 50):
        self.spark, self.path, self.at_once = spark, path, at_once
        self.waiting: list[tuple] = []
        self.lock = RLock()  # listeners run on a thread of their own
        self.rows: deque[tuple] = deque(maxlen=kept)
        self.errors: deque[str] = deque(maxlen=kept)

    def add(self, row: tuple) -> None:
        with self.lock:
            self.rows.append(row)
            if self.path is not None:
                self.waiting.append(row)
                if len(self.waiting) >= self.at_once:
                    self.flush()

    def flush(self) -> None:
        with self.lock:
            if self.waiting:
                self.spark.createDataFrame(self.waiting, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)
                self.waiting = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = p.observedMetrics.get("ingest")
        received, indexed, last = (seen["received"], seen["indexed"], seen["last_event"]) if seen is not None else (None, None, None)
        lag = (datetime.now() - last).total_seconds() if last is not None else None
        self.add((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond, sum(s.numRowsTotal for s in p.stateOperators), received, indexed, last, lag, None))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.errors.append(event.exception)
            self.add((str(event.id), None, None, None, None, None, None, None, None, event.exception.split("\n")[0]))
        self.flush()
