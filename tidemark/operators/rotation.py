"""Rotation as a transaction: old hours of a live log move to the archive, and nothing is lost or doubled wherever it stops.

Live log and archive both lie by server, day and hour. A run goes through these phases, each of which leaves what the next
run can go on from:

1. archived: the expired hours of the live log, together with what the archive has of them already (hours whose events came
   late), are written to a folder of the run; of events with one id one stays.
2. counted: each hour there has as many ids as live log and archive have. The hours are noted in a manifest.
3. listed: the noted hours take their places in the archive by a rename, and the ledger gets a new version with them.
4. dropped: the files of the live log that phase 1 read are deleted, unless their hour waits for an upload. Files that came
   meanwhile stay for the next run.

A run that finds a manifest finishes phase 3 first. Before phase 4 the live log has every event, after phase 3 the archive
has them too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import partition_name
from tidemark.operators.retention import droppable, expired_hours, ledger_upsert
from tidemark.session import checkpointed, remove
from tidemark.sources import archive
from tidemark.sources.baseline import exists

LEDGER = "partition_name string, server_id string, local_path string, row_count long, s3_bucket string, s3_uploaded_at timestamp"
HOURS = "hour timestamp, row_count long"


class Rotation:
    """Rotates a server's live log. With a bucket an hour has to be uploaded before it may be dropped: the bucket stands in the
    ledger, whoever uploads the hour says so with uploaded(), and the next run drops it."""

    def __init__(self, spark: SparkSession, live: str, root: str, server_id: str, bucket: str | None = None):
        self.spark, self.live, self.root, self.server_id, self.bucket = spark, live, root, server_id, bucket
        self.data, self.work = f"{root}/data", f"{root}/work"

    def _folder(self, hour) -> str:
        return f"server_id={self.server_id}/event_date={hour:%Y-%m-%d}/event_hour={hour.hour}"

    def _move(self, source: str, target: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at, to = hadoop.Path(source), hadoop.Path(target)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"can't rename {source} to {target}")

    def ledger(self) -> DataFrame:
        """The newest whole version."""
        n = self._version()
        return self.spark.createDataFrame([], LEDGER) if n < 0 else self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/{n}")

    def _version(self) -> int:
        n = -1
        while exists(self.spark, f"{self.root}/ledger/{n + 1}/_SUCCESS"):
            n += 1
        return n

    def _list(self, updates: DataFrame, anew: bool = False) -> None:
        """A new version of the ledger; anew: what it had of these hours, such as an upload of before, goes."""
        before = self.ledger().join(updates.select("partition_name", "server_id"), ["partition_name", "server_id"], "left_anti") if anew else self.ledger()
        after = checkpointed(ledger_upsert(before.select(T.StructType.fromDDL(LEDGER).names), updates))
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/{self._version() + 1}")

    def uploaded(self, hours: list, at) -> None:
        rows = self.spark.createDataFrame([(h,) for h in hours], "hour timestamp")
        self._list(rows.select(partition_name("hour").alias("partition_name"), F.lit(self.server_id).alias("server_id"), F.lit(at).cast("timestamp").alias("s3_uploaded_at")))

    def archived(self) -> DataFrame:
        return archive.read_archive(self.spark, self.data).filter(F.col("server_id") == self.server_id) if exists(self.spark, self.data) else self.spark.createDataFrame([], archive.CHANGELOG)

    def _publish(self) -> None:
        """Phase 3 for what a manifest notes: each hour that still lies in its folder takes its place."""
        if not exists(self.spark, f"{self.work}/manifest/_SUCCESS"):
            remove(self.spark, self.work)
            return
        noted = self.spark.read.schema(HOURS).parquet(f"{self.work}/manifest")
        for r in noted.toLocalIterator():
            folder = self._folder(r.hour)
            if exists(self.spark, f"{self.work}/data/{folder}"):
                remove(self.spark, f"{self.data}/{folder}")
                self._move(f"{self.work}/data/{folder}", f"{self.data}/{folder}")
        path = F.concat(F.lit(f"{self.data}/server_id={self.server_id}/event_date="), F.date_format("hour", "yyyy-MM-dd"), F.lit("/event_hour="), F.hour("hour").cast("string"))
        self._list(noted.select(partition_name("hour").alias("partition_name"), F.lit(self.server_id).alias("server_id"), path.alias("local_path"), "row_count", F.lit(self.bucket).cast("string").alias("s3_bucket")), anew=True)
        remove(self.spark, self.work)

    def run(self, now, retain: str, reached: Callable[[str], None] = lambda phase: None) -> list:
        """Rotates what lies before now - retain; the hours that were dropped. reached is told each phase that is done."""
        self._publish()
        if not exists(self.spark, self.live):
            return []
        hour = F.date_trunc("hour", "event_timestamp")
        stored = self._stored()
        files = checkpointed(stored.groupBy(hour.alias("hour"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows")))
        expired = checkpointed(expired_hours(files.select("hour").distinct(), now, retain))
        if not expired.isEmpty():
            small = F.broadcast(expired)  # 8 bytes for each hour
            # The files of the plan only, so that what is dropped is what was archived.
            planned = [r.file for r in files.join(small, "hour").select("file").distinct().toLocalIterator()]
            own = self.spark.read.schema(stored.schema).option("basePath", self.live).parquet(*planned)
            both = own.select(*archive.columns(own)).unionByName(self.archived().select(*archive.columns(self.archived())))
            both = both.withColumn("hour", hour).join(small, "hour", "left_semi").drop("hour")
            archive.write_archive(both, f"{self.work}/data", self.server_id, once=True)
            reached("archived")
            whole = archive.read_archive(self.spark, f"{self.work}/data").groupBy(hour.alias("hour")).agg(F.count("*").alias("row_count"))
            want = own.select("event_id", "event_timestamp").unionByName(self.archived().select("event_id", "event_timestamp")).withColumn("hour", hour).join(small, "hour", "left_semi").groupBy("hour").agg(F.countDistinct("event_id").alias("wanted"))
            whole.join(want, "hour").filter("row_count = wanted").select("hour", "row_count").coalesce(1).write.mode("overwrite").parquet(f"{self.work}/manifest")
            reached("counted")
            self._publish()
            reached("listed")
            gone = self._drop(files.join(small, "hour", "left_semi"))
            reached("dropped")
            return gone
        return []

    def _drop(self, files: DataFrame) -> list:
        """Deletes the files (hour, file) of hours that may go."""
        may = droppable(files.select("hour").distinct(), self.ledger().filter(F.col("server_id") == self.server_id))
        files = checkpointed(files.join(F.broadcast(may), "hour", "left_semi").select("hour", "file").distinct())
        for r in files.toLocalIterator():
            remove(self.spark, r.file)
        return sorted(r.hour for r in files.select("hour").distinct().toLocalIterator())

    def drop(self, now, retain: str) -> list:
        """Phase 4 alone, for hours that waited for their upload: deletes the files of expired hours all of whose events the
        archive has."""
        stored, hour = self._stored(), F.date_trunc("hour", "event_timestamp")
        there = self.archived().select("event_id")
        missing = stored.join(there, "event_id", "left_anti").select(hour.alias("hour")).distinct()
        files = stored.groupBy(hour.alias("hour"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
        whole = expired_hours(files, now, retain).join(missing, "hour", "left_anti")
        return self._drop(checkpointed(whole.select("hour", "file")))

    def _stored(self) -> DataFrame:
        schema = archive.read_archive(self.spark, self.live).schema
        return self.spark.read.schema(schema).option("basePath", self.live).parquet(self.live).filter(F.col("server_id") == self.server_id)
