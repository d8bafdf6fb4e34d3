"""Materialised states of a table, so that a moment is a step from the nearest one below it.

A ladder is a snapshot and rungs: the last change of each key within a stretch of time. New rungs are short; two of one level
that follow each other become one of the next level, as in a log-structured merge tree, so n climbs leave about log n
rungs and a change is rewritten about log n times. The state at a moment is the snapshot, the rungs that end at or before the
moment, and the log since the last of them; only that part of the log is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.timetravel import between, merged
from tidemark.sources.baseline import exists

CHANGES = "pk_values string, event_timestamp timestamp, event_id long, event_type int, row_after string"
INDEX = "start timestamp, until timestamp, level int, path string, parents array<string>"


class Ladder:
    """A ladder in a folder. Its index is written anew with each climb, under the next number; the highest that is whole
    counts, so a climb that fails leaves the ladder as it was. The rungs that were merged stay for readers of before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def start(self, baseline: DataFrame, moment) -> None:
        """Begins with a snapshot (pk_values, row_image) of a moment."""
        baseline.select("pk_values", "row_image").write.mode("overwrite").parquet(f"{self.root}/base")
        first = self.spark.createDataFrame([(None, None, -1, "base", [])], INDEX).withColumn("until", F.lit(moment).cast("timestamp"))
        self._write(first, 0)

    def version(self) -> int:
        n = -1
        while exists(self.spark, f"{self.root}/index/{n + 1}/_SUCCESS"):
            n += 1
        if n < 0:
            raise ValueError(f"{self.root} has no ladder")
        return n

    def _write(self, index: DataFrame, number: int) -> None:
        index.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/index/{number}")

    def rungs(self) -> list:
        """(start, until, level, path, parents) in order of time, the snapshot first; about log n of them."""
        return sorted(self.spark.read.schema(INDEX).parquet(f"{self.root}/index/{self.version()}").collect(), key=lambda r: r.until)

    def _since(self, log: DataFrame, rung) -> DataFrame:
        """What a rung doesn't have. Times count seconds, so that changes of a snapshot's own second may have come after it."""
        time = F.col("event_timestamp")
        return log.filter(time >= F.lit(rung.until) if rung.level < 0 else time > F.lit(rung.until))

    def _last(self, changes: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("event_timestamp", "event_id", "event_type", "row_after"), F.struct("event_timestamp", "event_id")).alias("last")
        return changes.groupBy("pk_values").agg(last).select("pk_values", "last.*")

    def _store(self, changes: DataFrame) -> str:
        path = f"rungs/{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.root}/{path}")
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.root}/{p}" for p in paths])

    def climb(self, log: DataFrame, at) -> None:
        """A rung from the last one to a moment, and merges of those that it completes. The log is that of the ladder's table,
        and complete up to the moment: what comes later for a time below isn't seen."""
        number, held = self.version(), self.rungs()
        start = held[-1].until
        at = self.spark.range(1).select(F.lit(at).cast("timestamp").alias("at")).first().at
        if at <= start:
            raise ValueError(f"the ladder reaches {start} already")
        new = self._since(between(log, None, at), held[-1])
        held.append((start, at, 0, self._store(self._last(new.select("pk_values", "event_timestamp", "event_id", "event_type", "row_after"))), []))
        while len(held) > 2 and held[-1][2] == held[-2][2]:
            b, a = held.pop(), held.pop()
            held.append((a[0], b[1], a[2] + 1, self._store(self._last(self._read([a[3], b[3]]))), [a[3], b[3]]))
        self._write(self.spark.createDataFrame([tuple(r) for r in held], INDEX), number + 1)

    def state_at(self, log: DataFrame, at) -> DataFrame:
        """(pk_values, row_image, action) as timetravel.state_at has it of the snapshot and the log; rows of the log up to
        the nearest rung aren't read. A moment before the snapshot raises."""
        moment = self.spark.range(1).select(F.lit(at).cast("timestamp").alias("at")).first().at
        below = [r for r in self.rungs() if r.until <= moment]
        if not below:
            raise ValueError(f"the ladder begins after {moment}")
        columns = ["pk_values", "event_timestamp", "event_id", "event_type", "row_after"]
        changes = self._since(between(log, None, at), below[-1]).select(columns)
        if len(below) > 1:
            changes = changes.unionByName(self._read([r.path for r in below[1:]]))
        base = self.spark.read.schema("pk_values string, row_image string").parquet(f"{self.root}/base")
        return merged(base, changes, at).filter(F.col("action").isin("passthrough", "updated", "inserted")).select("pk_values", "row_image", "action")
