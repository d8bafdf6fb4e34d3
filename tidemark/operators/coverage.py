"""Which hours are there, where, and how much they hold."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class GapError(Exception):
    """Hours of a requested range are in no source."""


def hour_coverage(live: DataFrame, archived: DataFrame, since, until) -> DataFrame:
    """(hour, status) for each hour that overlaps [since, until): live, archived or gap. live and archived: (hour)."""
    spark = live.sparkSession
    hours = spark.range(1).select(F.explode(F.expr(f"sequence(date_trunc('HOUR', timestamp'{since}'), date_trunc('HOUR', timestamp'{until}' - interval 1 second), interval 1 hour)")).alias("hour"))
    out = hours.join(live.select("hour").distinct().withColumn("_live", F.lit(True)), "hour", "left").join(archived.select("hour").distinct().withColumn("_archived", F.lit(True)), "hour", "left")
    return out.select("hour", F.when(F.col("_live"), "live").when(F.col("_archived"), "archived").otherwise("gap").alias("status"))


def open_range(live: DataFrame, archived: DataFrame, since=None, until=None):
    """Bounds for a search that leaves one open: from the first live hour, else the first archived one, to the hour after
    the last live one. None if both are open or nothing is there."""
    if since is None and until is None:
        return None
    got = live.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).first()
    if since is None:
        since = got.a or archived.agg(F.min("hour")).first()[0]
    if until is None:
        until = live.agg(F.max("hour") + F.expr("interval 1 hour")).first()[0] or live.sparkSession.sql("SELECT date_trunc('HOUR', now()) + interval 1 hour").first()[0]
    return None if since is None else (since, until)


def hour_ranges(coverage: DataFrame, by: str = "status") -> DataFrame:
    """(status, first_hour, last_hour, hours) of consecutive hours with one status."""
    number = (F.unix_timestamp("hour") / 3600).cast("long")
    island = number - F.row_number().over(W.partitionBy(by).orderBy("hour"))
    return coverage.withColumn("_island", island).groupBy(by, "_island").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("hours")).drop("_island")


def gap_summary(coverage: DataFrame) -> DataFrame:
    gaps = coverage.filter("status = 'gap'").agg(F.count("*").alias("hours"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return gaps.withColumn("message", F.when(F.col("hours") > 0, F.concat(F.col("hours").cast("string"), F.lit(" hours are missing between "), at("first_hour"), F.lit(" and "), at("last_hour"))))


def check_gaps(coverage: DataFrame, strict: bool) -> None:
    """Raises GapError if strict and hours are missing; else warns."""
    row = gap_summary(coverage).first()
    if row.hours:
        if strict:
            raise GapError(row.message)
        warnings.warn(row.message, stacklevel=2)


def hour_stats(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "event_timestamp").alias("hour")).agg(F.count("*").alias("events"))


def coverage_summary(log: DataFrame, schema_changes: DataFrame, archives: DataFrame) -> DataFrame:
    """One row: what can be restored. archives: (hour, row_count)."""
    events = log.agg(F.min("event_timestamp").alias("first_event"), F.max("event_timestamp").alias("last_event"), F.count("*").alias("events"))
    ddl = schema_changes.agg(F.count("*").alias("ddl"), F.count_if(F.col("snapshot_id").isNull()).alias("ddl_without_snapshot"))
    archive = archives.agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("archived_rows"), F.min("hour").alias("first_archived_hour"))
    return events.join(F.broadcast(ddl)).join(F.broadcast(archive))  # one row each


def archive_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("files"), F.sum("row_count").cast("long").alias("rows"), F.sum("file_size_bytes").cast("long").alias("bytes"), F.count_if((F.col("local_path").isNotNull()) & (F.col("local_path") != "")).alias("local_files"), F.count_if(F.col("s3_bucket").isNotNull()).alias("remote_files"), F.array_join(F.sort_array(F.collect_set("s3_bucket")), ",").alias("buckets"))


def ingest_summary(ledger: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return ledger.groupBy(F.coalesce("server_id", F.lit("(unknown)")).alias("server_id")).agg(count("completed"), count("in_progress"), count("failed"), F.coalesce(F.sum("events_indexed"), F.lit(0)).cast("long").alias("events"))


def snapshot_stats(snapshots: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    keys = foreign_keys.groupBy("snapshot_id").agg(F.countDistinct("constraint_name").alias("foreign_keys"))
    return snapshots.groupBy("snapshot_id").agg(F.countDistinct("schema_name", "table_name").alias("tables"), F.count("*").alias("columns")).join(keys, "snapshot_id", "left").fillna(0, ["foreign_keys"])


def run_totals(reports: list[DataFrame]) -> DataFrame:
    """The sum of reports of single tables."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.agg(F.count("*").alias("tables"), *[F.sum(c).alias(c) for c in out.columns])


def listing(df: DataFrame, *order: str) -> DataFrame:
    """A status listing; a name with a leading minus sorts descending."""
    return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])
