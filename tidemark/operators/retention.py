"""What is old enough to go, what may go, and what a bounded buffer keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import partition_name, partition_time
from tidemark.sources import archive


def expired_hours(hours: DataFrame, now, retain: str) -> DataFrame:
    """Hours whose start lies before now - retain (an interval such as '7 days')."""
    return hours.filter(F.col("hour") < F.expr(f"timestamp'{now}' - interval {retain}"))


def rotate(log: DataFrame, ledger: DataFrame, root: str, server_id: str, now, retain: str) -> tuple[DataFrame, DataFrame]:
    """(hours that may be dropped, the ledger after it): archives the expired hours of a log that the ledger doesn't list,
    counts them again in the archive, lists those that are whole, and lets no hour go that waits for an upload. Run again
    after a failure, it goes on where it stopped: hours are replaced as a whole. ledger: (partition_name, server_id,
    local_path, row_count, s3_bucket, s3_uploaded_at)."""
    spark = log.sparkSession
    hour = F.date_trunc("hour", "event_timestamp")
    counts = log.groupBy(hour.alias("hour")).agg(F.count("*").alias("row_count"))
    expired = expired_hours(counts, now, retain)
    known = ledger.filter(F.col("server_id") == server_id).select(partition_time("partition_name").alias("hour"))
    missing = expired.join(known, "hour", "left_anti").checkpoint()  # a row for each hour
    if not missing.isEmpty():
        archive.write_archive(log.withColumn("hour", hour).join(F.broadcast(missing.select("hour")), "hour", "left_semi").drop("hour"), root, server_id)
        there = archive.read_archive(spark, root).filter(F.col("server_id") == server_id).groupBy(hour.alias("hour")).agg(F.count("*").alias("archived"))
        whole = missing.join(there, "hour").filter("archived = row_count")
        path = F.concat(F.lit(f"{root}/server_id={server_id}/event_date="), F.date_format("hour", "yyyy-MM-dd"), F.lit("/event_hour="), F.hour("hour").cast("string"))
        ledger = ledger_upsert(ledger, whole.select(partition_name("hour").alias("partition_name"), F.lit(server_id).alias("server_id"), path.alias("local_path"), "row_count"))
    return droppable(expired.select("hour"), ledger.filter(F.col("server_id") == server_id)), ledger


def droppable(expired: DataFrame, ledger: DataFrame) -> DataFrame:
    """Expired hours that are archived and wait for no upload. ledger: (partition_name, s3_bucket, s3_uploaded_at)."""
    own = ledger.withColumn("hour", partition_time("partition_name"))
    pending = own.filter("s3_bucket IS NOT NULL AND s3_uploaded_at IS NULL")
    return expired.join(own.select("hour").distinct(), "hour", "left_semi").join(pending.select("hour").distinct(), "hour", "left_anti")


def ledger_upsert(ledger: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("partition_name", "server_id")) -> DataFrame:
    """The ledger with updates: a null in an update keeps what was there."""
    values = [c for c in ledger.columns if c not in keys]
    both = ledger.withColumn("_n", F.lit(0)).unionByName(updates.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in values]
    return both.groupBy(*keys).agg(*latest).select(ledger.columns)


def beyond_known(log: DataFrame, hours: DataFrame) -> DataFrame:
    """Events in hours that are not listed."""
    return log.withColumn("hour", F.date_trunc("hour", "event_timestamp")).join(hours.select("hour").distinct(), "hour", "left_anti")


def newest(log: DataFrame, max_events: int | None = None, max_bytes: int | None = None, size_col: str = "size") -> DataFrame:
    """The newest events within both caps; those without a time go, and a null size counts as 0. Totals by second show the
    one second that a cap cuts: newer events stay whole, by a filter that reaches the scan, and only the rows of that
    second are ranked."""
    log = log.filter("event_timestamp IS NOT NULL")
    size, second = F.coalesce(F.col(size_col), F.lit(0)), F.unix_seconds(F.col("event_timestamp").cast("timestamp"))
    totals = log.groupBy(second.alias("second")).agg(F.count("*").alias("events"), F.sum(size).alias("bytes")).withColumn("hour", F.expr("second div 3600"))
    newer = W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, -1)  # over hours only
    hours = totals.groupBy("hour").agg(F.sum("events").alias("e"), F.sum("bytes").alias("b"))
    hours = hours.select("hour", F.sum("e").over(newer).alias("hour_events"), F.sum("b").over(newer).alias("hour_bytes"))
    within = W.partitionBy("hour").orderBy(F.desc("second")).rowsBetween(W.unboundedPreceding, -1)
    before = {f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(f"hour_{c}", F.lit(0)) for c in ("events", "bytes")}
    caps = [(c, cap) for c, cap in (("events", max_events), ("bytes", max_bytes)) if cap is not None]
    over = [F.col(c) + F.col(f"before_{c}") > cap for c, cap in caps]
    if not over:
        return log
    cut = totals.join(hours, "hour").withColumns(before).filter(over[0] | over[-1]).orderBy(F.desc("second")).first()
    if cut is None:
        return log
    start, end = (F.timestamp_seconds(F.lit(cut.second + i)) for i in (0, 1))
    w = W.partitionBy(F.date_trunc("second", "event_timestamp")).orderBy(F.desc("event_timestamp"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, 0)
    edge = log.filter((F.col("event_timestamp") >= start) & (F.col("event_timestamp") < end))
    edge = edge.withColumns({"_events": F.count("*").over(w) + cut.before_events, "_bytes": F.sum(size).over(w) + cut.before_bytes})
    for c, cap in caps:
        edge = edge.filter(F.col(f"_{c}") <= cap)
    return log.filter(F.col("event_timestamp") >= end).unionByName(edge.select(log.columns))


def write_recent(log: DataFrame, path: str, now, max_age: str, max_events: int | None = None, max_bytes: int | None = None, size_col: str = "size", codec: str = "zstd") -> None:
    """The events that a bounded buffer keeps, in the columns of an archive, in place of what was there."""
    kept = newest(recent(log, now, max_age), max_events, max_bytes, size_col)
    kept.select(archive.columns(kept)).write.mode("overwrite").option("compression", codec).parquet(path)


def recent(log: DataFrame, now, max_age: str) -> DataFrame:
    return log.filter(F.col("event_timestamp") >= F.expr(f"timestamp'{now}' - interval {max_age}"))
