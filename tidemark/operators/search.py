"""Search over change logs: predicates, source merging, per-key and global limits."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import changed_columns, event_type_name, json_is_null, json_value, pk_hash, safe_name
from tidemark.schema import CHANGELOG, ORDER, SNAPSHOT
from tidemark.session import checkpointed


@dataclass
class Search:
    """What to look for; unset fields don't restrict. column_eq: (column, value), value None for an explicit null.
    pk_in, tables, flagged and denied are DataFrames or lists and join as semi or anti joins."""

    schema: str | None = None
    table: str | None = None
    pk: str | None = None
    pk_in: list[str] | DataFrame | None = None
    event_type: int | None = None
    gtid: str | None = None
    since: datetime | str | None = None
    until: datetime | str | None = None
    changed_column: str | None = None
    column_eq: list[tuple[str, str | None]] = field(default_factory=list)
    flagged: DataFrame | None = None
    denied: DataFrame | None = None
    pk_hashes: DataFrame | None = None
    limit: int | None = None
    limit_per_pk: int | None = None


def parse_time(text: str) -> datetime:
    """Date, date and time, or RFC 3339."""
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    raise ValueError(f"not a time: {text}")


def predicate(s: Search, columns: list[str]) -> Column:
    """All restrictions that need no join. Bounds are inclusive; where the table has event_date and event_hour, they
    also restrict those, so that partitions are pruned."""
    out = F.lit(True)
    for name, value in (("schema_name", s.schema), ("table_name", s.table), ("pk_values", s.pk), ("event_type", s.event_type), ("gtid", s.gtid)):
        if value is not None:
            out &= F.col(name) == value
    if s.pk is None and isinstance(s.pk_in, list) and s.pk_in:
        out &= F.col("pk_values").isin(s.pk_in)
    for bound, is_since in ((s.since, True), (s.until, False)):
        if bound is not None:
            t = F.lit(parse_time(bound) if isinstance(bound, str) else bound).cast("timestamp")
            out &= F.col("event_timestamp") >= t if is_since else F.col("event_timestamp") <= t
            if {"event_date", "event_hour"} <= set(columns):
                day, hour = F.to_date(t), F.hour(t)
                date, own = F.col("event_date").cast("date"), F.col("event_hour").cast("int")
                out &= (date >= day) & ((date > day) | (own >= hour)) if is_since else (date <= day) & ((date < day) | (own <= hour))
    if s.changed_column is not None:
        changed = F.col("changed_columns") if "changed_columns" in columns else changed_columns("row_before", "row_after")
        out &= F.coalesce(F.array_contains(changed, s.changed_column), F.lit(False))
    for column, value in s.column_eq:
        if not safe_name(column):
            out &= F.lit(False)
        elif value is None:
            out &= json_is_null("row_after", column) | json_is_null("row_before", column)
        else:
            out &= F.coalesce(json_value("row_after", column) == value, F.lit(False)) | F.coalesce(json_value("row_before", column) == value, F.lit(False))
    return out


def matching(log: DataFrame, s: Search) -> DataFrame:
    """The events that match, before any limit."""
    out = log.filter(predicate(s, log.columns))
    if s.pk is None and isinstance(s.pk_in, DataFrame):
        out = out.join(s.pk_in.select(F.col(s.pk_in.columns[0]).alias("pk_values")).distinct(), "pk_values", "left_semi")
    if s.flagged is not None:
        out = out.join(s.flagged.select("schema_name", "table_name").distinct(), ["schema_name", "table_name"], "left_semi")
    if s.denied is not None:
        out = out.join(s.denied.select("schema_name", "table_name").distinct(), ["schema_name", "table_name"], "left_anti")
    if s.pk_hashes is not None:
        wanted = s.pk_hashes.select(F.col(s.pk_hashes.columns[0]).alias("wanted")).distinct()
        out = out.join(wanted, pk_hash("pk_values") == F.col("wanted"), "left_semi")
    return out


def latest_per_key(log: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*(keys or ["pk_values"])).orderBy(*[F.desc(c) for c in ORDER])
    return log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def first_n(log: DataFrame, n: int | None) -> DataFrame:
    """The oldest n in log order; all if None."""
    out = log.orderBy(*ORDER)
    return out if n is None else out.limit(n)


def first_n_of_hours(log: DataFrame, n: int, hours: DataFrame, s: Search | None = None) -> DataFrame:
    """The oldest n that match, read from as few hours as can hold them. hours: (hour timestamp, events), as a ledger or the
    coverage has them, every hour of the log among them. The shortest stretch of hours with n events is tried first; if the
    search leaves fewer of them, it grows by what it takes at the rate seen, at least fourfold. The stretch bounds times, so
that partitions beyond it aren't read. Rows without a time are in no hour and left out."""
    s = s or Search()
    so_far = W.orderBy("hour").rowsBetween(W.unboundedPreceding, 0)  # a row for each hour
    totals = checkpointed(hours.groupBy("hour").agg(F.sum("events").alias("events")).withColumn("total", F.sum("events").over(so_far)))
    bound = parse_time(s.until) if isinstance(s.until, str) else s.until
    need = n
    while True:
        end = totals.filter(F.col("total") >= need).agg(F.min("hour")).first()[0]
        if end is not None:
            until = end + timedelta(hours=1) - timedelta(microseconds=1)
            until = until if bound is None else min(until, bound.replace(tzinfo=None))
        found = matching(log, s if end is None else replace(s, until=until))
        found = found.filter("event_timestamp IS NOT NULL")
        if end is None or (bound is not None and until >= bound.replace(tzinfo=None)):
            return first_n(found, n)
        have = found.limit(n).count()
        if have >= n:
            return first_n(found, n)
        need *= max(4, 2 * n // max(1, have))


def source_presence(sources: list[DataFrame]) -> DataFrame:
    """(hour, sources): for each hour of any source a bitmap of the sources that have it; hours count from 1970, and -1 has
    the rows without a time. Reads one column of each source."""
    if len(sources) > 63:
        raise ValueError("a bitmap holds 63 sources")
    marks = [s.select(hour_number().alias("hour"), F.lit(1 << i).cast("long").alias("bit")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, marks).groupBy("hour").agg(F.bit_or("bit").alias("sources"))


def hour_number() -> Column:
    return F.coalesce(F.expr("unix_seconds(cast(event_timestamp as timestamp)) div 3600"), F.lit(-1))


def merge_sources(sources: list[DataFrame], key: list[str] | None = None, by_hour: bool = True) -> DataFrame:
    """One log of several; of events with one key, that of the earlier source stays. Keys are unique within a source, and an
    event has one time in all. Columns are matched by name, and one that a source lacks is null there. Rows without a key
    all stay.

    All sources are tagged and meet in one exchange. With by_hour the presence of each source by hour is found first, in a
    job of its own over the times alone, and rows of hours that one source has to itself stay where they are; without it, as
    for sources that are cut to a few rows, all rows are exchanged."""
    key = key or ["event_id"]
    if len(sources) == 1:
        return sources[0]
    tagged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    columns = [c for c in tagged.columns if c != "_source"]
    meets = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in key])
    if by_hour and all("event_timestamp" in s.columns for s in sources):
        hours = checkpointed(source_presence(sources).filter(F.bit_count("sources") > 1).select(F.col("hour").alias("_hour"), F.lit(True).alias("_shared")))
        if hours.isEmpty():
            return tagged.select(columns)
        # 9 bytes for each hour of the log
        tagged = tagged.withColumn("_hour", hour_number()).join(F.broadcast(hours), "_hour", "left")
        meets &= F.col("_shared").isNotNull()
    others = [c for c in columns if c not in key]
    first = tagged.filter(meets).groupBy(*key).agg(F.min_by(F.struct(*others), F.col("_source")).alias("_row"))
    first = first.select([F.col(c) if c in key else F.col("_row")[c].alias(c) for c in columns])
    return tagged.filter(~meets).select(columns).unionByName(first)


def merge_and_trim(sources: list[DataFrame], limit: int | None = None, limit_per_pk: int | None = None) -> DataFrame:
    """Merge, then the cap for each key, then the global one. Each source is cut to what can be left of it beforehand."""
    cut = limit is not None or limit_per_pk is not None
    if len(sources) > 1 and limit_per_pk is not None:
        sources = [latest_per_key(x, limit_per_pk) for x in sources]
    elif len(sources) > 1 and limit is not None:
        sources = [first_n(x, limit) for x in sources]
    out = merge_sources(sources, by_hour=not cut)
    if limit_per_pk is not None:
        out = latest_per_key(out, limit_per_pk)
    return first_n(out, limit)


def search(sources: DataFrame | list[DataFrame], s: Search, snapshots: list[DataFrame] | None = None) -> DataFrame:
    """Filtered and cut before the sources meet, so that the filters reach each scan. snapshots: rows of snapshots as events,
    the last sources, which have a say only where snapshot_reason() knows nothing against it; bounds of time hold for the
    time of the snapshot."""
    sources = sources if isinstance(sources, list) else [sources]
    sources = sources + (snapshots or [] if snapshot_reason(s) is None else [])
    return merge_and_trim([matching(x, s) for x in sources], s.limit, s.limit_per_pk)


def snapshot_reason(s: Search) -> str | None:
    """Why rows of a snapshot can't match, or None if they can."""
    for reason, holds in (("event type", s.event_type not in (None, SNAPSHOT)), ("gtid", s.gtid is not None), ("changed column", s.changed_column is not None), ("flag", s.flagged is not None)):
        if holds:
            return reason
    return None


def snapshot_filter(s: Search) -> Column:
    """column_eq over a snapshot's typed columns, by their text; null as IS NULL. Unsafe names raise."""
    out = F.lit(True)
    for column, value in s.column_eq:
        if not safe_name(column):
            raise ValueError(f"unsafe column name {column!r}")
        out &= F.col(column).isNull() if value is None else F.col(column).cast("string") == value
    return out


def grouped_by_pk(log: DataFrame, requested: DataFrame) -> DataFrame:
    """(position, pk_values, events): one row for each requested key, in the order of position; keys without events have
    an empty array. An array holds one key's history."""
    event = F.struct(*ORDER, "event_type", "row_before", "row_after")
    groups = log.groupBy("pk_values").agg(F.sort_array(F.collect_list(event)).alias("events"))
    empty = F.array().cast(groups.schema["events"].dataType)
    return requested.join(groups, "pk_values", "left").select("position", "pk_values", F.coalesce("events", empty).alias("events"))


def result_columns(log: DataFrame) -> DataFrame:
    """The columns of a result listing: names for kinds, text for arrays; for JSON, CSV or the console."""
    names = [c for c in CHANGELOG.names if c in log.columns]
    own = {"event_type": event_type_name("event_type"), "changed_columns": F.to_json("changed_columns"), "event_timestamp": F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss")}
    return log.select([own.get(c, F.col(c)).alias(c) for c in names])
