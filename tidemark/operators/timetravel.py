"""The state of rows and tables at a moment, and how it came about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schema import DELETE, INSERT, SNAPSHOT, UPDATE

ACTIONS = ("passthrough", "updated", "inserted", "deleted", "invalid", "none")


def between(log: DataFrame, since, until) -> DataFrame:
    """Row changes in [since, until]; since None for no lower bound."""
    out = log.filter(F.col("event_type").isin(INSERT, UPDATE, DELETE) & (F.col("event_timestamp") <= F.lit(until).cast("timestamp")))
    return out if since is None else out.filter(F.col("event_timestamp") >= F.lit(since).cast("timestamp"))


def split_pk_moves(log: DataFrame, new_pk: Column) -> DataFrame:
    """Updates that change the key as a DELETE of the old and an INSERT of the new one. new_pk: key of the after image."""
    moved = (F.col("event_type") == UPDATE) & new_pk.isNotNull() & (new_pk != F.col("pk_values"))
    marked = log.withColumn("_new", F.when(moved, new_pk))
    part = F.explode(F.when(F.col("_new").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2))))
    out = marked.withColumn("_part", part)
    return out.withColumns({"event_type": F.when(F.col("_part") == 0, DELETE).when(F.col("_part") == 1, INSERT).otherwise(F.col("event_type")), "pk_values": F.when(F.col("_part") == 1, F.col("_new")).otherwise(F.col("pk_values")), "row_after": F.when(F.col("_part") != 0, F.col("row_after")), "row_before": F.when(F.col("_part") != 1, F.col("row_before"))}).drop("_new", "_part")


def of_table(log: DataFrame, schema: str, table: str) -> DataFrame:
    return log.filter((F.col("schema_name") == schema) & (F.col("table_name") == table))


def latest_change(log: DataFrame) -> DataFrame:
    """(pk_values, event_type, row_after, events) of the last change of each key; partial maxima before the shuffle. The log
    is that of one table; of_table() takes it out of a log of several. A key that several tables have raises."""
    last = F.max_by(F.struct("event_type", "row_after"), F.struct("event_timestamp", "event_id")).alias("last")
    table = F.xxhash64(*[c for c in ("schema_name", "table_name") if c in log.columns] or [F.lit(0)])
    own = log.groupBy("pk_values").agg(last, F.count("*").alias("events"), F.min(table).alias("_least"), F.max(table).alias("_most"))
    kind = F.when(F.col("_least") == F.col("_most"), F.col("last.event_type")).otherwise(F.raise_error(F.concat(F.lit("several tables have the key "), "pk_values")).cast("int"))
    return own.select("pk_values", kind.alias("event_type"), "last.row_after", "events")


def merged(baseline: DataFrame, log: DataFrame, at, since=None) -> DataFrame:
    """Full outer join of a snapshot (pk_values, row_image) with the last change of each key: (pk_values, row_image,
    action, events). A change to other than DELETE without an after image drops the row and is `invalid`."""
    changes = latest_change(between(log, since, at)).withColumnRenamed("pk_values", "changed_pk")
    joined = baseline.select("pk_values", "row_image").join(changes, F.col("pk_values") == F.col("changed_pk"), "full_outer")
    is_new, kind = F.col("pk_values").isNull(), F.col("event_type")
    action = F.when(kind.isNull(), "passthrough").when((kind == DELETE) & is_new, "none").when(kind == DELETE, "deleted").when(F.col("row_after").isNull(), "invalid").when(is_new, "inserted").otherwise("updated")
    row = F.when(action == "passthrough", F.col("row_image")).when(action.isin("inserted", "updated"), F.col("row_after"))
    return joined.select(F.coalesce("pk_values", "changed_pk").alias("pk_values"), row.alias("row_image"), action.alias("action"), F.coalesce("events", F.lit(0)).alias("events"))


def state_at(baseline: DataFrame, log: DataFrame, at, since=None) -> DataFrame:
    """(pk_values, row_image, action) of the whole table at a moment."""
    return merged(baseline, log, at, since).filter(F.col("action").isin("passthrough", "updated", "inserted")).select("pk_values", "row_image", "action")


def report(baseline: DataFrame, log: DataFrame, at, since=None) -> DataFrame:
    """One row of counts by action, and the events that were applied."""
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS[:5]]
    return merged(baseline, log, at, since).agg(*counts, F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def typed_rows(state: DataFrame, schema: str) -> DataFrame:
    """Row images as columns of a snapshot's schema: a missing column is null, a surplus one goes."""
    return state.select("pk_values", F.from_json("row_image", schema).alias("_row")).select("pk_values", "_row.*")


def row_state_at(baseline: DataFrame, log: DataFrame, keys: list[str], at, strict: bool = False) -> DataFrame:
    """state_at for some keys. strict raises if one is not in the snapshot."""
    own = baseline.filter(F.col("pk_values").isin(keys))
    if strict and (missing := set(keys) - {r.pk_values for r in own.select("pk_values").distinct().collect()}):
        raise KeyError(f"not in the snapshot: {sorted(missing)}")
    return state_at(own, log.filter(F.col("pk_values").isin(keys)), at)


def history(baseline: DataFrame, log: DataFrame, snapshot_time, at) -> DataFrame:
    """(pk_values, event_timestamp, event_id, source, state): the snapshot's entry and one for each change up to a
    moment; a DELETE leaves no state."""
    first = baseline.select("pk_values", F.lit(snapshot_time).cast("timestamp").alias("event_timestamp"), F.lit(0).cast("long").alias("event_id"), F.lit("baseline").alias("source"), F.col("row_image").alias("state"))
    state = F.when(F.col("event_type") != DELETE, F.col("row_after"))
    return first.unionByName(between(log, None, at).select("pk_values", "event_timestamp", "event_id", F.lit("log").alias("source"), state.alias("state")))


def snapshot_events(baseline: DataFrame, schema: str, table: str, snapshot_time) -> DataFrame:
    """Rows of a snapshot as events of kind SNAPSHOT, so that a search can show them; ids start at 2^62 and follow the
    key's hash, so they don't depend on how the snapshot is laid out."""
    ident = F.lit(1 << 62).bitwiseOR(F.xxhash64("pk_values").bitwiseAND(F.lit((1 << 62) - 1)))
    return baseline.select(ident.alias("event_id"), F.lit(snapshot_time).cast("timestamp").alias("event_timestamp"), F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), F.lit(SNAPSHOT).alias("event_type"), "pk_values", F.lit(None).cast("string").alias("row_before"), F.col("row_image").alias("row_after"))


def pick_baseline(inventory: DataFrame, requests: DataFrame) -> DataFrame:
    """The newest snapshot at or before each request's moment: (schema_name, table_name, at, snapshot_time, path); of two of
    one moment that with the greatest path.

    Snapshots and requests stand in one order of time by table and month, where the last snapshot so far holds; what a month
    takes over from those before comes from the last snapshots of months. So no request meets more than one row, and a table
    with many of either is spread over its months."""
    keys = ["schema_name", "table_name"]
    snapshot = F.struct(F.col("snapshot_time").cast("timestamp").alias("snapshot_time"), "path")
    month = lambda c: F.date_trunc("month", c)
    have = inventory.filter("snapshot_time IS NOT NULL").select(*keys, snapshot.alias("best")).withColumn("time", F.col("best.snapshot_time"))
    asked = requests.select(*keys, F.col("at").cast("timestamp").alias("time"), "at")
    months = have.groupBy(*keys, month("time").alias("month")).agg(F.max("best").alias("last"))
    months = months.unionByName(asked.select(*keys, month("time").alias("month")).distinct(), allowMissingColumns=True).groupBy(*keys, "month").agg(F.max("last").alias("last"))
    before = W.partitionBy(*keys).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    months = months.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select(*keys, "month", "carried")
    both = have.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True).withColumn("month", month("time"))
    order = W.partitionBy(*keys, "month").orderBy("time", F.col("asked").isNotNull(), "best").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("own", F.last("best", ignorenulls=True).over(order)).filter("asked").join(months, [*keys, "month"], "left")
    best = F.coalesce("own", "carried")
    return found.select(*keys, "at", best["snapshot_time"].alias("snapshot_time"), best["path"].alias("path"))


def continuity(log: DataFrame, baseline_file: str, baseline_pos: int) -> DataFrame:
    """The log's first event against a snapshot's place in the log: continuous if it doesn't start beyond it."""
    first = log.agg(F.min(F.struct("event_timestamp", "event_id", "binlog_file", "start_pos")).alias("first")).select("first.*")
    ok = (F.col("binlog_file") < baseline_file) | ((F.col("binlog_file") == baseline_file) & (F.col("start_pos") <= baseline_pos))
    return first.select("event_id", "binlog_file", "start_pos", F.coalesce(ok, F.lit(True)).alias("continuous"))


def states_of(log: DataFrame, at, since=None) -> DataFrame:
    """(schema_name, table_name, pk_values, row_image) of all tables of a log at a moment, none with a snapshot."""
    names = ["schema_name", "table_name", "pk_values"]
    last = F.max_by(F.struct("event_type", "row_after"), F.struct("event_timestamp", "event_id")).alias("last")
    out = between(log, since, at).groupBy(*names).agg(last).filter((F.col("last.event_type") != DELETE) & F.col("last.row_after").isNotNull())
    return out.select(*names, F.col("last.row_after").alias("row_image"))


def history_json(entries: DataFrame) -> DataFrame:
    """(pk_values, event_timestamp, event_id, text): a JSON object for each entry of a history, the state as such or null."""
    time = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = F.to_json(F.struct(time.alias("time"), "source", F.when(F.col("event_id") != 0, F.col("event_id")).alias("event_id"), F.col("gtid") if "gtid" in entries.columns else F.lit(None).cast("string").alias("gtid")))
    text = F.concat(own.substr(F.lit(1), F.length(own) - 1), F.lit(',"state":'), F.coalesce("state", F.lit("null")), F.lit("}"))
    return entries.select("pk_values", "event_timestamp", "event_id", text.alias("text"))


def history_table(entries: DataFrame, columns: list[str] | None = None, most: int = 4096) -> DataFrame:
    """A history for CSV: pk_values, time, source, event_id, gtid and a column for each of a table's columns, in their order;
    empty where a state lacks it or the row is deleted. Without columns they are the keys that any state has; more of them
    than a table can have columns (`most`) raise, as such states aren't those of a table."""
    if columns is None:
        found = entries.select(F.explode(F.json_object_keys("state")).alias("k")).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"states have more than {most} keys")
        columns = sorted(r.k for r in found)
    values = F.from_json("state", "map<string,string>")
    own = entries.withColumn("_values", values)
    gtid = F.coalesce("gtid", F.lit("")) if "gtid" in entries.columns else F.lit("")
    time = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return own.select("pk_values", time.alias("time"), "source", "event_id", gtid.alias("gtid"), *[F.coalesce(F.try_element_at("_values", F.lit(k)), F.lit("")).alias(f"state_{k}" if k in ("pk_values", "time", "source", "event_id", "gtid") else k) for k in columns])


def state_pairs(state: DataFrame) -> DataFrame:
    """(pk_values, column_name, value) of row images, one row for each column; a deleted row has one that says so."""
    pairs = F.map_entries(F.from_json("row_image", "map<string,string>"))
    gone = F.array(F.struct(F.lit("(deleted)").alias("key"), F.lit(None).cast("string").alias("value")))
    return state.select("pk_values", F.explode(F.coalesce(pairs, gone)).alias("e")).select("pk_values", F.col("e.key").alias("column_name"), F.col("e.value").alias("value"))


def inserted_last(state: DataFrame) -> DataFrame:
    """A state in the order of a dump: rows of the snapshot first, then new ones, both by key. Sorted by range, over many
    tasks: without the key all rows of the snapshot would be one task's."""
    return state.orderBy(F.col("action") == "inserted", "pk_values")


def states_at(tables: dict[str, tuple[DataFrame | None, DataFrame]], at) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """state_at of many tables as lazy plans, and what failed by table. A table without snapshot starts empty."""
    done, failed = {}, {}
    for name, (baseline, log) in tables.items():
        try:
            start = baseline if baseline is not None else log.select("pk_values", F.lit("").alias("row_image")).limit(0)
            done[name] = state_at(start, log, at)
        except Exception as e:  # the others go on
            failed[name] = str(e)
    return done, failed
