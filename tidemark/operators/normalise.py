"""From a raw feed of decoded row events to the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import changed_columns, ddl_kind, ddl_table, json_string, pk_encode, pk_hash
from tidemark.schema import DELETE, INSERT, UPDATE


def carry_forward(feed: DataFrame, columns: list[str], file_col: str = "binlog_file", order: str = "pos") -> DataFrame:
    """Each column's last value so far in its file, as transaction and connection ids hold for the events that follow."""
    w = W.partitionBy(file_col).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return feed.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def included(feed: DataFrame, schemas: list[str] | None = None, tables: list[str] | None = None) -> DataFrame:
    """Events of some schemas and of some tables, given as schema.table."""
    if schemas:
        feed = feed.filter(F.col("schema_name").isin(schemas))
    return feed.filter(F.concat_ws(".", "schema_name", "table_name").isin(tables)) if tables else feed


# Source types whose values are numbers in an image; decimals are strings there, as the log has them.
NUMBERS = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "float", "double", "real", "year")


def encoder(data_type: Column) -> Column:
    """How values of a source type go into an image: `number`, `json` or `text`. Without a type they are text."""
    kind = F.lower(data_type)
    return F.when(kind.isin(*NUMBERS), "number").when(kind == "json", "json").otherwise("text")


def columns_of(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, schema_name, table_name, names, encoders, pk) in ordinal order. The encoder follows data_type."""
    kind = encoder(F.col("data_type")) if "data_type" in snapshots.columns else F.lit("text")
    own = F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "column_key", kind.alias("encoder"))))
    return snapshots.groupBy("snapshot_id", "schema_name", "table_name").agg(own.alias("c")).select("snapshot_id", "schema_name", "table_name", F.transform("c", lambda x: x["column_name"]).alias("names"), F.transform("c", lambda x: x["encoder"]).alias("encoders"), F.transform(F.filter("c", lambda x: x["column_key"] == "PRI"), lambda x: x["column_name"]).alias("pk"))


def with_columns(feed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """feed (schema_version, schema_name, table_name, rows array<array<string>>) with the table's columns, and `reject`
    where the table is unknown or a row has another number of columns."""
    known = columns_of(snapshots).withColumnRenamed("snapshot_id", "schema_version")
    out = feed.join(known, ["schema_version", "schema_name", "table_name"], "left")
    return out.withColumn("reject", F.when(F.col("names").isNull(), "unknown_table").when(F.exists("rows", lambda r: F.size(r) != F.size("names")), "column_count_mismatch"))


def exploded(feed: DataFrame) -> DataFrame:
    """One row for each changed row: `before` and `after` arrays and an ordinal; an UPDATE's rows are pairs."""
    kind, rows = F.col("event_type"), F.col("rows")
    none = F.lit(None).cast("array<string>")
    pair = lambda b, a: F.struct(b.alias("before"), a.alias("after"))
    pairs = F.when(kind == UPDATE, F.transform(F.sequence(F.lit(0), F.floor(F.size(rows) / 2).cast("int") - 1), lambda i: pair(F.get(rows, 2 * i), F.get(rows, 2 * i + 1)))).when(kind == INSERT, F.transform(rows, lambda r: pair(none, r))).when(kind == DELETE, F.transform(rows, lambda r: pair(r, none)))
    return feed.filter(F.size(rows) >= F.when(kind == UPDATE, 2).otherwise(1)).select("*", F.posexplode(pairs).alias("ordinal", "pair")).select("*", "pair.before", "pair.after").drop("pair", "rows")


def named(df: DataFrame) -> DataFrame:
    """Values by column name as JSON images; the key comes from the before image if there is one. The column's encoder
    decides how a value goes in: numbers with all their digits, documents as they are, all else as a string, however much it
    looks like a number. A value that its encoder can't take, such as NaN, is a string too."""
    number = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"

    def value(v: Column, kind: Column) -> Column:
        plain = (kind == "number") & v.rlike(number) | (kind == "json") & F.try_parse_json(F.when(kind == "json", v)).isNotNull()
        return F.when(v.isNull(), "null").when(plain, v).otherwise(json_string(v))

    member = lambda c: F.concat(json_string(c["names"]), F.lit(":"), value(c["v"], c["encoders"]))

    def json(c: str):
        pairs = F.sort_array(F.arrays_zip("names", F.col(c).alias("v"), "encoders"))
        return F.when(F.col(c).isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(pairs, member), ","), F.lit("}")))

    source = F.coalesce("before", "after")
    keys = F.transform("pk", lambda c: F.get(source, (F.array_position("names", c) - 1).cast("int")))
    out = df.withColumns({"row_before": json("before"), "row_after": json("after"), "pk_values": pk_encode(keys)})
    return out.withColumn("changed_columns", F.when(F.col("event_type") == UPDATE, changed_columns("row_before", "row_after"))).drop("before", "after", "names", "encoders", "pk")


def stamped(feed: DataFrame) -> DataFrame:
    """Positions from the event's end and size, time from seconds, empty ids to null."""
    return feed.withColumns({"start_pos": F.col("end_pos") - F.col("event_size"), "event_timestamp": F.timestamp_seconds("epoch"), "gtid": F.nullif("gtid", F.lit("")), "connection_id": F.nullif("connection_id", F.lit(0))})


def normalise(feed: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change log rows, rejected feed rows)."""
    marked = with_columns(stamped(feed), snapshots)
    return named(exploded(marked.filter("reject IS NULL").drop("reject"))), marked.filter("reject IS NOT NULL").drop("names", "encoders", "pk")


def ddl_rows(feed: DataFrame, query_col: str = "query") -> DataFrame:
    """DDL statements with kind, schema and table; the statement's own schema goes before the session's."""
    schema, table = ddl_table(query_col)
    own = F.when(schema == "", F.col("schema_name")).otherwise(schema) if "schema_name" in feed.columns else schema
    return feed.withColumns({"ddl_type": ddl_kind(query_col), "schema_name": own, "table_name": table}).filter("ddl_type IS NOT NULL")


def split_metadata(log: DataFrame, server_id: str) -> DataFrame:
    """What may leave the site: no values of rows or keys."""
    return log.select(F.lit(server_id).alias("server_id"), "event_id", "event_timestamp", "schema_name", "table_name", "event_type", pk_hash("pk_values").alias("pk_hash"), changed_columns("row_before", "row_after").alias("changed_columns"))


def split_payload(log: DataFrame, server_id: str) -> DataFrame:
    """The full rows, with the partition columns of the payload sink."""
    return log.select("event_id", "event_timestamp", "pk_values", pk_hash("pk_values").alias("pk_hash"), "row_before", "row_after", F.lit(server_id).alias("server_id"), F.concat_ws(".", "schema_name", "table_name").alias("schema_table"), F.to_date("event_timestamp").alias("date"))


def schema_snapshot(catalogue: DataFrame, before: DataFrame, taken_at) -> DataFrame:
    """information_schema columns as a snapshot with the next id; system schemas stay out."""
    # The system schemas.
    system = ["information_schema", "mysql", "performance_schema", "sys"]
    following = before.agg((F.coalesce(F.max("snapshot_id"), F.lit(0)) + 1).alias("snapshot_id"))
    own = catalogue.filter(~F.lower("schema_name").isin(system)).withColumn("is_generated", F.upper(F.coalesce("extra", F.lit(""))).contains("GENERATED").cast("int"))
    return own.join(F.broadcast(following)).withColumn("snapshot_time", F.lit(taken_at).cast("timestamp"))
