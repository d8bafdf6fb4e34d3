"""Statements that reverse changes, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import event_type_name, image, quote_name, sql_literal
from tidemark.schema import DELETE, INSERT, UPDATE


def table_keys(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, schema_name, table_name, pk, generated): key columns in ordinal order, and generated ones."""
    pk = F.sort_array(F.collect_list(F.when(F.col("column_key") == "PRI", F.struct("ordinal_position", "column_name"))))
    return snapshots.groupBy("snapshot_id", "schema_name", "table_name").agg(F.transform(pk, lambda x: x["column_name"]).alias("pk"), F.collect_list(F.when(F.col("is_generated") == 1, F.col("column_name"))).alias("generated"))


def with_schema(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The log with key and generated columns of each event's schema version; an unknown version takes the latest."""
    keys = table_keys(snapshots)
    names = ["schema_name", "table_name"]
    latest = keys.groupBy(*names).agg(F.max_by(F.struct("pk", "generated"), F.col("snapshot_id")).alias("_latest"))
    exact = keys.select(F.col("snapshot_id").alias("schema_version"), *names, F.struct("pk", "generated").alias("_exact"))
    out = log.join(exact, ["schema_version", *names], "left").join(latest, names, "left")
    chosen = F.coalesce("_exact", "_latest")
    none = F.array().cast("array<string>")
    return out.withColumns({"pk": F.coalesce(chosen["pk"], none), "generated": F.coalesce(chosen["generated"], none)}).drop("_exact", "_latest")


def _columns(row: Column, generated: Column) -> Column:
    return F.sort_array(F.array_except(F.map_keys(row), generated))


def _where(row: Column, pk: Column, null_safe: bool) -> Column:
    by_pk = (F.size(pk) > 0) & F.forall(pk, lambda c: F.map_contains_key(row, c))
    columns = F.when(by_pk, pk).otherwise(F.sort_array(F.map_keys(row)))
    sign = F.lit(" <=> " if null_safe else " = ")
    return F.array_join(F.transform(columns, lambda c: F.concat(quote_name(c), sign, sql_literal(F.element_at(row, c)))), " AND ")


def statements(log: DataFrame, snapshots: DataFrame, null_safe: bool = False, kept: list[str] | None = None) -> DataFrame:
    """(event_id, event_timestamp, comment, statement, error) for each event, and columns of the log that are kept. What
    can't be reversed has an error and no statement. The order to run them in is descending (event_timestamp, event_id)."""
    out = with_schema(log, snapshots).withColumns({"_b": image("row_before"), "_a": image("row_after")})
    b, a, pk, generated = F.col("_b"), F.col("_a"), F.col("pk"), F.col("generated")
    name = F.concat(quote_name("schema_name"), F.lit("."), quote_name("table_name"))
    own = _columns(b, generated)
    values = F.transform(own, lambda c: sql_literal(F.element_at(b, c)))
    insert = F.concat(F.lit("INSERT INTO "), name, F.lit(" ("), F.array_join(F.transform(own, quote_name), ", "), F.lit(") VALUES ("), F.array_join(values, ", "), F.lit(");"))
    sets = F.array_join(F.transform(own, lambda c: F.concat(quote_name(c), F.lit(" = "), sql_literal(F.element_at(b, c)))), ", ")
    where = _where(a, pk, null_safe)
    update = F.concat(F.lit("UPDATE "), name, F.lit(" SET "), sets, F.lit(" WHERE "), where, F.lit(";"))
    delete = F.concat(F.lit("DELETE FROM "), name, F.lit(" WHERE "), where, F.lit(";"))
    kind = F.col("event_type")
    endless = lambda m: F.coalesce(F.exists(F.map_values(m), lambda v: F.coalesce((F.schema_of_variant(v) == "DOUBLE") & F.variant_get(v, "$", "string").isin("Infinity", "-Infinity"), F.lit(False))), F.lit(False))
    error = (
        F.when(kind.isin(UPDATE, DELETE) & b.isNull(), F.lit("row_before is missing"))
        .when(kind.isin(INSERT, UPDATE) & a.isNull(), F.lit("row_after is missing"))
        .when(endless(b) | endless(a), F.lit("a number is not finite"))
        .when(~kind.isin(INSERT, UPDATE, DELETE), F.concat(event_type_name(kind), F.lit(" can't be reversed")))
    )
    statement = F.when(error.isNull(), F.when(kind == DELETE, insert).when(kind == UPDATE, update).when(kind == INSERT, delete))
    gtid = F.coalesce(F.concat(F.lit(", transaction "), F.col("gtid")), F.lit("")) if "gtid" in log.columns else F.lit("")
    comment = F.concat(F.lit("-- event "), F.col("event_id").cast("string"), F.lit(", "), event_type_name(kind), F.lit(" of "), "schema_name", F.lit("."), "table_name", F.lit(" key "), "pk_values", F.lit(" at "), F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss"), gtid)
    return out.select("event_id", "event_timestamp", comment.alias("comment"), statement.alias("statement"), error.alias("error"), *(kept or []))


def script(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(event_timestamp, event_id, text): a transaction around the statements in the order to run them, under a header with
    the number of events; one line if there are none. What can't be reversed is a comment. Header and end stand first and
    last by their times; the sort is by range, so that the text can be written in order by many tasks."""
    body = statements(log, snapshots)
    text = F.concat_ws("\n", "comment", F.coalesce("statement", F.concat(F.lit("-- ERROR: "), "error")))
    n = log.agg(F.count("*").alias("n"))
    at = lambda year, line: F.struct(F.lit(f"{year}-01-01 00:00:00").cast("timestamp").alias("event_timestamp"), F.lit(0).cast("long").alias("event_id"), line.alias("text"))
    head = F.concat(F.lit("-- Undo of "), F.col("n").cast("string"), F.lit(" events. Read it before it runs.\nBEGIN;"))
    edges = n.select(F.explode(F.when(F.col("n") == 0, F.array(at(2999, F.lit("-- Nothing to undo.")))).otherwise(F.array(at(2999, head), at(1900, F.lit("COMMIT;"))))).alias("e")).select("e.*")
    return body.select("event_timestamp", "event_id", text.alias("text")).unionByName(edges).orderBy(F.desc("event_timestamp"), F.desc("event_id"))
