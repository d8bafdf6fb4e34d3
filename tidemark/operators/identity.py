"""Servers, constraints and keys: who is who."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import pk_hash


def resolve(observations: DataFrame, servers: DataFrame) -> DataFrame:
    """(observation_id, outcome, server_id, changes array<struct<field,old,new>>) of (observation_id, server_uuid, host,
    port, username) against the registry: no_change, migration, uuid_regen, conflict or new (server_id null)."""
    by_uuid = servers.select("server_uuid", F.struct("server_id", "host", "port", "username").alias("u"))
    by_place = servers.select("host", "port", "username", F.struct("server_id", "server_uuid").alias("p"))
    out = observations.join(by_uuid, "server_uuid", "left").join(by_place, ["host", "port", "username"], "left")
    u, p = F.col("u"), F.col("p")
    outcome = F.when(u.isNotNull() & p.isNotNull(), F.when(u["server_id"] == p["server_id"], "no_change").otherwise("conflict")).when(u.isNotNull(), "migration").when(p.isNotNull(), "uuid_regen").otherwise("new")
    change = lambda name, old, new: F.when(old != new, F.struct(F.lit(name).alias("field"), old.alias("old"), new.alias("new")))
    moved = F.array_compact(F.array(change("host", u["host"], F.col("host")), change("port", u["port"].cast("string"), F.col("port").cast("string")), change("username", u["username"], F.col("username"))))
    renamed = F.array_compact(F.array(change("server_uuid", p["server_uuid"], F.col("server_uuid"))))
    changes = F.when(outcome == "migration", moved).when(outcome == "uuid_regen", renamed)
    return out.select("observation_id", outcome.alias("outcome"), F.when(outcome != "conflict", F.coalesce(u["server_id"], p["server_id"])).alias("server_id"), changes.alias("changes"))


def audit_rows(resolved: DataFrame) -> DataFrame:
    return resolved.select("server_id", F.explode("changes").alias("c")).select("server_id", "c.field", "c.old", "c.new")


def resolve_hashes(requests: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """(pk_hash, pk_values, found): key values of hashes, from the first source (recent, live, archive ...) that has it."""
    out = None
    for i, s in enumerate(sources):
        own = s.select(pk_hash("pk_values").alias("pk_hash"), "pk_values", F.lit(i).alias("rank"))
        out = own if out is None else out.unionByName(own)
    wanted = requests.select("pk_hash").distinct()
    best = out.join(wanted, "pk_hash", "left_semi").groupBy("pk_hash").agg(F.min_by("pk_values", "rank").alias("pk_values"))
    return wanted.join(best, "pk_hash", "left").withColumn("found", F.col("pk_values").isNotNull())


def foreign_key_rows(usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Foreign-key columns with their rules, from the two catalogue tables."""
    keys = ["constraint_schema", "constraint_name"]
    return usage.filter("referenced_table IS NOT NULL").join(constraints, keys).select("constraint_schema", "constraint_name", "table_name", "column_name", "ordinal_position", "referenced_table", "referenced_column", "update_rule", "delete_rule").orderBy(*keys, "ordinal_position")


def cascades(constraints: DataFrame, schemas: list[str] | None = None) -> DataFrame:
    """Constraints that change rows of other tables on their own, which a log of changes doesn't show."""
    out = constraints.filter("update_rule = 'CASCADE' OR delete_rule = 'CASCADE'")
    return out if not schemas else out.filter(F.col("constraint_schema").isin(schemas))


def table_violations(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(schema_name, table_name, problem) of base tables with another engine or without a primary key."""
    base = tables.filter("table_type = 'BASE TABLE'")
    keyed = columns.filter("column_key = 'PRI'").select("schema_name", "table_name").distinct()
    engine = base.filter("engine IS NULL OR engine <> 'InnoDB'").select("schema_name", "table_name", F.lit("engine").alias("problem"))
    return engine.unionByName(base.join(keyed, ["schema_name", "table_name"], "left_anti").select("schema_name", "table_name", F.lit("no primary key").alias("problem")))


def schema_changes(changes: DataFrame, schema=None, table=None, ddl_type=None, since=None, until=None, limit: int = 100) -> DataFrame:
    for name, value in (("schema_name", schema), ("table_name", table)):
        changes = changes if value is None else changes.filter(F.col(name) == value)
    if ddl_type is not None:
        changes = changes.filter(F.col("ddl_type").startswith(ddl_type.upper()))
    if since is not None:
        changes = changes.filter(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        changes = changes.filter(F.col("detected_at") <= F.lit(until).cast("timestamp"))
    return changes.orderBy(F.desc("detected_at")).limit(limit)
