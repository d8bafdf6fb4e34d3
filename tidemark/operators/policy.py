"""Governance: flags on tables and columns, profiles, and the rules that deny or redact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import image


def profile_rules(rules: DataFrame, profiles: DataFrame, flags: DataFrame, profile: str) -> DataFrame:
    """(schema_name, table_name, column_name) that a profile is denied; an empty column stands for the whole table."""
    own = rules.filter("permission = 'deny'").join(profiles.filter(F.col("name") == profile), rules["profile_id"] == profiles["id"]).select("flag")
    return own.join(flags, "flag").select("schema_name", "table_name", F.coalesce("column_name", F.lit("")).alias("column_name")).distinct()


def redact(json, columns: Column) -> Column:
    """An image with the values of some columns null; the keys stay."""
    hidden = F.transform_values(image(json), lambda k, v: F.when(F.array_contains(columns, k), F.parse_json(F.lit("null"))).otherwise(v))
    return F.to_json(hidden)


def apply_policy(log: DataFrame, denied: DataFrame) -> DataFrame:
    """The log without denied tables and with denied columns redacted in both images; from any source alike."""
    keys = ["schema_name", "table_name"]
    out = log.join(denied.filter("column_name = ''").select(*keys).distinct(), keys, "left_anti")
    columns = denied.filter("column_name <> ''").groupBy(*keys).agg(F.collect_set("column_name").alias("_hidden"))
    out = out.join(columns, keys, "left")
    hide = lambda c: F.when(F.col("_hidden").isNull() | F.col(c).isNull(), F.col(c)).otherwise(redact(c, F.col("_hidden"))).alias(c)
    return out.select([hide(c) if c in ("row_before", "row_after") else F.col(c) for c in log.columns])


def list_flags(flags: DataFrame, schema: str | None = None, table: str | None = None, flag: str | None = None) -> DataFrame:
    for name, value in (("schema_name", schema), ("table_name", table), ("flag", flag)):
        flags = flags if value is None else flags.filter(F.col(name) == value)
    return flags.orderBy("schema_name", "table_name", "column_name", "flag")


def list_access(rules: DataFrame, profiles: DataFrame, profile: str | None = None) -> DataFrame:
    out = rules.join(profiles, rules["profile_id"] == profiles["id"]).select(F.col("name").alias("profile"), "flag", "permission")
    return (out if profile is None else out.filter(F.col("profile") == profile)).orderBy("profile", "flag")
