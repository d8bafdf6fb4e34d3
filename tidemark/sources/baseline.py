"""Snapshots of whole tables: <root>/<moment>/<schema>/<table>, and a table of what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import canonical_key, dir_time, pk_encode

# Spark types of source types.
TYPES = {"int": ("tinyint", "smallint", "mediumint", "int", "integer", "year"), "bigint": ("bigint",), "float": ("float",), "double": ("double", "real"), "timestamp": ("datetime", "timestamp"), "date": ("date",), "binary": ("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob", "bit")}


def spark_type(data_type: str, column_type: str = "") -> str:
    """Decimals, times, enums, JSON and unknown types are text; unsigned integers take the next wider type."""
    name = data_type.lower()
    found = next((k for k, v in TYPES.items() if name in v), "string")
    if "unsigned" in column_type.lower():
        return {"int": "bigint", "bigint": "decimal(20,0)"}.get(found, found)
    return found


def typed(column: str, data_type: str, column_type: str = "") -> Column:
    """Text as a typed column; what can't be read is null."""
    kind = spark_type(data_type, column_type)
    if kind == "timestamp":
        return F.try_to_timestamp(F.col(column)).alias(column)
    return F.col(column).try_cast(kind).alias(column)


def write_baseline(rows: DataFrame, columns: list[tuple[str, str, str]], root: str, moment: str, schema: str, table: str, binlog_file: str = "", binlog_pos: int = 0, gtid_set: str = "", codec: str = "zstd", skip_existing: bool = True) -> str:
    """A table's rows, typed by (name, data type, column type), and a row about the snapshot beside it. An empty table
    is written too. With skip_existing a snapshot that is there stays."""
    path = f"{root}/{moment}/{schema}/{table}"
    spark = rows.sparkSession
    if skip_existing and exists(spark, f"{path}/_SUCCESS"):
        return path
    rows.select([typed(*c) for c in columns]).write.mode("overwrite").option("compression", codec).parquet(path)
    about = spark.createDataFrame([(schema, table, moment, path, binlog_file, binlog_pos, gtid_set)], "schema_name string, table_name string, moment string, path string, binlog_file string, binlog_pos long, gtid_set string")
    # A folder for each snapshot, so that one that is written again replaces its row.
    about.withColumn("snapshot_time", dir_time("moment")).coalesce(1).write.mode("overwrite").parquet(f"{root}/_about/of={moment}.{schema}.{table}")
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(schema_name, table_name, snapshot_time, path, binlog_file, binlog_pos, gtid_set) of all snapshots."""
    return spark.read.parquet(f"{root}/_about").drop("moment", "of")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """The inventory from the folders alone, for snapshots that others wrote."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    layout = r"^(.*/([^/]+T[^/]+)/([^/]+)/([^/]+?)(?:\.parquet)?)(?:/[^/]*\.parquet)?$"
    part = lambda i: F.regexp_extract("path", layout, i)
    return files.select(part(3).alias("schema_name"), part(4).alias("table_name"), dir_time(part(2)).alias("snapshot_time"), part(1).alias("path")).filter("snapshot_time IS NOT NULL").distinct()


def keyed(rows: DataFrame, key: list[tuple[str, str, str]]) -> DataFrame:
    """(pk_values, row_image) of typed rows; key: (name, data type, column type) in ordinal order."""
    missing = [c for c, _, _ in key if c not in rows.columns]
    if missing:
        raise ValueError(f"key columns not in the snapshot: {missing}")
    parts = F.array(*[canonical_key(F.col(c), d, t) for c, d, t in key])
    return rows.select(pk_encode(parts).alias("pk_values"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("row_image"))


def row(rows: DataFrame, key: dict[str, object]) -> DataFrame:
    """The rows of a snapshot with these key values, by its typed columns, so that the filter reaches the files. A column
    that isn't there raises."""
    if missing := [c for c in key if c not in rows.columns]:
        raise ValueError(f"key columns not in the snapshot: {missing}")
    out = rows
    for c, value in key.items():
        out = out.filter(F.col(c).eqNullSafe(F.lit(value).cast(rows.schema[c].dataType)))
    return out


def sql_over(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A query over snapshots and archives under names of the caller's choice."""
    return spark.sql(query, **tables)
