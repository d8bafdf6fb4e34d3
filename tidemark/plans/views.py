"""Change-log views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import size_of

#: Row changes of accounts and wallets, from `events`.
CL_ACCOUNTS = """
WITH raw AS (
  SELECT event_id,
    'mysql-bin.' || lpad(CAST(100000 + CAST(floor(event_id / 1000) AS BIGINT) AS VARCHAR(10)), 6, '0') AS binlog_file,
    event_id * 100 AS start_pos, event_id * 100 + 99 AS end_pos,
    date_trunc('second', ts) AS event_timestamp,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE '3e11fa47-71ca-11e1-9e33-c80aa9429562:' || CAST(CAST(floor(event_id / 3) AS BIGINT) AS VARCHAR(20)) END AS gtid,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id % 7 + 1 AS BIGINT) END AS connection_id,
    'app' AS schema_name,
    CASE WHEN user_id % 2 = 0 THEN 'accounts' ELSE 'wallets' END AS table_name,
    CASE WHEN event_type = 'error' THEN 3 ELSE 2 END AS kind,
    CAST(user_id AS VARCHAR(20)) AS pk_values,
    CASE WHEN event_type = 'error' THEN NULL ELSE
      concat('{"amount":', CASE WHEN event_id % 17 = 0 THEN 'null' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR(20)) END,
             ',"kind":"', event_type, '","user_id":', CAST(user_id AS VARCHAR(20)), '}') END AS row_after
  FROM events),
seq AS (
  SELECT raw.*, lag(row_after) OVER (PARTITION BY schema_name, table_name, pk_values ORDER BY event_timestamp, event_id) AS row_before FROM raw)
SELECT event_id, binlog_file, start_pos, end_pos, event_timestamp, gtid, connection_id, schema_name, table_name,
  CASE WHEN kind = 3 THEN 3 WHEN row_before IS NULL THEN 1 ELSE 2 END AS event_type,
  pk_values, row_before, row_after,
  CASE WHEN sv = 0 THEN 1 ELSE 2 END AS schema_version
FROM (SELECT seq.*, event_id % 2 AS sv FROM seq) q
WHERE NOT (kind = 3 AND row_before IS NULL)
"""

#: A snapshot of orders.
BL_ORDERS = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS pk_values,
  concat('{"o_orderkey":', CAST(o_orderkey AS VARCHAR(20)), ',"price_cents":', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)), ',"status":"', o_orderstatus, '"}') AS row_image
FROM orders
"""

#: Row changes of orders, from `lineitem` and `orders`.
CL_ORDERS = """
WITH li AS (
  SELECT l_orderkey, l_linenumber, l_shipdate, min(l_returnflag) AS flag, min(l_linestatus) AS status,
    max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_shipdate),
raw AS (
  SELECT CAST(l_orderkey * 1000000 + l_linenumber * 100000 + (year(l_shipdate) - 1995) * 1300 + month(l_shipdate) * 100 + day(l_shipdate) AS BIGINT) AS event_id,
    l_shipdate AS event_timestamp,
    CAST(CASE WHEN l_linenumber = 7 THEN l_orderkey + 100000000 ELSE l_orderkey END AS VARCHAR(20)) AS pk_values,
    CASE WHEN flag = 'R' AND l_linenumber = 1 THEN 3 ELSE 2 END AS kind,
    CASE WHEN flag = 'R' AND l_linenumber = 1 THEN NULL ELSE
      concat('{"o_orderkey":', CAST(CASE WHEN l_linenumber = 7 THEN l_orderkey + 100000000 ELSE l_orderkey END AS VARCHAR(20)),
             ',"price_cents":', CAST(cents AS VARCHAR(20)), ',"status":"', status, '"}') END AS row_after
  FROM li WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'),
seq AS (
  SELECT raw.*, row_number() OVER (PARTITION BY pk_values ORDER BY event_timestamp, event_id) AS rn,
    lag(row_after) OVER (PARTITION BY pk_values ORDER BY event_timestamp, event_id) AS prev FROM raw),
img AS (
  SELECT s.*, CASE WHEN s.rn = 1 THEN b.row_image ELSE s.prev END AS row_before
  FROM seq s LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR(20)) AS pk,
      concat('{"o_orderkey":', CAST(o_orderkey AS VARCHAR(20)), ',"price_cents":', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)), ',"status":"', o_orderstatus, '"}') AS row_image FROM orders) b
    ON b.pk = s.pk_values)
SELECT event_id, event_timestamp, 'shop' AS schema_name, 'orders' AS table_name,
  CASE WHEN kind = 3 THEN 3 WHEN row_before IS NULL THEN 1 ELSE 2 END AS event_type,
  pk_values, row_before, row_after
FROM img WHERE NOT (kind = 3 AND row_before IS NULL)
"""

TABLES = ("customer", "events", "lineitem", "nation", "orders", "supplier")


#: Bytes of the tables for each partition of a shuffle; their rows are some ten times as large in the views.
PART_BYTES = 4 << 20


def width(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the tables should be dealt into, so that a part doesn't grow with them."""
    return -(-size_of(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]) // PART_BYTES)


def run(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """A statement over the driver's tables, cl, co and bl standing for the views, and frames under their names."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Shuffles begin with so many partitions; adaptive execution puts small ones together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(width(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(with_views(sql))


def with_views(sql: str) -> str:
    import re

    own = [f"{name} AS ({view})" for name, view in (("cl", CL_ACCOUNTS), ("co", CL_ORDERS), ("bl", BL_ORDERS)) if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]
    if not own:
        return sql
    head = ", ".join(own)
    return f"WITH {head}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {head} {sql}"


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT * FROM cl")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT * FROM co")


def orders_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT * FROM bl")
