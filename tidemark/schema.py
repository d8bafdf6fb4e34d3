"""The change-log data model: one row for each changed row, with full images as JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

# Event kinds and their codes.
EVENT_TYPES = {1: "INSERT", 2: "UPDATE", 3: "DELETE", 4: "DDL", 5: "GTID", 6: "SNAPSHOT"}
INSERT, UPDATE, DELETE, DDL, GTID, SNAPSHOT = EVENT_TYPES

#: Partition columns server_id, event_date and event_hour come from the paths of archives.
CHANGELOG = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("binlog_file", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()),
        T.StructField("event_timestamp", T.TimestampType()), T.StructField("gtid", T.StringType()), T.StructField("connection_id", T.LongType()),
        T.StructField("schema_name", T.StringType()), T.StructField("table_name", T.StringType()), T.StructField("event_type", T.IntegerType()), T.StructField("pk_values", T.StringType()),
        T.StructField("changed_columns", T.ArrayType(T.StringType())), T.StructField("row_before", T.StringType()), T.StructField("row_after", T.StringType()), T.StructField("schema_version", T.IntegerType()),
    ]
)

#: Order of the log: timestamps have a precision of seconds, so the id decides between equal ones.
ORDER = ("event_timestamp", "event_id")
