"""Queries over the driver's tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import coverage, gtid, identity, normalise, policy, retention, timetravel, undo
from tidemark.operators import search as S
from tidemark.plans.views import accounts, orders_baseline, orders_log, run, width, with_views
from tidemark.session import shared_root
from tidemark.sources import archive, baseline, dumps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COLS = ["event_id", "event_timestamp", "schema_name", "table_name", "event_type", "pk_values", "row_before", "row_after"]
LISTED = ", ".join(COLS)
AT, SNAPSHOT_TIME = "1999-06-01 00:00:00", "1998-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors see it."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


# Small tables that stand in for a catalogue and rules; they are only ever joined to the driver's tables.
SNAPSHOTS = """SELECT * FROM (VALUES (1,'app','accounts','amount',1,'',0),(1,'app','accounts','kind',2,'',0),(1,'app','accounts','user_id',3,'PRI',0),
(1,'app','wallets','amount',1,'',0),(1,'app','wallets','kind',2,'',0),(1,'app','wallets','user_id',3,'PRI',0),
(2,'app','accounts','amount',1,'',1),(2,'app','accounts','kind',2,'PRI',0),(2,'app','accounts','user_id',3,'PRI',0),
(2,'app','wallets','amount',1,'',1),(2,'app','wallets','kind',2,'PRI',0),(2,'app','wallets','user_id',3,'PRI',0),
(1,'shop','orders','o_orderkey',1,'PRI',0),(1,'shop','orders','price_cents',2,'',0),(1,'shop','orders','status',3,'',0))
AS t(snapshot_id, schema_name, table_name, column_name, ordinal_position, column_key, is_generated)"""
FLAGS = "SELECT * FROM (VALUES ('app','wallets','','billing'),('app','accounts','kind','pii')) AS t(schema_name, table_name, column_name, flag)"
PROFILES = "SELECT * FROM (VALUES (1,'dev'),(2,'marketing')) AS t(id, name)"
RULES = "SELECT * FROM (VALUES (1,'billing','deny'),(2,'pii','deny'),(2,'billing','allow')) AS t(profile_id, flag, permission)"


def small(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def simple(name: str, where: str, **fields) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {k: v(spark) if callable(v) else v for k, v in fields.items()}
        return S.matching(accounts(spark, sf_dir), S.Search(**own)).select(COLS)

    f.__name__ = name
    query(f"SELECT {LISTED} FROM cl WHERE {where}")(f)


JSON_EQ = "(COALESCE(json_extract_string(row_after, '$.kind') = '{v}', false) OR COALESCE(json_extract_string(row_before, '$.kind') = '{v}', false))"
JSON_NULL = "(COALESCE(json_type(json_extract(row_after, '$.amount')) = 'NULL', false) OR COALESCE(json_type(json_extract(row_before, '$.amount')) = 'NULL', false))"
CHANGED = "list_filter(['amount', 'kind', 'user_id'], lambda c: json_extract(row_before, '$.' || c) IS DISTINCT FROM json_extract(row_after, '$.' || c))"

simple("search_schema_table", "schema_name = 'app' AND table_name = 'accounts'", schema="app", table="accounts")
simple("search_pk", "pk_values = '7'", pk="7")
simple("search_pk_in", "pk_values IN ('3', '5', '8')", pk_in=["3", "5", "8"])
simple("search_pk_join", "pk_values IN ('3', '5', '8')", pk_in=lambda s: s.createDataFrame([("3",), ("5",), ("8",)], "pk string"))
simple("search_event_type", "event_type = 3", event_type=3)
simple("search_gtid", "gtid = '3e11fa47-71ca-11e1-9e33-c80aa9429562:100'", gtid="3e11fa47-71ca-11e1-9e33-c80aa9429562:100")
simple("search_time_range", "event_timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:30:00'", since="2024-01-05", until="2024-01-06 12:30:00")
simple("search_changed_column", f"event_type = 2 AND list_contains({CHANGED}, 'amount')", changed_column="amount")
simple("search_column_eq", JSON_EQ.format(v="click"), column_eq=[("kind", "click")])
simple("search_column_null", JSON_NULL, column_eq=[("amount", None)])
simple("search_column_and", JSON_EQ.format(v="click") + " AND " + JSON_NULL, column_eq=[("kind", "click"), ("amount", None)])
simple("search_unsafe_column", "false", column_eq=[("a b", "x")])
simple("search_flag", "table_name = 'wallets'", flagged=lambda s: small(s, FLAGS).filter("flag = 'billing'"))
simple("search_deny", "table_name <> 'wallets'", denied=lambda s: small(s, FLAGS).filter("flag = 'billing'"))
simple("pk_hash_filter", "pk_values IN ('11', '12')", pk_hashes=lambda s: s.createDataFrame([("11",), ("12",)], "p string").select(F.sha2("p", 256)))


@query(f"SELECT event_id, schema_name, table_name, CASE WHEN table_name = 'accounts' THEN regexp_replace(row_before, '\"kind\":\"[^\"]*\"', '\"kind\":null') ELSE row_before END AS row_before, CASE WHEN table_name = 'accounts' THEN regexp_replace(row_after, '\"kind\":\"[^\"]*\"', '\"kind\":null') ELSE row_after END AS row_after FROM cl")
def redact_columns(spark, sf_dir):
    denied = policy.profile_rules(small(spark, RULES), small(spark, PROFILES), small(spark, FLAGS), "marketing")
    return policy.apply_policy(accounts(spark, sf_dir), denied).select("event_id", "schema_name", "table_name", "row_before", "row_after")


@query("SELECT schema_name, table_name, count(*) AS events FROM cl WHERE table_name = 'wallets' GROUP BY 1, 2")
def profile_rules(spark, sf_dir):
    """Events that a profile may not see."""
    denied = policy.profile_rules(small(spark, RULES), small(spark, PROFILES), small(spark, FLAGS), "dev")
    return accounts(spark, sf_dir).join(denied.filter("column_name = ''"), ["schema_name", "table_name"], "left_semi").groupBy("schema_name", "table_name").agg(F.count("*").alias("events"))


@query(f"SELECT {LISTED} FROM cl ORDER BY event_timestamp, event_id LIMIT 100")
def first_n(spark, sf_dir):
    return S.first_n(accounts(spark, sf_dir), 100).select(COLS)


@query(f"SELECT {LISTED} FROM cl QUALIFY row_number() OVER (PARTITION BY pk_values ORDER BY event_timestamp DESC, event_id DESC) <= 2")
def latest_n_per_pk(spark, sf_dir):
    return S.latest_per_key(accounts(spark, sf_dir), 2).select(COLS)


def two_sources(spark, sf_dir):
    log = accounts(spark, sf_dir)
    return [log.filter("event_id % 3 < 2").withColumn("origin", F.lit("live")), log.filter("event_id % 3 > 0").withColumn("origin", F.lit("archive"))]


@query("SELECT event_id, pk_values, CASE WHEN event_id % 3 < 2 THEN 'live' ELSE 'archive' END AS origin FROM cl")
def merge_sources(spark, sf_dir):
    return S.merge_sources(two_sources(spark, sf_dir)).select("event_id", "pk_values", "origin")


@query(f"SELECT {LISTED} FROM (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY pk_values ORDER BY event_timestamp DESC, event_id DESC) <= 1) ORDER BY event_timestamp, event_id LIMIT 50")
def merge_and_trim(spark, sf_dir):
    return S.merge_and_trim(two_sources(spark, sf_dir), 50, 1).select(COLS)


@query(f"SELECT {LISTED} FROM cl WHERE table_name = 'wallets' AND event_type = 2 ORDER BY event_timestamp, event_id LIMIT 40")
def search_merged(spark, sf_dir):
    return S.search(two_sources(spark, sf_dir), S.Search(table="wallets", event_type=2, limit=40)).select(COLS)


@query("SELECT u.position, u.pk_values, count(c.event_id) AS events, COALESCE(min(c.event_id), -1) AS first_id, COALESCE(max(c.event_id), -1) AS last_id FROM (SELECT DISTINCT CAST(user_id AS BIGINT) * 2 AS position, CAST(user_id * 2 AS VARCHAR(20)) AS pk_values FROM events) u LEFT JOIN cl c ON c.pk_values = u.pk_values GROUP BY 1, 2")
def grouped_by_pk(spark, sf_dir):
    wanted = run(spark, sf_dir, "SELECT DISTINCT CAST(user_id AS BIGINT) * 2 AS position, CAST(user_id * 2 AS VARCHAR(20)) AS pk_values FROM events")
    ids = F.transform("events", lambda e: e["event_id"])
    return S.grouped_by_pk(accounts(spark, sf_dir), wanted).select("position", "pk_values", F.size("events").cast("long").alias("events"), F.coalesce(F.array_min(ids), F.lit(-1)).alias("first_id"), F.coalesce(F.array_max(ids), F.lit(-1)).alias("last_id"))


@query("SELECT DISTINCT sha256(CAST(user_id * 2 AS VARCHAR)) AS pk_hash, c.pk_values, c.pk_values IS NOT NULL AS found FROM events e LEFT JOIN (SELECT DISTINCT pk_values FROM cl) c ON c.pk_values = CAST(e.user_id * 2 AS VARCHAR)")
def pk_hash_lookup(spark, sf_dir):
    requests = run(spark, sf_dir, "SELECT sha2(CAST(user_id * 2 AS STRING), 256) AS pk_hash FROM events")
    return identity.resolve_hashes(requests, two_sources(spark, sf_dir))


@query(f"SELECT event_id, array_to_string({CHANGED}, ',') AS changed FROM cl WHERE event_type = 2")
def changed_columns(spark, sf_dir):
    return accounts(spark, sf_dir).filter("event_type = 2").select("event_id", F.array_join(X.changed_columns("row_before", "row_after"), ",").alias("changed"))


@query("SELECT event_id, concat_ws('|', replace(replace(event_type || '|' || CAST(event_id AS VARCHAR), '\\', '\\\\'), '|', '\\|'), CAST(user_id AS VARCHAR), '<nil>') AS pk FROM events")
def pk_encode(spark, sf_dir):
    parts = F.array(F.concat_ws("|", "event_type", F.col("event_id").cast("string")), F.col("user_id").cast("string"), F.lit(None).cast("string"))
    return run(spark, sf_dir, "SELECT * FROM events").select("event_id", X.pk_encode(parts).alias("pk"))


@query("SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') || '-71ca-11e1-9e33-' || lpad(CAST(user_id AS VARCHAR), 12, '0') || ':1-' || CAST(event_id AS VARCHAR) || ',plain' AS gtid FROM events")
def gtid_repair(spark, sf_dir):
    raw = F.concat(F.col("event_id").cast("string"), F.lit("-71ca-11e1-9e33-"), F.col("user_id").cast("string"), F.lit(":1-"), F.col("event_id").cast("string"), F.lit(", plain"))
    return run(spark, sf_dir, "SELECT * FROM events").select("event_id", X.gtid_repair(raw).alias("gtid"))


@query("""WITH n AS (SELECT DISTINCT split_part(gtid, ':', 1) AS uuid, CAST(split_part(gtid, ':', 2) AS BIGINT) AS n FROM cl WHERE gtid IS NOT NULL),
r AS (SELECT uuid, min(n) AS lo, max(n) AS hi FROM (SELECT *, n - row_number() OVER (PARTITION BY uuid ORDER BY n) AS g FROM n) GROUP BY uuid, g)
SELECT uuid, uuid || ':' || string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) END, ':' ORDER BY lo) AS gtid_set FROM r GROUP BY uuid""")
def gtid_set(spark, sf_dir):
    return gtid.set_text(gtid.intervals(accounts(spark, sf_dir), buckets=256))


GTID_SPANS = "WITH n AS (SELECT DISTINCT split_part(gtid, ':', 1) AS uuid, CAST(split_part(gtid, ':', 2) AS BIGINT) AS n FROM cl WHERE gtid IS NOT NULL AND {where}), {name} AS (SELECT uuid, min(n) AS lo, max(n) AS hi FROM (SELECT *, n - row_number() OVER (PARTITION BY uuid ORDER BY n) AS g FROM n) GROUP BY uuid, g)"


@query("""WITH n AS (SELECT DISTINCT split_part(gtid, ':', 1) AS uuid, CAST(split_part(gtid, ':', 2) AS BIGINT) AS n, event_id % 50 < 45 AS seen FROM cl WHERE gtid IS NOT NULL),
p AS (SELECT uuid, min(n) AS lo, max(n) AS hi FROM (SELECT uuid, n, n - row_number() OVER (PARTITION BY uuid ORDER BY n) AS g FROM (SELECT DISTINCT uuid, n FROM n)) GROUP BY uuid, g),
c AS (SELECT uuid, min(n) AS lo, max(n) AS hi FROM (SELECT uuid, n, n - row_number() OVER (PARTITION BY uuid ORDER BY n) AS g FROM (SELECT DISTINCT uuid, n FROM n WHERE seen)) GROUP BY uuid, g)
SELECT uuid, lo, hi FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.uuid = p.uuid AND p.lo >= c.lo AND p.hi <= c.hi)""")
def gtid_gap(spark, sf_dir):
    log = accounts(spark, sf_dir)
    return gtid.gtid_gap(gtid.intervals(log), gtid.intervals(log.filter("event_id % 50 < 45")))


FILES = "SELECT CASE WHEN table_name = 'wallets' THEN 's2' ELSE 's1' END AS server_id, binlog_file AS file, max(end_pos) AS size FROM cl GROUP BY 1, 2"
MARKS = f"SELECT server_id, file, size + CASE WHEN CAST(right(file, 1) AS INT) % 3 = 0 THEN 1 ELSE 0 END AS position FROM ({FILES}) f"


@query(f"WITH f AS ({FILES}), m AS ({MARKS}), k AS (SELECT server_id, min(file) AS earliest_file, max(file) AS latest FROM f WHERE right(file, 1) <> '4' GROUP BY 1) SELECT m.server_id, m.file, m.position, CASE WHEN m.file LIKE '%4' OR m.position > f.size THEN 'unfillable' WHEN m.file < k.latest THEN 'fillable' ELSE 'ok' END AS status, k.earliest_file FROM m JOIN f ON f.server_id = m.server_id AND f.file = m.file LEFT JOIN k ON k.server_id = m.server_id")
def position_gap(spark, sf_dir):
    return gtid.position_gap(run(spark, sf_dir, MARKS), run(spark, sf_dir, f"SELECT * FROM ({FILES}) f WHERE right(file, 1) <> '4'"))


SPARSE = "SELECT event_id, binlog_file, start_pos AS pos, CASE WHEN event_id % 4 = 0 THEN gtid END AS gtid, CASE WHEN event_id % 5 = 0 THEN connection_id END AS connection_id FROM cl"


@query(f"SELECT event_id, last_value(gtid IGNORE NULLS) OVER w AS gtid, COALESCE(last_value(connection_id IGNORE NULLS) OVER w, -1) AS connection_id FROM ({SPARSE}) WINDOW w AS (PARTITION BY binlog_file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def carry_forward(spark, sf_dir):
    return normalise.carry_forward(run(spark, sf_dir, SPARSE), ["gtid", "connection_id"]).select("event_id", "gtid", F.coalesce("connection_id", F.lit(-1)).alias("connection_id"))


DDL = """SELECT event_id, ts AS detected_at, CAST(event_id % 3 AS INT) AS snapshot_id, 'session' AS schema_name,
CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'ALTER TABLE `s1`.`t' || CAST(user_id AS VARCHAR(9)) || '` ADD c INT' WHEN 1 THEN 'create table if not exists s2.t2 (id int)' WHEN 2 THEN '  DROP TABLE IF EXISTS `t3`'
 WHEN 3 THEN 'RENAME TABLE t4 TO t5' WHEN 4 THEN 'TRUNCATE s6.t6' WHEN 5 THEN 'truncate table `t7`' WHEN 6 THEN 'SELECT 1' ELSE 'UPDATE t SET a = 1' END AS query FROM events"""
DDL_KIND = "CASE event_id % 8 WHEN 0 THEN 'ALTER TABLE' WHEN 1 THEN 'CREATE TABLE' WHEN 2 THEN 'DROP TABLE' WHEN 3 THEN 'RENAME TABLE' ELSE 'TRUNCATE TABLE' END AS ddl_type"
DDL_NAMES = "CASE event_id % 8 WHEN 0 THEN 's1' WHEN 1 THEN 's2' WHEN 4 THEN 's6' ELSE 'session' END AS schema_name, CASE event_id % 8 WHEN 0 THEN 't' || CAST(user_id AS VARCHAR) WHEN 1 THEN 't2' WHEN 2 THEN 't3' WHEN 3 THEN 't4' WHEN 4 THEN 't6' ELSE 't7' END AS table_name"


@query(f"SELECT event_id, {DDL_KIND}, {DDL_NAMES} FROM events WHERE event_id % 8 < 6")
def ddl_classify(spark, sf_dir):
    return normalise.ddl_rows(run(spark, sf_dir, DDL)).select("event_id", "ddl_type", "schema_name", "table_name")


@query(f"SELECT event_id, ts AS detected_at, {DDL_KIND}, {DDL_NAMES} FROM events WHERE event_id % 8 = 4 AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC LIMIT 100")
def schema_changes(spark, sf_dir):
    changes = normalise.ddl_rows(run(spark, sf_dir, DDL))
    return identity.schema_changes(changes, schema="s6", ddl_type="truncate", since="2024-01-10 00:00:00").select("event_id", "detected_at", "ddl_type", "schema_name", "table_name")


LAST = f"last AS (SELECT pk_values AS pk, event_type, row_after, n FROM (SELECT *, count(*) OVER (PARTITION BY pk_values) AS n, row_number() OVER (PARTITION BY pk_values ORDER BY event_timestamp DESC, event_id DESC) AS r FROM co WHERE event_timestamp <= TIMESTAMP '{AT}') WHERE r = 1)"
MERGED = f"WITH {LAST}, m AS (SELECT COALESCE(b.pk_values, pk) AS pk_values, CASE WHEN pk IS NULL THEN b.row_image ELSE row_after END AS row_image, COALESCE(n, 0) AS n, CASE WHEN pk IS NULL THEN 'passthrough' WHEN event_type = 3 AND b.pk_values IS NULL THEN 'none' WHEN event_type = 3 THEN 'deleted' WHEN b.pk_values IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM bl b FULL JOIN last ON b.pk_values = pk)"


@query(MERGED + " SELECT pk_values, row_image, action FROM m WHERE action NOT IN ('none', 'deleted')")
def state_at(spark, sf_dir):
    return timetravel.state_at(orders_baseline(spark, sf_dir), orders_log(spark, sf_dir), AT)


@query(MERGED + " SELECT CAST(json_extract_string(row_image, '$.o_orderkey') AS BIGINT) AS o_orderkey, CAST(json_extract_string(row_image, '$.price_cents') AS BIGINT) AS price_cents, json_extract_string(row_image, '$.status') AS status FROM m WHERE action NOT IN ('none', 'deleted')")
def typed_state(spark, sf_dir):
    return timetravel.typed_rows(state_at(spark, sf_dir), "o_orderkey long, price_cents long, status string").drop("pk_values")


@query(MERGED + " SELECT pk_values, row_image, action FROM m WHERE action NOT IN ('none', 'deleted') AND pk_values IN ('1', '2', '3', '100000005')")
def row_state_at(spark, sf_dir):
    return timetravel.row_state_at(orders_baseline(spark, sf_dir), orders_log(spark, sf_dir), ["1", "2", "3", "100000005"], AT)


@query(f"SELECT pk_values, TIMESTAMP '{SNAPSHOT_TIME}' AS event_timestamp, CAST(0 AS BIGINT) AS event_id, 'baseline' AS source, row_image AS state FROM bl UNION ALL SELECT pk_values, event_timestamp, event_id, 'log', CASE WHEN event_type <> 3 THEN row_after END FROM co WHERE event_timestamp <= TIMESTAMP '{AT}'")
def row_history(spark, sf_dir):
    return timetravel.history(orders_baseline(spark, sf_dir), orders_log(spark, sf_dir), SNAPSHOT_TIME, AT)


@query(MERGED + " SELECT count(*) FILTER (action = 'passthrough') AS passthrough, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'deleted') AS deleted, CAST(0 AS BIGINT) AS invalid, CAST(sum(n) AS BIGINT) AS events FROM m")
def reconstruct_report(spark, sf_dir):
    return timetravel.report(orders_baseline(spark, sf_dir), orders_log(spark, sf_dir), AT)


@query(f"SELECT TIMESTAMP '{SNAPSHOT_TIME}' AS event_timestamp, 'shop' AS schema_name, 'orders' AS table_name, CAST(6 AS INT) AS event_type, pk_values, row_image AS row_after FROM bl")
def snapshot_events(spark, sf_dir):
    out = timetravel.snapshot_events(orders_baseline(spark, sf_dir), "shop", "orders", SNAPSHOT_TIME)
    return out.select("event_timestamp", "schema_name", "table_name", "event_type", "pk_values", "row_after")


@query("SELECT json_extract_string(row_image, '$.status') AS status, count(*) AS n FROM bl GROUP BY 1")
def baseline_sql(spark, sf_dir):
    return baseline.sql_over(spark, "SELECT get_json_object(row_image, '$.status') AS status, count(*) AS n FROM {b} GROUP BY 1", b=orders_baseline(spark, sf_dir))


@query("SELECT event_id, binlog_file, start_pos, binlog_file < 'mysql-bin.100001' OR binlog_file = 'mysql-bin.100001' AND start_pos <= 500 AS continuous FROM cl ORDER BY event_timestamp, event_id LIMIT 1")
def continuity_check(spark, sf_dir):
    return timetravel.continuity(accounts(spark, sf_dir), "mysql-bin.100001", 500)


INVENTORY = "SELECT 'shop' AS schema_name, 'c' || CAST(o_custkey AS VARCHAR(9)) AS table_name, o_orderdate AS snapshot_time, 'p/' || CAST(max(o_orderkey) AS VARCHAR(9)) AS path FROM orders GROUP BY 1, 2, 3"
ASKED = "SELECT 'shop' AS schema_name, 'c' || CAST(c_custkey AS VARCHAR(9)) AS table_name, TIMESTAMP '1997-01-01 00:00:00' AS at_time FROM customer"


@query(f"WITH i AS ({INVENTORY}), a AS ({ASKED}) SELECT a.schema_name, a.table_name, i.snapshot_time, i.path FROM a LEFT JOIN (SELECT * FROM i WHERE snapshot_time <= TIMESTAMP '1997-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY snapshot_time DESC) = 1) i ON i.table_name = a.table_name")
def baseline_pick(spark, sf_dir):
    return timetravel.pick_baseline(run(spark, sf_dir, INVENTORY), run(spark, sf_dir, ASKED).withColumnRenamed("at_time", "at")).drop("at")


Q = lambda c, j: f"CASE WHEN json_type(json_extract({j}, '$.{c}')) = 'VARCHAR' THEN '''' || json_extract_string({j}, '$.{c}') || '''' ELSE COALESCE(json_extract_string({j}, '$.{c}'), 'NULL') END"
NAME = "'`app`.`' || table_name || '`'"
WHERE = f"CASE WHEN schema_version = 2 THEN '`kind` = ' || {Q('kind', 'row_after')} || ' AND `user_id` = ' || {Q('user_id', 'row_after')} ELSE '`user_id` = ' || {Q('user_id', 'row_after')} END"
UNDO = {
    3: f"'INSERT INTO ' || {NAME} || ' (' || CASE WHEN schema_version = 2 THEN '' ELSE '`amount`, ' END || '`kind`, `user_id`) VALUES (' || CASE WHEN schema_version = 2 THEN '' ELSE {Q('amount', 'row_before')} || ', ' END || {Q('kind', 'row_before')} || ', ' || {Q('user_id', 'row_before')} || ');'",
    2: f"'UPDATE ' || {NAME} || ' SET ' || CASE WHEN schema_version = 2 THEN '' ELSE '`amount` = ' || {Q('amount', 'row_before')} || ', ' END || '`kind` = ' || {Q('kind', 'row_before')} || ', `user_id` = ' || {Q('user_id', 'row_before')} || ' WHERE ' || {WHERE} || ';'",
    1: f"'DELETE FROM ' || {NAME} || ' WHERE ' || {WHERE} || ';'",
}


ANY_UNDO = "CASE event_type " + " ".join(f"WHEN {kind} THEN {text}" for kind, text in UNDO.items()) + " END"


def undo_query(name: str, kind: int | None) -> None:
    """Of events of a kind, or of all; both schema versions."""
    where = "true" if kind is None else f"event_type = {kind}"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return undo.statements(accounts(spark, sf_dir).filter(where), small(spark, SNAPSHOTS)).select("event_id", "statement")

    f.__name__ = name
    query(f"SELECT event_id, {ANY_UNDO} AS statement FROM cl WHERE {where}")(f)


undo_query("undo_delete", 3)
undo_query("undo_update", 2)
undo_query("undo_insert", 1)
undo_query("undo_by_schema_version", None)


@query("SELECT event_id, 'DELETE FROM `shop`.`orders` WHERE `o_orderkey` = ' || json_extract_string(row_after, '$.o_orderkey') || ' AND `price_cents` = ' || json_extract_string(row_after, '$.price_cents') || ' AND `status` = ''' || json_extract_string(row_after, '$.status') || ''';' AS statement FROM co WHERE event_type = 1")
def undo_no_pk(spark, sf_dir):
    nothing = small(spark, SNAPSHOTS).filter("schema_name = 'app'")
    return undo.statements(orders_log(spark, sf_dir).filter("event_type = 1").withColumn("schema_version", F.lit(0)), nothing).select("event_id", "statement")


@query(f"SELECT event_id, {ANY_UNDO} AS statement FROM cl WHERE gtid = '3e11fa47-71ca-11e1-9e33-c80aa9429562:100'")
def undo_transaction(spark, sf_dir):
    found = S.matching(accounts(spark, sf_dir), S.Search(gtid="3e11fa47-71ca-11e1-9e33-c80aa9429562:100"))
    return undo.statements(found, small(spark, SNAPSHOTS)).select("event_id", "statement")


@query(f"SELECT event_id, {ANY_UNDO} AS statement FROM cl WHERE " + JSON_EQ.format(v="click"))
def undo_by_column_value(spark, sf_dir):
    found = S.matching(accounts(spark, sf_dir), S.Search(column_eq=[("kind", "click")]))
    return undo.statements(found, small(spark, SNAPSHOTS)).select("event_id", "statement")


@query(f"SELECT event_id, {ANY_UNDO} AS statement FROM cl WHERE table_name = 'wallets' AND event_timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:30:00' AND pk_values IN ('3', '5', '8', '12', '20')")
def undo_keys_in_time(spark, sf_dir):
    found = S.matching(accounts(spark, sf_dir), S.Search(table="wallets", since="2024-01-05", until="2024-01-06 12:30:00", pk_in=["3", "5", "8", "12", "20"]))
    return undo.statements(found, small(spark, SNAPSHOTS)).select("event_id", "statement")


UNDO_COMMENT = "'-- event ' || CAST(event_id AS VARCHAR) || ', ' || CASE event_type WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END || ' of app.' || table_name || ' key ' || pk_values || ' at ' || strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') || COALESCE(', transaction ' || gtid, '')"


@query(f"SELECT event_timestamp, event_id, {UNDO_COMMENT} || chr(10) || {ANY_UNDO} AS text FROM cl UNION ALL SELECT TIMESTAMP '2999-01-01 00:00:00', 0, '-- Undo of ' || CAST(count(*) AS VARCHAR) || ' events. Read it before it runs.' || chr(10) || 'BEGIN;' FROM cl UNION ALL SELECT TIMESTAMP '1900-01-01 00:00:00', 0, 'COMMIT;'")
def undo_script(spark, sf_dir):
    return undo.script(accounts(spark, sf_dir), small(spark, SNAPSHOTS))


@query(f"SELECT event_id, {UNDO[2]} AS statement FROM cl WHERE event_type = 2 AND table_name = 'accounts' AND pk_values = '8'")
def undo_rows_by_hash(spark, sf_dir):
    hashes = spark.createDataFrame([("8",)], "p string").select(F.sha2("p", 256))
    found = S.matching(accounts(spark, sf_dir), S.Search(pk_hashes=hashes, event_type=2, table="accounts"))
    return undo.statements(found, small(spark, SNAPSHOTS)).select("event_id", "statement")


ARCHIVED = "SELECT date_trunc('HOUR', event_timestamp) AS hour, count(*) AS row_count FROM cl WHERE event_timestamp < TIMESTAMP '2024-01-15 00:00:00' AND NOT (day(event_timestamp) = 3 AND hour(event_timestamp) IN (4, 5, 9)) GROUP BY 1"
LIVE = "SELECT DISTINCT date_trunc('HOUR', event_timestamp) AS hour FROM cl WHERE event_timestamp >= TIMESTAMP '2024-01-14 12:00:00'"
HOURS = f"WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-20 23:00:00', INTERVAL 1 HOUR)) AS hour), c AS (SELECT h.hour, CASE WHEN l.hour IS NOT NULL THEN 'live' WHEN a.hour IS NOT NULL THEN 'archived' ELSE 'gap' END AS status FROM h LEFT JOIN ({LIVE}) l ON l.hour = h.hour LEFT JOIN ({ARCHIVED}) a ON a.hour = h.hour)"


@query(HOURS + " SELECT hour, status FROM c")
def hour_coverage(spark, sf_dir):
    return coverage.hour_coverage(run(spark, sf_dir, LIVE), run(spark, sf_dir, ARCHIVED), "2024-01-02 00:00:00", "2024-01-21 00:00:00")


@query(HOURS + " SELECT status, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours FROM (SELECT *, CAST(epoch(hour) / 3600 AS BIGINT) - row_number() OVER (PARTITION BY status ORDER BY hour) AS g FROM c) GROUP BY status, g")
def hour_ranges(spark, sf_dir):
    return coverage.hour_ranges(hour_coverage(spark, sf_dir))


@query(HOURS + " SELECT count(*) AS hours, min(hour) AS first_hour, max(hour) AS last_hour, CAST(count(*) AS VARCHAR) || ' hours are missing between ' || strftime(min(hour), '%Y-%m-%d %H:%M') || ' and ' || strftime(max(hour), '%Y-%m-%d %H:%M') AS message FROM c WHERE status = 'gap'")
def gap_summary(spark, sf_dir):
    return coverage.gap_summary(hour_coverage(spark, sf_dir))


@query(f"SELECT * FROM (SELECT min(event_timestamp) AS first_event, max(event_timestamp) AS last_event, count(*) AS events FROM cl), (SELECT count(*) AS ddl, count(*) FILTER (event_id % 3 = 0) AS ddl_without_snapshot FROM events WHERE event_id % 8 < 6), (SELECT CAST(sum(row_count) AS BIGINT) AS archived_rows, min(hour) AS first_archived_hour FROM ({ARCHIVED}))")
def coverage_summary(spark, sf_dir):
    changes = normalise.ddl_rows(run(spark, sf_dir, DDL)).withColumn("snapshot_id", F.expr("nullif(snapshot_id, 0)"))
    return coverage.coverage_summary(accounts(spark, sf_dir), changes, run(spark, sf_dir, ARCHIVED))


@query("SELECT date_trunc('hour', event_timestamp) AS hour, count(*) AS events FROM cl GROUP BY 1")
def hour_stats(spark, sf_dir):
    return coverage.hour_stats(accounts(spark, sf_dir))


def ledger(spark, sf_dir):
    """Archived hours: every third is uploaded, every seventh waits for it."""
    n = F.hour("hour") + F.dayofmonth("hour")
    return run(spark, sf_dir, ARCHIVED).select(X.partition_name("hour").alias("partition_name"), F.lit("s1").alias("server_id"), F.when(n % 5 != 0, F.concat(F.lit("/a/server_id=s1/"), X.partition_name("hour"))).alias("local_path"), (F.col("row_count") * 100).alias("file_size_bytes"), "row_count", F.when((n % 3 == 0) | (n % 7 == 0), F.concat(F.lit("b"), (n % 2).cast("string"))).alias("s3_bucket"), F.when(n % 7 != 0, F.col("hour")).alias("s3_uploaded_at"))


LEDGER = f"SELECT strftime(hour, 'p_%Y%m%d%H') AS partition_name, hour, 's1' AS server_id, CASE WHEN n % 5 <> 0 THEN '/a/server_id=s1/' || strftime(hour, 'p_%Y%m%d%H') END AS local_path, row_count * 100 AS file_size_bytes, row_count, CASE WHEN n % 3 = 0 OR n % 7 = 0 THEN 'b' || CAST(n % 2 AS VARCHAR) END AS s3_bucket, CASE WHEN n % 7 <> 0 THEN hour END AS s3_uploaded_at FROM (SELECT *, hour(hour) + day(hour) AS n FROM ({ARCHIVED}))"


@query(f"SELECT count(*) AS files, CAST(sum(row_count) AS BIGINT) AS rows, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, count(local_path) AS local_files, count(s3_bucket) AS remote_files, string_agg(DISTINCT s3_bucket, ',' ORDER BY s3_bucket) AS buckets FROM ({LEDGER})")
def archive_stats(spark, sf_dir):
    return coverage.archive_stats(ledger(spark, sf_dir))


INGEST = "SELECT binlog_file, CASE WHEN max(event_id) % 3 = 0 THEN 'failed' WHEN max(event_id) % 3 = 1 THEN 'in_progress' ELSE 'completed' END AS status, count(*) AS events_indexed, CASE WHEN max(event_id) % 4 > 0 THEN table_name END AS server_id FROM cl GROUP BY binlog_file, table_name"


@query(f"SELECT COALESCE(server_id, '(unknown)') AS server_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'failed') AS failed, CAST(sum(events_indexed) AS BIGINT) AS events FROM ({INGEST}) GROUP BY 1")
def ingest_summary(spark, sf_dir):
    return coverage.ingest_summary(run(spark, sf_dir, INGEST))


NOW = "2024-01-31 00:30:00"
EXPIRED = "SELECT DISTINCT date_trunc('hour', event_timestamp) AS hour FROM cl WHERE date_trunc('hour', event_timestamp) < TIMESTAMP '2024-01-24 00:30:00'"


@query(EXPIRED)
def expired_hours(spark, sf_dir):
    return retention.expired_hours(coverage.hour_stats(accounts(spark, sf_dir)).select("hour"), NOW, "7 days")


@query(f"WITH e AS ({EXPIRED}), l AS ({LEDGER}) SELECT e.hour FROM e WHERE e.hour IN (SELECT hour FROM l) AND e.hour NOT IN (SELECT hour FROM l WHERE s3_bucket IS NOT NULL AND s3_uploaded_at IS NULL)")
def drop_guard(spark, sf_dir):
    return retention.droppable(expired_hours(spark, sf_dir), ledger(spark, sf_dir))


@query(f"SELECT partition_name, server_id, COALESCE(CASE WHEN row_count % 2 = 0 THEN 'new' END, s3_bucket) AS s3_bucket, row_count + 1 AS row_count FROM ({LEDGER})")
def ledger_upsert(spark, sf_dir):
    own = ledger(spark, sf_dir).select("partition_name", "server_id", "s3_bucket", "row_count")
    return retention.ledger_upsert(own, own.select("partition_name", "server_id", F.when(F.col("row_count") % 2 == 0, "new").alias("s3_bucket"), (F.col("row_count") + 1).alias("row_count")))


@query("SELECT event_id, size FROM (SELECT event_id, length(pk_values) + 200 AS size, row_number() OVER w AS n, sum(length(pk_values) + 200) OVER w AS held FROM cl WINDOW w AS (ORDER BY event_timestamp DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n <= 5000 AND held <= 600000")
def retention_caps(spark, sf_dir):
    log = accounts(spark, sf_dir).withColumn("size", F.length("pk_values").cast("long") + 200)
    return retention.newest(log, 5000, 600_000).select("event_id", "size")


SERVERS = "SELECT 's' || CAST(c_custkey AS VARCHAR(9)) AS server_id, 'u' || CAST(c_custkey AS VARCHAR(9)) AS server_uuid, 'h' || CAST(c_custkey AS VARCHAR(9)) AS host, CAST(3306 AS INT) AS port, 'app' AS username FROM customer WHERE c_custkey % 5 <> 4"
SEEN = "SELECT c_custkey AS observation_id, 'u' || CAST(CASE WHEN c_custkey % 5 = 2 THEN c_custkey + 1000000 ELSE c_custkey END AS VARCHAR(9)) AS server_uuid, 'h' || CAST(CASE WHEN c_custkey % 5 = 1 THEN c_custkey + 2000000 WHEN c_custkey % 5 = 3 THEN c_custkey - 2 ELSE c_custkey END AS VARCHAR(9)) AS host, CAST(3306 AS INT) AS port, 'app' AS username FROM customer"


@query("SELECT c_custkey AS observation_id, CASE c_custkey % 5 WHEN 0 THEN 'no_change' WHEN 1 THEN 'migration' WHEN 2 THEN 'uuid_regen' WHEN 3 THEN 'conflict' ELSE 'new' END AS outcome, CASE WHEN c_custkey % 5 < 3 THEN 's' || CAST(c_custkey AS VARCHAR) END AS server_id, CASE c_custkey % 5 WHEN 1 THEN 'host' WHEN 2 THEN 'server_uuid' END AS field FROM customer")
def identity_resolve(spark, sf_dir):
    out = identity.resolve(run(spark, sf_dir, SEEN), run(spark, sf_dir, SERVERS))
    return out.select("observation_id", "outcome", "server_id", F.get("changes", F.lit(0))["field"].alias("field"))


USAGE = "SELECT 'db' || CAST(s_nationkey AS VARCHAR(9)) AS constraint_schema, 'fk' || CAST(s_suppkey AS VARCHAR(9)) AS constraint_name, 'supplier' AS table_name, 's_nationkey' AS column_name, CAST(1 AS INT) AS ordinal_position, CASE WHEN s_suppkey % 4 > 0 THEN 'nation' END AS referenced_table, 'n_nationkey' AS referenced_column FROM supplier"
CONSTRAINTS = "SELECT 'db' || CAST(s_nationkey AS VARCHAR(9)) AS constraint_schema, 'fk' || CAST(s_suppkey AS VARCHAR(9)) AS constraint_name, CASE WHEN s_suppkey % 3 = 0 THEN 'CASCADE' ELSE 'RESTRICT' END AS update_rule, CASE WHEN s_suppkey % 5 = 0 THEN 'CASCADE' ELSE 'RESTRICT' END AS delete_rule FROM supplier"


@query(f"SELECT u.*, update_rule, delete_rule FROM ({USAGE}) u JOIN ({CONSTRAINTS}) c ON c.constraint_schema = u.constraint_schema AND c.constraint_name = u.constraint_name WHERE referenced_table IS NOT NULL")
def fk_rows(spark, sf_dir):
    return identity.foreign_key_rows(run(spark, sf_dir, USAGE), run(spark, sf_dir, CONSTRAINTS))


@query(f"SELECT * FROM ({CONSTRAINTS}) WHERE (update_rule = 'CASCADE' OR delete_rule = 'CASCADE') AND constraint_schema IN ('db1', 'db2', 'db3')")
def fk_cascades(spark, sf_dir):
    return identity.cascades(run(spark, sf_dir, CONSTRAINTS), ["db1", "db2", "db3"])


TABLE_ROWS = "SELECT 'db' AS schema_name, 't' || CAST(c_custkey AS VARCHAR(9)) AS table_name, CASE WHEN c_custkey % 11 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type, CASE WHEN c_custkey % 6 = 0 THEN 'MyISAM' ELSE 'InnoDB' END AS engine FROM customer"
COLUMN_ROWS = "SELECT 'db' AS schema_name, 't' || CAST(c_custkey AS VARCHAR(9)) AS table_name, 'id' AS column_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'PRI' END AS column_key FROM customer"


@query("SELECT 'db' AS schema_name, 't' || CAST(c_custkey AS VARCHAR) AS table_name, problem FROM (SELECT c_custkey, 'engine' AS problem FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 'no primary key' FROM customer WHERE c_custkey % 4 = 0) WHERE c_custkey % 11 <> 0")
def table_validation(spark, sf_dir):
    return identity.table_violations(run(spark, sf_dir, TABLE_ROWS), run(spark, sf_dir, COLUMN_ROWS))


@query(f"SELECT 's1' AS server_id, event_id, event_timestamp, schema_name, table_name, event_type, sha256(pk_values) AS pk_hash, CASE WHEN event_type = 2 THEN array_to_string({CHANGED}, ',') END AS changed FROM cl")
def split_metadata(spark, sf_dir):
    out = normalise.split_metadata(accounts(spark, sf_dir), "s1")
    return out.withColumn("changed", F.array_join("changed_columns", ",")).drop("changed_columns")


@query("SELECT event_id, event_timestamp, pk_values, sha256(pk_values) AS pk_hash, row_before, row_after, 's1' AS server_id, schema_name || '.' || table_name AS schema_table, CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS date FROM cl")
def split_payload(spark, sf_dir):
    return normalise.split_payload(accounts(spark, sf_dir), "s1").withColumn("date", F.col("date").cast("string"))


@query("SELECT DISTINCT strftime(ts, 'p_%Y%m%d%H') AS partition_name, date_trunc('hour', ts) AS hour FROM events")
def partition_name(spark, sf_dir):
    names = run(spark, sf_dir, "SELECT ts FROM events").select(X.partition_name("ts").alias("partition_name")).distinct()
    return names.withColumn("hour", X.partition_time("partition_name"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 62167219200 AS seconds, date_trunc('second', ts) AS back FROM events")
def to_seconds(spark, sf_dir):
    own = run(spark, sf_dir, "SELECT event_id, ts FROM events").select("event_id", X.to_seconds("ts").alias("seconds"))
    return own.withColumn("back", X.from_to_seconds("seconds"))


@query(f"SELECT {LISTED} FROM cl WHERE event_timestamp BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'")
def archive_round_trip(spark, sf_dir):
    root = shared_folder(spark)
    archive.write_archive(accounts(spark, sf_dir), root, "s1")
    return archive.read_archive(spark, root, S.Search(since="2024-01-05 06:00:00", until="2024-01-09 18:30:00")).select(COLS)


@query(f"SELECT {LISTED} FROM cl")
def stream_ingest(spark, sf_dir):
    from tidemark.streaming import ingest

    root = shared_folder(spark)
    log = accounts(spark, sf_dir).select(COLS)
    for part in ("a", "b"):  # the second copy is a replay
        log.repartition(4, "event_id").write.parquet(f"{root}/in/{part}")
    feed = ingest.read_feed(spark, f"{root}/in/*", log.schema, 3)
    ingest.ingest(ingest.replay_dedup(feed, ["event_id"], "400 days"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(COLS)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus || '''\\' AS status, CAST(NULL AS VARCHAR) AS nothing FROM orders")
def dump_sql_read(spark, sf_dir):
    root = shared_folder(spark)
    rows = run(spark, sf_dir, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders").select("o_orderkey", "o_custkey", F.concat("o_orderstatus", F.lit("'\\")).alias("status"), F.lit(None).cast("string").alias("nothing"))
    dumps.write_dump(rows, root, "shop", "orders", "CREATE TABLE `orders` (`o_orderkey` int)", "2024-01-01 00:00:00", rows_per_file=2000)
    files = dumps.discover_dump(spark, root).filter("schema_name = 'shop' AND table_name = 'orders'").first().data_files
    return dumps.read_sql_dump(spark, [f"{root}/{f}" for f in files]).select(*[F.col("values")[i].alias(c) for i, c in enumerate(rows.columns)])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority || chr(9) || '\\' AS priority, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status FROM orders")
def dump_tab_read(spark, sf_dir):
    root = shared_folder(spark)
    rows = run(spark, sf_dir, "SELECT CAST(o_orderkey AS STRING) AS k, o_orderpriority, o_orderstatus, o_orderkey FROM orders")
    text = F.concat_ws("\t", "k", F.concat("o_orderpriority", F.lit("\\t\\\\")), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).otherwise("\\N"))
    rows.select(text).write.text(root)
    return dumps.read_tab_dump(spark, root).select(F.col("values")[0].alias("o_orderkey"), F.col("values")[1].alias("priority"), F.col("values")[2].alias("status"))


FEED = """SELECT event_id, CAST('f1' AS STRING) AS binlog_file, event_id * 100 + 99 AS end_pos, 99L AS event_size, unix_timestamp(ts) AS epoch, '' AS gtid, 0L AS connection_id,
CAST(1 AS INT) AS schema_version, 'app' AS schema_name, CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE 'accounts' END AS table_name, CAST(1 + event_id % 3 AS INT) AS event_type,
array(array(CAST(event_id AS STRING), event_type, CAST(user_id AS STRING)), array(CAST(event_id + 1 AS STRING), event_type, CAST(user_id + CASE WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS STRING))) AS rows FROM events"""
IMAGE = "concat('{\"amount\":', CAST(event_id + i AS VARCHAR), ',\"kind\":\"', event_type, '\",\"user_id\":', CAST(user_id + CASE WHEN event_id % 3 = 1 THEN 0 ELSE i END AS VARCHAR), '}')"


@query("SELECT event_id, 'unknown_table' AS reject FROM events WHERE event_id % 10 = 0")
def rejected_feed(spark, sf_dir):
    return normalise.normalise(run(spark, sf_dir, FEED), small(spark, SNAPSHOTS))[1].select("event_id", "reject")


#: Tenths of a unit, half up, as text.
TENTHS = "CAST((n * 10 + {0} // 2) // {0} // 10 AS VARCHAR) || '.' || CAST((n * 10 + {0} // 2) // {0} % 10 AS VARCHAR)"


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'UPDATE' ELSE 'UNKNOWN(' || CAST(event_id + 10 AS VARCHAR) || ')' END AS name, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN {TENTHS.format(1024)} || ' KB' WHEN n < 1073741824 THEN {TENTHS.format(1048576)} || ' MB' ELSE {TENTHS.format(1073741824)} || ' GB' END AS size FROM (SELECT event_id, event_id * 300 AS n FROM events)")
def display_names(spark, sf_dir):
    code = F.when(F.col("event_id") % 2 == 0, F.lit(2)).otherwise(F.col("event_id").cast("int") + 10)
    return run(spark, sf_dir, "SELECT event_id FROM events").select("event_id", X.event_type_name(code).alias("name"), X.human_bytes(F.col("event_id") * 300).alias("size"))


#: Three keys of 6, 4 and 7 letters, a number or null, a text and a number.
IMAGE_SIZE = "COALESCE(3 * 64 + 17 + CASE WHEN json_type(json_extract({0}, '$.amount')) = 'NULL' THEN 0 ELSE 8 END + strlen(json_extract_string({0}, '$.kind')) + 8, 0)"


@query(f"SELECT event_id, CAST(264 + strlen(pk_values) + {IMAGE_SIZE.format('row_before')} + {IMAGE_SIZE.format('row_after')} AS BIGINT) AS size FROM cl")
def row_sizes(spark, sf_dir):
    return accounts(spark, sf_dir).select("event_id", X.row_size("row_before", "row_after", "pk_values").alias("size"))


@query("SELECT event_id, CASE WHEN length(row_after) > 20 THEN left(row_after, 19) || '…' ELSE row_after END AS shown FROM cl")
def truncated_images(spark, sf_dir):
    return accounts(spark, sf_dir).select("event_id", X.truncate_text("row_after", 20).alias("shown"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS whole, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS millis, CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS unknown FROM events")
def canonical_keys(spark, sf_dir):
    """Key values as text by their source type; without a known precision the value decides."""
    ts = F.col("ts").cast("timestamp")
    forms = (("whole", F.col("event_id"), "bigint", "bigint"), ("day", ts, "date", "date"), ("seconds", ts, "datetime", "datetime"), ("millis", ts, "datetime", "datetime(3)"), ("unknown", ts, "datetime", ""))
    return run(spark, sf_dir, "SELECT event_id, ts FROM events").select("event_id", *[X.canonical_key(c, kind, full).alias(name) for name, c, kind, full in forms])


@query("SELECT DISTINCT '/a/b' AS root, table_name AS server, date_trunc('hour', event_timestamp) AS hour, date_trunc('second', event_timestamp) AS moment FROM cl")
def archive_paths(spark, sf_dir):
    """Paths of archive files and snapshot folders, taken apart again."""
    t = F.col("event_timestamp")
    path = F.concat(F.lit("/a/b/server_id="), F.col("table_name"), F.date_format(t, "'/event_date='yyyy-MM-dd'/event_hour='HH'/part-0.parquet'"))
    own = accounts(spark, sf_dir).select(path.alias("path"), F.date_format(t, "yyyy-MM-dd'T'HH-mm-ss'Z'").alias("folder")).distinct()
    root, server, hour = X.archive_path("path")
    return own.select(root.alias("root"), server.alias("server"), hour.alias("hour"), X.dir_time("folder").alias("moment"))


# A catalogue of one table for each supplier, in a schema for each nation.
CATALOGUE = """SELECT CAST(s_nationkey % 3 + 1 AS INT) AS snapshot_id, CASE WHEN s_nationkey % 5 = 0 THEN 'mysql' ELSE 'n' || CAST(s_nationkey AS VARCHAR(9)) END AS schema_name,
't' || CAST(s_suppkey AS VARCHAR(9)) AS table_name, column_name, CASE WHEN column_name = 'total' THEN 'STORED GENERATED' WHEN s_suppkey % 2 = 0 THEN '' END AS extra
FROM supplier CROSS JOIN (SELECT 'id' AS column_name UNION ALL SELECT 'name' UNION ALL SELECT 'total') AS c"""
KEYS = "SELECT CAST(s_nationkey % 3 + 1 AS INT) AS snapshot_id, 'fk' || CAST(s_suppkey % 40 AS VARCHAR(9)) AS constraint_name FROM supplier WHERE s_nationkey % 3 <> 1"


@query(f"SELECT c.snapshot_id, count(DISTINCT schema_name || '.' || table_name) AS tables, count(*) AS columns, COALESCE(max(k.n), 0) AS foreign_keys FROM ({CATALOGUE}) c LEFT JOIN (SELECT snapshot_id, count(DISTINCT constraint_name) AS n FROM ({KEYS}) GROUP BY 1) k ON k.snapshot_id = c.snapshot_id GROUP BY 1")
def snapshot_stats(spark, sf_dir):
    return coverage.snapshot_stats(run(spark, sf_dir, CATALOGUE), run(spark, sf_dir, KEYS))


@query(f"SELECT 4 AS snapshot_id, schema_name, table_name, column_name, CAST(COALESCE(extra, '') LIKE '%GENERATED%' AS INT) AS is_generated, TIMESTAMP '{AT}' AS snapshot_time FROM ({CATALOGUE}) WHERE schema_name <> 'mysql'")
def schema_snapshot(spark, sf_dir):
    """A catalogue as the next snapshot; the three of before are numbered 1 to 3."""
    catalogue = run(spark, sf_dir, CATALOGUE)
    return normalise.schema_snapshot(catalogue.drop("snapshot_id"), catalogue.select("snapshot_id"), AT).select("snapshot_id", "schema_name", "table_name", "column_name", "is_generated", "snapshot_time")


TABLE_FLAGS = "SELECT 'n' || CAST(s_nationkey AS VARCHAR(9)) AS schema_name, 't' || CAST(s_suppkey AS VARCHAR(9)) AS table_name, CASE WHEN s_suppkey % 3 = 0 THEN 'name' ELSE '' END AS column_name, CASE WHEN s_suppkey % 2 = 0 THEN 'pii' ELSE 'billing' END AS flag FROM supplier"


@query(f"SELECT schema_name, table_name, column_name, flag FROM ({TABLE_FLAGS}) WHERE flag = 'pii'")
def list_flags(spark, sf_dir):
    return policy.list_flags(run(spark, sf_dir, TABLE_FLAGS), flag="pii")


GRANTS = "SELECT s_nationkey AS profile_id, 'f' || CAST(s_suppkey AS VARCHAR(9)) AS flag, CASE WHEN s_suppkey % 2 = 0 THEN 'deny' ELSE 'allow' END AS permission FROM supplier"


@query(f"SELECT n_name AS profile, flag, permission FROM ({GRANTS}) JOIN nation ON n_nationkey = profile_id")
def list_access(spark, sf_dir):
    return policy.list_access(run(spark, sf_dir, GRANTS), run(spark, sf_dir, "SELECT n_nationkey AS id, n_name AS name FROM nation"))


@query("SELECT 's' || CAST(c_custkey AS VARCHAR) AS server_id, CASE c_custkey % 5 WHEN 1 THEN 'host' ELSE 'server_uuid' END AS field, CASE c_custkey % 5 WHEN 1 THEN 'h' ELSE 'u' END || CAST(c_custkey AS VARCHAR) AS old, CASE c_custkey % 5 WHEN 1 THEN 'h' || CAST(c_custkey + 2000000 AS VARCHAR) ELSE 'u' || CAST(c_custkey + 1000000 AS VARCHAR) END AS new FROM customer WHERE c_custkey % 5 IN (1, 2)")
def identity_audit(spark, sf_dir):
    return identity.audit_rows(identity.resolve(run(spark, sf_dir, SEEN), run(spark, sf_dir, SERVERS)))


UUIDS = "SELECT event_id, ts AS event_timestamp, 's' || CAST(user_id % 50 AS VARCHAR(9)) AS server_id, 'u' || CAST(CAST(floor(event_id / 100) AS BIGINT) AS VARCHAR(20)) AS server_uuid FROM events"


@query(f"SELECT event_id, server_id, server_uuid, previous_uuid FROM (SELECT *, lag(server_uuid) OVER (PARTITION BY server_id ORDER BY event_timestamp, event_id) AS previous_uuid FROM ({UUIDS})) WHERE server_uuid <> previous_uuid")
def source_replaced(spark, sf_dir):
    from tidemark.streaming import ingest

    return ingest.identity_changes(run(spark, sf_dir, UUIDS)).select("event_id", "server_id", "server_uuid", "previous_uuid")


VERSIONS = "SELECT binlog_file, end_pos + 50 AS end_pos, CAST(event_id % 1000 + 5 AS INT) AS snapshot_id, CASE WHEN event_id % 4 = 0 THEN 'TRUNCATE TABLE' ELSE 'ALTER TABLE' END AS ddl_type FROM cl WHERE event_id % 50 < 3"


@query(f"WITH v AS (SELECT * FROM ({VERSIONS}) WHERE ddl_type <> 'TRUNCATE TABLE') SELECT c.event_id, COALESCE(v.snapshot_id, 1) AS schema_version FROM cl c ASOF LEFT JOIN v ON v.binlog_file = c.binlog_file AND v.end_pos <= c.end_pos")
def schema_versions(spark, sf_dir):
    """The version of each event by the schema changes before it in its log file."""
    from tidemark.streaming import ingest

    return ingest.schema_versions(accounts(spark, sf_dir), run(spark, sf_dir, VERSIONS), 1).select("event_id", "schema_version")


@query(f"SELECT DISTINCT binlog_file FROM cl WHERE binlog_file NOT IN (SELECT binlog_file FROM ({INGEST}) WHERE status = 'completed')")
def pending_files(spark, sf_dir):
    from tidemark.streaming import ingest

    return ingest.pending_files(accounts(spark, sf_dir).select("binlog_file").distinct(), run(spark, sf_dir, INGEST))


@query("SELECT CAST(length(bin(n)) - 1 AS INT) AS size_class, count(*) AS batches FROM (SELECT count(*) AS n FROM cl GROUP BY date_trunc('hour', event_timestamp)) GROUP BY 1")
def batch_sizes(spark, sf_dir):
    """Hours stand for batches."""
    from tidemark.streaming import ingest

    return ingest.batch_sizes(hour_stats(spark, sf_dir).select(F.col("events").alias("rows")))


@query(f"SELECT event_id FROM cl WHERE date_trunc('hour', event_timestamp) NOT IN (SELECT hour FROM ({LEDGER}))")
def beyond_known(spark, sf_dir):
    """Events in hours that the ledger doesn't list."""
    hours = ledger(spark, sf_dir).select(X.partition_time("partition_name").alias("hour"))
    return retention.beyond_known(accounts(spark, sf_dir), hours).select("event_id")


@query(f"SELECT {LISTED} FROM cl WHERE event_timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def recent_events(spark, sf_dir):
    return retention.recent(accounts(spark, sf_dir), NOW, "10 days").select(COLS)


@query("WITH m AS (SELECT *, CASE WHEN event_id % 5 = 0 AND event_type = 2 THEN pk_values || 'x' END AS moved FROM cl) SELECT event_id, event_type, pk_values, row_before, row_after FROM m WHERE moved IS NULL UNION ALL SELECT event_id, 3, pk_values, row_before, NULL FROM m WHERE moved IS NOT NULL UNION ALL SELECT event_id, 1, moved, NULL, row_after FROM m WHERE moved IS NOT NULL")
def key_moves(spark, sf_dir):
    """Updates that change the key become a DELETE and an INSERT."""
    new = F.when(F.col("event_id") % 5 == 0, F.concat("pk_values", F.lit("x")))
    return timetravel.split_pk_moves(accounts(spark, sf_dir), new).select("event_id", "event_type", "pk_values", "row_before", "row_after")


STATES_AT = "2024-01-20 12:00:00"


@query(f"SELECT table_name, pk_values, row_after AS row_image FROM (SELECT *, row_number() OVER (PARTITION BY table_name, pk_values ORDER BY event_timestamp DESC, event_id DESC) AS r FROM cl WHERE event_timestamp <= TIMESTAMP '{STATES_AT}') WHERE r = 1 AND event_type <> 3")
def states_at(spark, sf_dir):
    """Several tables, none with a snapshot, at one moment."""
    log = accounts(spark, sf_dir)
    done, failed = timetravel.states_at({t: (None, log.filter(F.col("table_name") == t)) for t in ("accounts", "wallets")}, STATES_AT)
    if failed:
        raise RuntimeError(str(failed))
    own = [df.select(F.lit(t).alias("table_name"), "pk_values", "row_image") for t, df in done.items()]
    return own[0].unionByName(own[1])


@query(MERGED + f", r AS (SELECT count(*) FILTER (action = 'passthrough') AS passthrough, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'deleted') AS deleted, sum(n) AS events FROM m UNION ALL SELECT 0, 0, count(*) FILTER (event_type <> 3), 0, sum(n) FROM (SELECT event_type, table_name, count(*) OVER (PARTITION BY table_name, pk_values) AS n, row_number() OVER (PARTITION BY table_name, pk_values ORDER BY event_timestamp DESC, event_id DESC) AS r FROM cl WHERE event_timestamp <= TIMESTAMP '{STATES_AT}') WHERE r = 1 GROUP BY table_name) SELECT count(*) AS tables, CAST(sum(passthrough) AS BIGINT) AS passthrough, CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(deleted) AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS invalid, CAST(sum(events) AS BIGINT) AS events FROM r")
def run_totals(spark, sf_dir):
    """The totals of a run over three tables, two of them without a snapshot."""
    log = accounts(spark, sf_dir)
    nothing = log.select("pk_values", F.lit("").alias("row_image")).limit(0)
    own = [timetravel.report(nothing, timetravel.of_table(log, "app", t), STATES_AT) for t in ("accounts", "wallets")]
    return coverage.run_totals([reconstruct_report(spark, sf_dir), *own])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def snapshot_search(spark, sf_dir):
    """A search over the typed columns of a snapshot."""
    s = S.Search(column_eq=[("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")])
    assert S.snapshot_reason(s) is None
    return run(spark, sf_dir, "SELECT * FROM orders").filter(S.snapshot_filter(s)).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp, CASE event_type WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS event_type, '[\"amount\"]' AS changed_columns FROM cl")
def result_listing(spark, sf_dir):
    """Events as a listing shows them."""
    log = accounts(spark, sf_dir).withColumn("changed_columns", F.array(F.lit("amount")))
    return S.result_columns(log).select("event_id", "event_timestamp", "event_type", "changed_columns")


@query("SELECT event_id, pk_values, sha256(pk_values) AS pk_hash, row_before, row_after, schema_name || '.' || table_name AS schema_table FROM cl")
def stream_split_sinks(spark, sf_dir):
    """A stream that writes metadata and payloads apart; read again and joined."""
    from tidemark.streaming import ingest

    root = shared_folder(spark)
    log = accounts(spark, sf_dir)
    files = max(4, width(spark, sf_dir))
    log.repartition(files, "event_id").write.parquet(f"{root}/in")
    write = ingest.split_sinks("s1", f"{root}/metadata", f"{root}/payload")
    feed = ingest.read_feed(spark, f"{root}/in", log.schema, -(-files // 2))
    feed.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    full = spark.read.parquet(f"{root}/payload").select("event_id", "pk_values", "row_before", "row_after", "schema_table")
    return spark.read.parquet(f"{root}/metadata").select("event_id", "pk_hash").join(full, "event_id")


@query("SELECT DISTINCT 'orders' AS table_name, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS snapshot_time FROM orders")
def baseline_discovery(spark, sf_dir):
    """Snapshots found by their folders, one for each year of orders."""
    root = shared_folder(spark)
    orders = run(spark, sf_dir, "SELECT o_orderkey, o_custkey, year(o_orderdate) AS year FROM orders")
    for r in orders.select("year").distinct().collect():
        orders.filter(F.col("year") == r.year).write.parquet(f"{root}/{r.year}-01-01T00-00-00Z/shop/orders")
    return baseline.discover(spark, root).select("table_name", "snapshot_time")


@query(f"SELECT {LISTED} FROM cl WHERE schema_name = 'app' AND table_name = 'wallets'")
def included_tables(spark, sf_dir):
    return normalise.included(accounts(spark, sf_dir), ["app"], ["app.wallets", "shop.orders"]).select(COLS)


@query("SELECT event_id, event_id * 100 AS start_pos, date_trunc('second', ts) AS event_timestamp, gtid IS NULL AS no_gtid, connection_id IS NULL AS no_connection FROM (SELECT event_id, ts, CAST(NULL AS VARCHAR) AS gtid, CAST(NULL AS BIGINT) AS connection_id FROM events)")
def stamped_feed(spark, sf_dir):
    out = normalise.stamped(run(spark, sf_dir, FEED))
    return out.select("event_id", "start_pos", "event_timestamp", F.col("gtid").isNull().alias("no_gtid"), F.col("connection_id").isNull().alias("no_connection"))


TEXTS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR(20)) END AS n, CASE WHEN event_id % 4 = 0 THEN '2024-13-01' ELSE '2024-02-' || lpad(CAST(event_id % 29 + 1 AS VARCHAR(9)), 2, '0') END AS d, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id AS VARCHAR(20)) || '.25' END AS f FROM events"


@query(f"SELECT event_id, TRY_CAST(n AS INT) AS n, TRY_CAST(d AS DATE) AS d, TRY_CAST(f AS DOUBLE) AS f FROM ({TEXTS})")
def typed_values(spark, sf_dir):
    """Text as typed values; what can't be read is null."""
    return run(spark, sf_dir, TEXTS).select("event_id", baseline.typed("n", "int", "int"), baseline.typed("d", "date"), baseline.typed("f", "double"))


NUMBERS = "SELECT event_id, CAST(event_id % 25 AS INT) - 12 AS k FROM events"


@query(f"SELECT event_id, CASE WHEN event_id = 0 THEN '0' WHEN k >= 0 THEN CAST(event_id AS VARCHAR) || repeat('0', k) ELSE rtrim(rtrim(CAST(event_id // CAST(power(10, -k) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(event_id % CAST(power(10, -k) AS BIGINT) AS VARCHAR), -k, '0'), '0'), '.') END AS literal FROM ({NUMBERS})")
def number_literals(spark, sf_dir):
    """Numbers written with exponents, as literals without."""
    text = F.concat(F.col("event_id").cast("string"), F.lit("e"), F.col("k").cast("string"))
    return run(spark, sf_dir, NUMBERS).select("event_id", X.sql_literal(F.parse_json(text)).alias("literal"))


@query(f"WITH h AS (SELECT pk_values, TIMESTAMP '{SNAPSHOT_TIME}' AS t, CAST(0 AS BIGINT) AS event_id, 'baseline' AS source, row_image AS state FROM bl UNION ALL SELECT pk_values, event_timestamp, event_id, 'log', CASE WHEN event_type <> 3 THEN row_after END FROM co WHERE event_timestamp <= TIMESTAMP '{AT}') SELECT pk_values, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS time, source, event_id, '' AS gtid, COALESCE(json_extract_string(state, '$.o_orderkey'), '') AS o_orderkey, COALESCE(json_extract_string(state, '$.price_cents'), '') AS price_cents, COALESCE(json_extract_string(state, '$.status'), '') AS status FROM h")
def history_csv(spark, sf_dir):
    return timetravel.history_table(row_history(spark, sf_dir))


@query(f"SELECT event_id, '{{\"time\":\"' || strftime(event_timestamp, '%Y-%m-%dT%H:%M:%SZ') || '\",\"source\":\"log\",\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"state\":' || CASE WHEN event_type <> 3 THEN row_after ELSE 'null' END || '}}' AS text FROM co WHERE event_timestamp <= TIMESTAMP '{AT}' UNION ALL SELECT 0, '{{\"time\":\"' || strftime(TIMESTAMP '{SNAPSHOT_TIME}', '%Y-%m-%dT%H:%M:%SZ') || '\",\"source\":\"baseline\",\"state\":' || row_image || '}}' FROM bl")
def history_json(spark, sf_dir):
    return timetravel.history_json(row_history(spark, sf_dir)).select("event_id", "text")


@query(MERGED + " SELECT pk_values, k AS column_name, json_extract_string(row_image, '$.' || k) AS value FROM m, (VALUES ('o_orderkey'), ('price_cents'), ('status')) AS c(k) WHERE action NOT IN ('none', 'deleted')")
def state_listing(spark, sf_dir):
    return timetravel.state_pairs(state_at(spark, sf_dir))


@query(f"SELECT schema_name, table_name, pk_values, row_after AS row_image FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name, pk_values ORDER BY event_timestamp DESC, event_id DESC) AS r FROM cl WHERE event_timestamp <= TIMESTAMP '{STATES_AT}') WHERE r = 1 AND event_type <> 3")
def states_of_log(spark, sf_dir):
    return timetravel.states_of(accounts(spark, sf_dir), STATES_AT)


@query(f"SELECT event_timestamp, event_type, pk_values, row_after FROM co WHERE event_timestamp BETWEEN TIMESTAMP '{SNAPSHOT_TIME}' AND TIMESTAMP '{AT}' UNION ALL SELECT TIMESTAMP '{SNAPSHOT_TIME}', 6, pk_values, row_image FROM bl")
def search_with_snapshot(spark, sf_dir):
    """A log and a snapshot as one source; the snapshot's own time counts."""
    rows = timetravel.snapshot_events(orders_baseline(spark, sf_dir), "shop", "orders", SNAPSHOT_TIME)
    return S.search(orders_log(spark, sf_dir), S.Search(table="orders", since=SNAPSHOT_TIME, until=AT), [rows]).select("event_timestamp", "event_type", "pk_values", "row_after")


@query(f"SELECT event_type, count(*) AS events FROM co WHERE event_type = 2 AND event_timestamp <= TIMESTAMP '{AT}' GROUP BY 1")
def search_without_snapshot(spark, sf_dir):
    """A search for a kind of change leaves the snapshot out."""
    rows = timetravel.snapshot_events(orders_baseline(spark, sf_dir), "shop", "orders", SNAPSHOT_TIME)
    return S.search(orders_log(spark, sf_dir), S.Search(event_type=2, until=AT), [rows]).groupBy("event_type").agg(F.count("*").alias("events"))


@query(f"SELECT {LISTED} FROM cl")
def archive_sources(spark, sf_dir):
    """Two archives, one of which lacks a column; a third that can't be read is passed over."""
    root = shared_folder(spark)
    log = accounts(spark, sf_dir)
    archive.write_archive(log.filter("table_name = 'wallets'"), f"{root}/a", "s1")
    archive.write_archive(log.filter("table_name = 'accounts'").drop("connection_id"), f"{root}/b", "s2")
    good, bad = archive.usable(spark, [f"{root}/a", f"{root}/none", f"{root}/b"])
    assert list(bad) == [f"{root}/none"]
    return S.merge_sources([archive.read_archive(spark, r) for r in good]).select(COLS)


@query(f"SELECT hour FROM ({EXPIRED}) WHERE hour NOT IN (SELECT hour FROM ({LEDGER}) WHERE s3_bucket IS NOT NULL AND s3_uploaded_at IS NULL)")
def rotation(spark, sf_dir):
    """Expired hours that are archived, counted and let go; those that wait for an upload stay."""
    return retention.rotate(accounts(spark, sf_dir), ledger(spark, sf_dir), shared_folder(spark), "s1", NOW, "7 days")[0]


@query(f"SELECT strftime(hour, 'p_%Y%m%d%H') AS partition_name, CAST(row_count AS BIGINT) AS row_count FROM ({LEDGER}) UNION SELECT strftime(hour, 'p_%Y%m%d%H'), n FROM (SELECT date_trunc('hour', event_timestamp) AS hour, count(*) AS n FROM cl GROUP BY 1) WHERE hour < TIMESTAMP '2024-01-24 00:30:00' AND hour NOT IN (SELECT hour FROM ({LEDGER}))")
def rotation_ledger(spark, sf_dir):
    """The ledger after a run."""
    return retention.rotate(accounts(spark, sf_dir), ledger(spark, sf_dir), shared_folder(spark), "s1", NOW, "7 days")[1].select("partition_name", "row_count")


@query(f"SELECT {LISTED} FROM cl WHERE event_timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def recent_sink(spark, sf_dir):
    """The recent events, written as a buffer's file and read again."""
    root = shared_folder(spark)
    retention.write_recent(accounts(spark, sf_dir).withColumn("size", X.row_size("row_before", "row_after", "pk_values")), root, NOW, "10 days")
    return spark.read.parquet(root).select(COLS)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def baseline_row(spark, sf_dir):
    """A snapshot's row by its key; here the last one."""
    orders = run(spark, sf_dir, "SELECT * FROM orders")
    return baseline.row(orders, {"o_orderkey": orders.agg(F.max("o_orderkey")).first()[0]}).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'ddl' ELSE 'log' END AS sink FROM cl WHERE event_id % 10 <> 1")
def stream_route(spark, sf_dir):
    """A stream with DDL and transaction records among the changes; each batch is written twice, as after a failure."""
    from tidemark.streaming import ingest

    root = shared_folder(spark)
    kind = F.when(F.col("event_id") % 10 == 0, 4).when(F.col("event_id") % 10 == 1, 5).otherwise(F.col("event_type"))
    log = accounts(spark, sf_dir).withColumn("event_type", kind)
    files = max(4, width(spark, sf_dir))
    log.repartition(files, "event_id").write.parquet(f"{root}/in")
    write = ingest.route(f"{root}/log", f"{root}/ddl")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    ingest.read_feed(spark, f"{root}/in", log.schema, -(-files // 2)).writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    own = [spark.read.parquet(f"{root}/{sink}").select("event_id", F.lit(sink).alias("sink")) for sink in ("log", "ddl")]
    return own[0].unionByName(own[1])


@query("SELECT date_trunc('hour', event_timestamp) AS hour, count(*) AS events FROM cl GROUP BY 1")
def status_listing(spark, sf_dir):
    return coverage.listing(hour_stats(spark, sf_dir), "-events", "hour")


ROOTS = "SELECT partition_name, 's' || CAST(row_count % 4 AS VARCHAR(9)) AS server_id, row_count % 3 AS place FROM ({LEDGER})"


@query(f"SELECT server_id, CASE WHEN count(*) FILTER (place > 0) > 0 THEN '/a' ELSE 's3a://b/a' END AS root FROM ({ROOTS.format(LEDGER=LEDGER)}) GROUP BY 1")
def archive_roots(spark, sf_dir):
    """One root for each server of a ledger, the local one if any file has one."""
    server = F.concat(F.lit("s"), (F.col("row_count") % 4).cast("string"))
    path = F.concat(F.lit("a/server_id="), server, F.date_format(X.partition_time("partition_name"), "'/event_date='yyyy-MM-dd'/event_hour='HH'/part-0.parquet'"))
    own = ledger(spark, sf_dir).select(server.alias("server_id"), F.when(F.col("row_count") % 3 > 0, F.concat(F.lit("/"), path)).alias("local_path"), F.lit("b").alias("s3_bucket"), path.alias("s3_key"))
    return archive.archive_roots(own)


def dumped(spark, sf_dir) -> str:
    """A dump of three tables, the orders of each status."""
    root = shared_folder(spark)
    orders = run(spark, sf_dir, "SELECT * FROM orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    for status in "FOP":
        create = "CREATE TABLE `orders` (\n  `o_orderkey` bigint unsigned NOT NULL,\n  `o_totalprice` decimal(12,2),\n  PRIMARY KEY (`o_orderkey`)\n)"
        dumps.write_dump(orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"), root, "shop", f"orders_{status.lower()}", create, "2024-01-01 06:30:00", "mysql-bin.000007", last, f"u:1-{last}", rows_per_file=5000)
    return root


@query("SELECT DISTINCT 'shop' AS schema_name, 'orders_' || lower(o_orderstatus) AS table_name, 'shop.orders_' || lower(o_orderstatus) || '-schema.sql' AS schema_file, 'shop.orders_' || lower(o_orderstatus) || '.00000.sql' AS first_file FROM orders")
def dump_discovery(spark, sf_dir):
    out = dumps.discover_dump(spark, dumped(spark, sf_dir))
    return out.select("schema_name", "table_name", "schema_file", F.get("data_files", F.lit(0)).alias("first_file"))


@query("SELECT TIMESTAMP '2024-01-01 06:30:00' AS started, 'mysql-bin.000007' AS binlog_file, max(o_orderkey) AS binlog_pos, 'u:1-' || CAST(max(o_orderkey) AS VARCHAR) AS gtid_set FROM orders")
def dump_coordinates(spark, sf_dir):
    return dumps.dump_coordinates(spark, f"{dumped(spark, sf_dir)}/metadata")


@query("SELECT file, position, column_name, data_type, column_type FROM (SELECT DISTINCT 'shop.orders_' || lower(o_orderstatus) || '-schema.sql' AS file FROM orders), (VALUES (CAST(1 AS INT), 'o_orderkey', 'bigint', 'bigint unsigned'), (2, 'o_totalprice', 'decimal', 'decimal(12,2)')) AS c(position, column_name, data_type, column_type)")
def dump_columns(spark, sf_dir):
    return dumps.table_columns(spark, f"{dumped(spark, sf_dir)}/*-schema.sql")


@query("SELECT table_name, TIMESTAMP '2024-01-01 00:00:00' AS snapshot_time, 'mysql-bin.000007' AS binlog_file, pos AS binlog_pos, rows FROM (SELECT 'orders_' || lower(o_orderstatus) AS table_name, max(o_orderkey) AS pos, count(*) AS rows FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'orders_none', 0, 0)")
def baseline_inventory(spark, sf_dir):
    """Snapshots of the orders of each status and of an empty table, with their places in the log; a second writing of one
    changes nothing."""
    root = shared_folder(spark)
    orders = run(spark, sf_dir, "SELECT * FROM orders")
    columns = [("o_orderkey", "bigint", "bigint"), ("o_totalprice", "double", "double")]
    paths = {}
    for status in "FOPF":
        own = orders.filter(F.col("o_orderstatus") == status)
        paths[status] = baseline.write_baseline(own, columns, root, "2024-01-01T00-00-00Z", "shop", f"orders_{status.lower()}", "mysql-bin.000007", own.agg(F.max("o_orderkey")).first()[0])
    paths["none"] = baseline.write_baseline(orders.limit(0), columns, root, "2024-01-01T00-00-00Z", "shop", "orders_none", "mysql-bin.000007")
    held = None
    for path in paths.values():
        one = spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(path).alias("path"), "rows")
        held = one if held is None else held.unionByName(one)
    return baseline.inventory(spark, root).join(held, "path").select("table_name", "snapshot_time", "binlog_file", "binlog_pos", "rows")


@query(HOURS + " SELECT CAST(count(*) AS VARCHAR) || ' hours are missing between ' || strftime(min(hour), '%Y-%m-%d %H:%M') || ' and ' || strftime(max(hour), '%Y-%m-%d %H:%M') AS message FROM c WHERE status = 'gap'")
def gap_policy(spark, sf_dir):
    """What a strict check of the hours says."""
    try:
        coverage.check_gaps(hour_coverage(spark, sf_dir), strict=True)
        said = None
    except coverage.GapError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "message string")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"a\":' || CAST(event_id AS VARCHAR) || '}' WHEN 1 THEN '[' || CAST(event_id AS VARCHAR) || ',\"' || event_type || '\"]' WHEN 2 THEN '\"{' || event_type || '\"' ELSE '\"' || CAST(event_id AS VARCHAR) || '\"' END AS value, '\"' || strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || '\"' AS moment FROM events")
def snapshot_values(spark, sf_dir):
    """Values of a snapshot as variants: objects and arrays as such, what only begins like one as text, times in seconds."""
    text = F.expr("CASE event_id % 4 WHEN 0 THEN '{\"a\":' || event_id || '}' WHEN 1 THEN '[' || event_id || ',\"' || event_type || '\"]' WHEN 2 THEN '{' || event_type ELSE CAST(event_id AS STRING) END")
    events = run(spark, sf_dir, "SELECT * FROM events")
    return events.select("event_id", F.to_json(X.normal_value(text)).alias("value"), F.to_json(X.normal_value(F.col("ts").cast("timestamp"), "timestamp")).alias("moment"))


@query("SELECT event_id, CASE WHEN event_type IN (2, 3) AND event_id % 3 = 0 THEN 'row_before is missing' WHEN event_type IN (1, 2) AND event_id % 5 = 0 THEN 'row_after is missing' WHEN event_id % 7 = 0 THEN 'SNAPSHOT can''t be reversed' END AS error FROM cl")
def undo_errors(spark, sf_dir):
    """Events that lack an image, or are of a kind that can't be undone, have an error and no statement."""
    i = F.col("event_id")
    kept = ~((i % 3 == 0) & F.col("event_type").isin(2, 3)) & ~((i % 5 == 0) & F.col("event_type").isin(1, 2))
    log = accounts(spark, sf_dir).withColumns({"row_before": F.when(i % 3 != 0, F.col("row_before")), "row_after": F.when(i % 5 != 0, F.col("row_after")), "event_type": F.when((i % 7 == 0) & kept, 6).otherwise(F.col("event_type"))})
    out = undo.statements(log, small(spark, SNAPSHOTS))
    return out.select("event_id", F.when(F.col("error").isNull() == F.col("statement").isNotNull(), F.col("error")).otherwise("both or none").alias("error"))


@query(f"SELECT {LISTED} FROM cl WHERE binlog_file > 'mysql-bin.100000' OR binlog_file = 'mysql-bin.100000' AND end_pos > 30000")
def stream_resume(spark, sf_dir):
    """A stream that begins behind a position, stops, and goes on with what has come since."""
    from tidemark.streaming import ingest

    root = shared_folder(spark)
    log = accounts(spark, sf_dir).select(*COLS, "binlog_file", "end_pos")
    for part, own in (("a", "event_id % 2 = 0"), ("b", "event_id % 2 = 1")):
        log.filter(own).repartition(2, "event_id").write.parquet(f"{root}/in/{part}")
        feed = ingest.start_after(ingest.read_feed(spark, f"{root}/in/*", log.schema), "mysql-bin.100000", 30000)
        ingest.ingest(feed, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(COLS)


SINCE = "1998-09-01 00:00:00"


@query(MERGED.replace("WHERE event_timestamp <=", f"WHERE event_timestamp >= TIMESTAMP '{SINCE}' AND event_timestamp <=") + " SELECT pk_values, row_image, action FROM m WHERE action NOT IN ('none', 'deleted')")
def state_since(spark, sf_dir):
    """A state from a snapshot's moment on; changes of before are in the snapshot. New rows come last, by key."""
    return timetravel.inserted_last(timetravel.state_at(orders_baseline(spark, sf_dir), orders_log(spark, sf_dir), AT, SINCE))


@query("SELECT event_id, pk_values, row_before, row_after, schema_name || '.' || table_name AS schema_table, CAST(event_timestamp AS DATE) AS date FROM cl")
def payload_sink(spark, sf_dir):
    """Full rows by server, table and day, read again."""
    root = shared_folder(spark)
    archive.write_payload(normalise.split_payload(accounts(spark, sf_dir), "s1"), root)
    return spark.read.parquet(root).select("event_id", "pk_values", "row_before", "row_after", "schema_table", "date")


from tidemark.plans import sources_and_streams  # noqa: E402, F401  the rest of the queries
