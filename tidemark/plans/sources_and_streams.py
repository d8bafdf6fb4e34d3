"""Queries over several sources, typed feeds, dumps and streams; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import normalise, timetravel, undo
from tidemark.operators import search as S
from tidemark.plans.registry import COLS, FEED, IMAGE, LISTED, SNAPSHOT_TIME, SNAPSHOTS, query, shared_folder, small
from tidemark.plans.views import accounts, orders_baseline, orders_log, run, width, with_views
from tidemark.session import checkpointed
from tidemark.sources import archive, dumps


def four_sources(spark, sf_dir):
    """A live log, two archives, of which one lacks a column, and a copy of some days; they share hours in all ways."""
    log = accounts(spark, sf_dir)
    day = F.dayofyear("event_timestamp")
    parts = [log.filter("event_id % 5 < 2"), log.filter("event_id % 3 > 0").drop("connection_id"), log.filter(day % 4 == 0), log.filter(day > 20)]
    return [p.withColumn("origin", F.lit(name)) for p, name in zip(parts, ("live", "a", "b", "c"), strict=True)]


ORIGIN = "CASE WHEN event_id % 5 < 2 THEN 'live' WHEN event_id % 3 > 0 THEN 'a' WHEN dayofyear(event_timestamp) % 4 = 0 THEN 'b' WHEN dayofyear(event_timestamp) > 20 THEN 'c' END"


@query(f"SELECT event_id, pk_values, row_after, CASE WHEN origin = 'a' THEN NULL ELSE connection_id END AS connection_id, origin FROM (SELECT *, {ORIGIN} AS origin FROM cl) WHERE origin IS NOT NULL")
def merge_four_sources(spark, sf_dir):
    return S.merge_sources(four_sources(spark, sf_dir)).select("event_id", "pk_values", "row_after", "connection_id", "origin")


@query("""SELECT hour, CAST(sum(bit) AS BIGINT) AS sources FROM (SELECT DISTINCT CAST(floor(epoch(event_timestamp) / 3600) AS BIGINT) AS hour, bit FROM cl, (VALUES (0, 1), (1, 2), (2, 4), (3, 8)) AS v(n, bit)
WHERE CASE n WHEN 0 THEN event_id % 5 < 2 WHEN 1 THEN event_id % 3 > 0 WHEN 2 THEN dayofyear(event_timestamp) % 4 = 0 ELSE dayofyear(event_timestamp) > 20 END) GROUP BY 1""")
def source_presence(spark, sf_dir):
    return S.source_presence(four_sources(spark, sf_dir))


@query(f"SELECT {LISTED} FROM (SELECT * FROM cl WHERE ({ORIGIN}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pk_values ORDER BY event_timestamp DESC, event_id DESC) <= 2) ORDER BY event_timestamp, event_id LIMIT 200")
def merge_four_and_trim(spark, sf_dir):
    return S.merge_and_trim(four_sources(spark, sf_dir), 200, 2).select(COLS)


TYPED_SNAPSHOTS = f"SELECT s.*, CASE column_name WHEN 'kind' THEN 'varchar' WHEN 'status' THEN 'char' ELSE 'bigint' END AS data_type FROM ({SNAPSHOTS}) s"


@query(f"""WITH e AS (SELECT *, event_id % 3 AS k FROM events WHERE event_id % 10 <> 0), r AS (SELECT *, unnest([0, 1]) AS i FROM e), j AS (SELECT *, {IMAGE} AS img FROM r)
SELECT event_id, i AS ordinal, CASE WHEN k = 2 THEN img END AS row_before, CASE WHEN k = 0 THEN img END AS row_after, CAST(user_id + i AS VARCHAR) AS pk_values, CAST(NULL AS VARCHAR) AS changed FROM j WHERE k <> 1
UNION ALL SELECT a.event_id, 0, a.img, b.img, CAST(a.user_id AS VARCHAR), 'amount' FROM j a JOIN j b ON a.event_id = b.event_id AND a.i = 0 AND b.i = 1 WHERE a.k = 1""")
def normalise_feed(spark, sf_dir):
    good, _ = normalise.normalise(run(spark, sf_dir, FEED), small(spark, TYPED_SNAPSHOTS))
    return good.select("event_id", "ordinal", "row_before", "row_after", "pk_values", F.array_join("changed_columns", ",").alias("changed"))


#: A table with a column of each kind, by name.
MIXED_COLUMNS = """SELECT 1 AS snapshot_id, 'app' AS schema_name, 'mixed' AS table_name, column_name, ordinal_position, column_key, 0 AS is_generated, data_type FROM (VALUES
('code',1,'PRI','varchar'),('doc',2,'','json'),('id',3,'PRI','bigint'),('note',4,'','text'),('price',5,'','decimal'),('ratio',6,'','double')) AS t(column_name, ordinal_position, column_key, data_type)"""
#: Text that looks like numbers, documents and null.
LOOKS = "CASE event_id % 6 WHEN 0 THEN '1e3' WHEN 1 THEN '123' WHEN 2 THEN ' 5' WHEN 3 THEN '[1]' WHEN 4 THEN 'null' ELSE '-0' END"
MIXED_FEED = f"""SELECT event_id, CAST('f1' AS STRING) AS binlog_file, event_id * 100 + 99 AS end_pos, 99L AS event_size, unix_timestamp(ts) AS epoch, '' AS gtid, 0L AS connection_id, CAST(1 AS INT) AS schema_version, 'app' AS schema_name, 'mixed' AS table_name, CAST(3 AS INT) AS event_type,
array(array({LOOKS}, concat('{{"n":', event_id, '}}'), CAST(event_id AS STRING), {LOOKS}, CASE WHEN event_id % 2 = 0 THEN '12.50' END, '1.5e-3')) AS rows FROM events"""


@query(f"""SELECT event_id, '{{"code":"' || t || '","doc":{{"n":' || event_id || '}},"id":' || event_id || ',"note":"' || t || '","price":' || CASE WHEN event_id % 2 = 0 THEN '"12.50"' ELSE 'null' END || ',"ratio":1.5e-3}}' AS row_before, t || '|' || event_id AS pk_values,
'INSERT INTO `app`.`mixed` (`code`, `doc`, `id`, `note`, `price`, `ratio`) VALUES (''' || t || ''', ''{{"n":' || event_id || '}}'', ' || event_id || ', ''' || t || ''', ' || CASE WHEN event_id % 2 = 0 THEN '''12.50''' ELSE 'NULL' END || ', 0.0015);' AS statement FROM (SELECT event_id, {LOOKS} AS t FROM events)""")
def typed_images(spark, sf_dir):
    """Columns of all kinds through a delete and its undo: text stays text, however much it looks like a number."""
    good, _ = normalise.normalise(run(spark, sf_dir, MIXED_FEED), small(spark, MIXED_COLUMNS))
    return undo.statements(good, small(spark, MIXED_COLUMNS), kept=["row_before", "pk_values"]).select("event_id", "row_before", "pk_values", "statement")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus || ';(''' || chr(10) || '/* ' || chr(92) AS status, 'now(3)' AS called, CASE WHEN o_orderkey % 2 = 0 THEN 'AB' END AS bin FROM orders""")
def dump_ranges_read(spark, sf_dir):
    """Dumps with comments, quotes and line feeds in their values and with binary values, in byte ranges far smaller than
    the files."""
    root = shared_folder(spark)
    rows = run(spark, sf_dir, "SELECT o_orderkey, o_orderstatus FROM orders")
    value = F.concat(F.lit("'"), "o_orderstatus", F.lit(";(''\n/* \\\\'"))
    binary = F.when(F.col("o_orderkey") % 2 == 1, "NULL").when(F.col("o_orderkey") % 4 == 0, "X'4142'").otherwise("_binary 'AB'")
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "/* it's;\n (a) */INSERT INTO `t;` VALUES (").otherwise("INSERT INTO t\nVALUES\n("), F.concat_ws(",", F.col("o_orderkey").cast("string"), value, F.lit("now(3)"), binary), F.lit(");"))
    rows.select(text).coalesce(2).write.text(root)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("65536", "0"), strict=True):
        spark.conf.set(name, value)
    try:
        read = dumps.read_sql_dump(spark, root).write.parquet(f"{root}-read")
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    read = spark.read.parquet(f"{root}-read")
    cell = lambda i: F.col("values")[i]
    return read.select(cell(0).alias("o_orderkey"), cell(1).alias("status"), cell(2).alias("called"), dumps.binary_value(cell(3)).cast("string").alias("bin"))


#: Events of a batch of the streams with state, which a few servers share.
BATCH_EVENTS = 1_000_000


#: A feed as a server sends it: transaction records, DDL with the schema version that follows, and rows.
CONTROLLED = """SELECT event_id, concat('s', CAST(user_id % 3 AS VARCHAR(9))) AS server_id, CASE WHEN event_id % 7 = 0 THEN concat('uuid', CAST(CAST(floor(event_id / 400) AS BIGINT) AS VARCHAR(9))) END AS server_uuid,
concat('bin.', CAST(CAST(floor(event_id / 150) AS BIGINT) AS VARCHAR(9))) AS binlog_file, event_id * 100 + 99 AS end_pos, CAST(99 AS BIGINT) AS event_size, ts,
CAST(CASE WHEN event_id % 7 = 0 THEN 5 WHEN event_id % 25 = 1 THEN 4 ELSE 1 END AS INT) AS event_type, CASE WHEN event_id % 7 = 0 THEN concat('u:', CAST(event_id AS VARCHAR(20))) END AS gtid,
CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN event_id END AS connection_id, CASE WHEN event_id % 7 <> 0 AND event_id % 25 = 1 THEN CASE event_id % 75 WHEN 1 THEN 'ALTER TABLE accounts ADD c int' WHEN 26 THEN 'TRUNCATE TABLE accounts' ELSE 'ALTER TABLE accounts DROP c' END END AS query,
CASE WHEN event_id % 7 <> 0 AND event_id % 25 = 1 THEN CASE WHEN event_id % 75 = 26 THEN 'TRUNCATE TABLE' ELSE 'ALTER TABLE' END END AS ddl_type, CAST(CASE WHEN event_id % 7 <> 0 AND event_id % 25 = 1 THEN CASE event_id % 75 WHEN 1 THEN 2 WHEN 26 THEN 2 ELSE 1 END END AS INT) AS snapshot_id, event_type AS kind, user_id FROM events"""
CARRIED_SQL = f"""WITH f AS ({CONTROLLED}), c AS (SELECT event_id, server_id, event_type, kind, user_id, ddl_type, last_value(gtid IGNORE NULLS) OVER file AS gtid, last_value(connection_id IGNORE NULLS) OVER file AS connection_id,
coalesce(last_value(CASE WHEN event_type = 4 AND ddl_type <> 'TRUNCATE TABLE' THEN snapshot_id END IGNORE NULLS) OVER log, 1) AS schema_version, last_value(server_uuid IGNORE NULLS) OVER (log ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_uuid, server_uuid
FROM f WINDOW file AS (PARTITION BY server_id, binlog_file ORDER BY end_pos), log AS (PARTITION BY server_id ORDER BY end_pos))"""


def controlled_feed(spark, sf_dir):
    rows = F.array(F.array(F.col("event_id").cast("string"), "kind", F.col("user_id").cast("string")))
    return run(spark, sf_dir, CONTROLLED).withColumns({"epoch": F.unix_timestamp("ts"), "schema_name": F.lit("app"), "table_name": F.when(F.col("event_type") == 1, "accounts"), "rows": F.when(F.col("event_type") == 1, rows)}).drop("ts", "kind", "user_id")


def in_parts(feed, root: str, runs: int = 3):
    """Folders of three files that each hold a stretch of the feed in its order, the last events of each again in the next as
    a replay. They hold no more events than BATCH_EVENTS, so that their number grows with the feed; a part of them is
    there when each run may begin."""
    last = feed.agg(F.max("event_id")).first()[0]
    each = max(1, -(-(last + 1) // (runs * BATCH_EVENTS)))
    n = last // (runs * each) + 1
    for i in range(runs * each):
        feed.filter((F.col("event_id") >= i * n - 20) & (F.col("event_id") < (i + 1) * n)).repartition(3).write.parquet(f"{root}/part-{i}")
        if i % each == each - 1:
            yield f"{root}/part-{i}"


@query(f"{CARRIED_SQL} SELECT event_id, server_id, gtid, nullif(connection_id, 0) AS connection_id, schema_version, concat('{{\"amount\":', event_id, ',\"kind\":\"', kind, '\",\"user_id\":', user_id, '}}') AS row_after, CASE WHEN schema_version = 2 THEN kind || '|' || user_id ELSE CAST(user_id AS VARCHAR) END AS pk_values FROM c WHERE event_type = 1")
def stream_normalise(spark, sf_dir):
    """A raw feed through a stream with state: its parts arrive one after the other, with a restart and a replay between."""
    from tidemark.streaming import ingest, stateful

    root = shared_folder(spark)
    feed = controlled_feed(spark, sf_dir)
    write = stateful.normalising(lambda s: small(s, TYPED_SNAPSHOTS), f"{root}/log", f"{root}/ddl", f"{root}/rejected")
    for _ in in_parts(feed, f"{root}/in"):
        stream = stateful.annotated_stream(ingest.read_feed(spark, f"{root}/in/*", feed.schema, 3), 1)  # files come by their times, a folder in each batch
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/log").select("event_id", "server_id", "gtid", "connection_id", "schema_version", "row_after", "pk_values")


@query(f"{CARRIED_SQL} SELECT event_id, server_id, gtid, connection_id, schema_version, previous_uuid, coalesce(server_uuid <> previous_uuid, false) AS replaced FROM c")
def annotated_feed(spark, sf_dir):
    from tidemark.streaming import stateful

    return stateful.annotated(controlled_feed(spark, sf_dir), 1).select("event_id", "server_id", "gtid", "connection_id", "schema_version", "previous_uuid", "replaced")


@query(f"SELECT {LISTED} FROM (SELECT *, 100 + event_id % 50 AS size FROM cl WHERE event_timestamp >= (SELECT max(event_timestamp) FROM cl) - INTERVAL 12 DAY) WINDOW w AS (ORDER BY event_timestamp DESC, event_id DESC) QUALIFY count(*) OVER w <= 900 AND sum(size) OVER w <= 60000")
def stream_buffer(spark, sf_dir):
    """The newest events within an age, a number and a size, after a stream has brought all of them in no order."""
    from tidemark.streaming import ingest, stateful

    root = shared_folder(spark)
    log = accounts(spark, sf_dir).select(*COLS, (100 + F.col("event_id") % 50).alias("size"))
    files = max(6, width(spark, sf_dir))
    log.repartition(files, "event_id").write.parquet(f"{root}/in")
    buffer = stateful.Buffer(f"{root}/buffer", "12 days", 900, 60000)
    ingest.read_feed(spark, f"{root}/in", log.schema, files // 3).writeStream.foreachBatch(buffer).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return buffer.read(spark, log.schema).select(COLS)


@query("""SELECT sum(n) AS rows, sum(n) AS received, sum(n) AS indexed, max(m) AS last_event FROM (SELECT count(*) AS n, max(event_timestamp) AS m FROM cl)""")
def stream_progress(spark, sf_dir):
    """The totals of the progress table of a stream over the whole log."""
    import time

    from tidemark.streaming import ingest

    root = shared_folder(spark)
    log = accounts(spark, sf_dir).select(COLS)
    log.repartition(5).write.parquet(f"{root}/in")
    progress = ingest.Progress(spark, f"{root}/progress", at_once=2)
    spark.streams.addListener(progress)
    try:
        ingest.ingest(ingest.observed(ingest.read_feed(spark, f"{root}/in", log.schema, 2)), f"{root}/out", f"{root}/checkpoint").awaitTermination()
        for _ in range(100):  # listeners hear of a batch a little later
            if sum(r[2] or 0 for r in progress.rows) >= spark.read.parquet(f"{root}/out").count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    progress.flush()
    return spark.read.parquet(f"{root}/progress").agg(*[F.sum(c).alias(c) for c in ("rows", "received", "indexed")], F.max("last_event").alias("last_event"))


STATE_SQL = """SELECT coalesce(b.pk_values, c.pk_values) AS pk_values, CASE WHEN c.pk_values IS NULL THEN b.row_image ELSE c.row_after END AS row_image
FROM bl b FULL JOIN (SELECT * FROM co WHERE event_timestamp <= TIMESTAMP '{0}' QUALIFY row_number() OVER (PARTITION BY pk_values ORDER BY event_timestamp DESC, event_id DESC) = 1) c ON c.pk_values = b.pk_values WHERE c.pk_values IS NULL OR c.event_type <> 3"""
#: Moments below, between, on and above the rungs.
MOMENTS = ("1998-01-20 00:00:00", "1998-04-10 00:00:00", "1998-07-01 00:00:00", "1999-06-01 00:00:00")


@query(" UNION ALL ".join(f"SELECT '{m}' AS at, * FROM ({with_views(STATE_SQL.format(m))})" for m in MOMENTS))
def ladder_states(spark, sf_dir):
    """The state at some moments by a ladder of five rungs."""
    from functools import reduce

    from tidemark.operators.ladder import Ladder

    log = checkpointed(orders_log(spark, sf_dir))  # a log that lies there, as all climbs and states read it
    ladder = Ladder(spark, shared_folder(spark))
    ladder.start(orders_baseline(spark, sf_dir), SNAPSHOT_TIME)
    for month in (2, 3, 4, 5, 7):
        ladder.climb(log, f"1998-{month:02d}-01 00:00:00")
    return reduce(lambda x, y: x.unionByName(y), [ladder.state_at(log, m).select(F.lit(m).alias("at"), "pk_values", "row_image") for m in MOMENTS])


@query(f"SELECT {LISTED} FROM cl WHERE table_name = 'wallets' ORDER BY event_timestamp, event_id LIMIT 60")
def first_n_by_hours(spark, sf_dir):
    """The oldest that match, from the shortest stretch of hours that holds them."""
    root = shared_folder(spark)
    archive.write_archive(accounts(spark, sf_dir), root, "s1")
    log = archive.read_archive(spark, root)
    hours = log.groupBy(F.date_trunc("hour", "event_timestamp").alias("hour")).agg(F.count("*").alias("events"))
    return S.first_n_of_hours(log, 60, hours, S.Search(table="wallets")).select(COLS)


@query(f"SELECT {LISTED} FROM cl WHERE pk_values IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_id % 97 = 0)")
def key_search_in_sorted_archive(spark, sf_dir):
    """Rows by key from an archive in order of keys with bloom filters."""
    root = shared_folder(spark)
    archive.write_archive(accounts(spark, sf_dir), root, "s1", by_key=True)
    keys = run(spark, sf_dir, "SELECT DISTINCT CAST(user_id AS STRING) AS pk FROM events WHERE event_id % 97 = 0")
    return S.matching(archive.read_archive(spark, root), S.Search(pk_in=keys)).select(COLS)


@query(f"SELECT {LISTED}, CASE WHEN event_timestamp < TIMESTAMP '2024-01-24 00:00:00' THEN 'archive' ELSE 'live' END AS place FROM cl")
def rotation_transaction(spark, sf_dir):
    """A live log after three rotations: one that stops before its hours are listed, one whole, and one after late events."""
    from tidemark.operators.rotation import Rotation

    root = shared_folder(spark)
    log = checkpointed(accounts(spark, sf_dir))
    archive.write_archive(log.filter("event_id % 10 > 0"), f"{root}/live", "s1")
    rotation = Rotation(spark, f"{root}/live", f"{root}/archive", "s1")

    def stop(phase):
        if phase == "counted":
            raise InterruptedError(phase)

    try:
        rotation.run("2024-01-31 00:00:00", "7 days", stop)
    except InterruptedError:
        rotation.run("2024-01-31 00:00:00", "7 days")
    late = log.filter("event_id % 10 = 0")
    late = late.withColumns({"server_id": F.lit("s1"), "event_date": F.to_date("event_timestamp"), "event_hour": F.hour("event_timestamp")})
    late.select(*archive.columns(late), *archive.PARTITIONS).write.partitionBy(*archive.PARTITIONS).mode("append").parquet(f"{root}/live")
    rotation.run("2024-01-31 00:00:00", "7 days")
    live = archive.read_archive(spark, f"{root}/live").select(*COLS, F.lit("live").alias("place"))
    return live.unionByName(rotation.archived().select(*COLS, F.lit("archive").alias("place")))


@query(f"SELECT pk_values, row_image FROM ({STATE_SQL.format('1999-06-01 00:00:00')})")
def state_in_dump_order(spark, sf_dir):
    """A state as a dump has it, rows of the snapshot before new ones; a test looks at the order."""
    return timetravel.inserted_last(timetravel.state_at(orders_baseline(spark, sf_dir), orders_log(spark, sf_dir), "1999-06-01 00:00:00")).select("pk_values", "row_image")
