"""Small cases: literals, key forms, sources, merging, streaming, and laws between operators."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import coverage, gtid, identity, normalise, policy, retention, timetravel, undo
from tidemark.operators import search as S
from tidemark.plans.registry import SNAPSHOTS
from tidemark.plans.views import accounts, orders_baseline, orders_log
from tidemark.sources import archive, baseline, dumps
from tidemark.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("json", "want"), [("1", "1"), ("1.50", "1.5"), ("2.0", "2"), ("12345678901234567890", "12345678901234567890"), ("1e20", "100000000000000000000"), ("1.5e-12", "0.0000000000015"), ("1e40", "1" + "0" * 40), ("-2.50e1", "-25"), ("-0.0", "0"), ("true", "1"), ("false", "0"), ("null", "NULL"), ('"a\'b\\\\c"', "'a\\'b\\\\c'"), ('{"a":1}', "'{\"a\":1}'"), ("[1,2]", "'[1,2]'")])
def test_literals(spark, json, want):
    assert one(spark, X.sql_literal(F.parse_json(F.lit(json)))) == want


def test_endless_numbers(spark):
    """A typed column with such a number raises; an event with one has an error and leaves the others alone."""
    with pytest.raises(Exception, match="not a finite number"):
        one(spark, X.typed_literal(F.lit(float("inf")), "double"))
    rows = [(1, 3, '{"id":1,"v":3e400}'), (2, 3, '{"id":2,"v":3e200}')]
    log = spark.createDataFrame(rows, "event_id long, event_type int, row_before string").selectExpr("*", "CAST(NULL AS STRING) AS row_after", "'s' AS schema_name", "'t' AS table_name", "'1' AS pk_values", "timestamp'2024-01-01' AS event_timestamp", "1 AS schema_version")
    got = {r.event_id: r for r in undo.statements(log, spark.sql(SNAPSHOTS)).collect()}
    assert got[1].statement is None and got[1].error == "a number is not finite" and got[2].error is None and got[2].statement.endswith("3" + "0" * 200 + ");")


def test_empty_script(spark, sf_dir):
    assert [r.text for r in undo.script(accounts(spark, sf_dir).filter("false"), spark.sql(SNAPSHOTS)).collect()] == ["-- Nothing to undo."]


def test_typed_literals(spark):
    assert one(spark, X.typed_literal(F.lit(b"\x01\xff"), "binary")) == "X'01FF'"
    assert one(spark, X.typed_literal(F.lit("2024-01-02 03:04:05.006").cast("timestamp"), "timestamp")) == "'2024-01-02 03:04:05.006000'"
    assert one(spark, X.typed_literal(F.lit(None).cast("int"), "int")) == "NULL"
    assert one(spark, X.escape_string(F.lit("a\\b'c\0"))) == "a\\\\b\\'c\\0"


@pytest.mark.parametrize(("value", "data_type", "column_type", "want"), [("5", "int", "int", "5"), ("2024-01-02", "date", "date", "2024-01-02"), ("2024-01-02 03:04:05.1234", "datetime", "datetime(3)", "2024-01-02 03:04:05.123"), ("2024-01-02 03:04:05", "datetime", "datetime", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05.5", "timestamp", "", "2024-01-02 03:04:05.500000"), ("1.50", "decimal", "decimal(5,2)", "1.50"), ("x", "enum", "enum('x')", "x")])
def test_canonical_keys(spark, value, data_type, column_type, want):
    kind = {"int": "int", "date": "date", "datetime": "timestamp", "timestamp": "timestamp"}.get(data_type, "string")
    assert one(spark, X.canonical_key(F.lit(value).cast(kind), data_type, column_type)) == want


def test_canonical_key_refuses_blobs():
    with pytest.raises(ValueError):
        X.canonical_key(F.lit(b"x"), "blob")


def test_names_and_sizes(spark):
    assert one(spark, X.human_bytes(F.lit(1536))) == "1.5 KB" and one(spark, X.human_bytes(F.lit(5 << 30))) == "5.0 GB"
    assert one(spark, X.truncate_text(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, X.partition_time(F.lit("p_bad"))) is None
    assert one(spark, X.dir_time(F.lit("2026-02-28T00-30-00Z"))) == datetime(2026, 2, 28, 0, 30)
    root, server, hour = X.archive_path(F.lit("/a/b/server_id=s1/event_date=2024-01-02/event_hour=3/x.parquet"))
    assert (one(spark, root), one(spark, server), one(spark, hour)) == ("/a/b", "s1", datetime(2024, 1, 2, 3))
    assert one(spark, X.row_size(F.lit('{"a":1,"b":2}'), F.lit(None).cast("string"))) == 410
    assert one(spark, F.to_json(X.normal_value(F.lit('{"a":1}')))) == '{"a":1}' and one(spark, F.to_json(X.normal_value(F.lit("{x")))) == '"{x"'


def test_null_is_not_missing(spark):
    df = spark.createDataFrame([('{"a":null}',), ("{}",), ('{"a":"NULL"}',), (None,)], "j string")
    assert [r.x for r in df.select(X.json_is_null("j", "a").alias("x")).collect()] == [True, False, False, False]


def test_snapshot_exclusion():
    assert S.snapshot_reason(S.Search()) is None and S.snapshot_reason(S.Search(event_type=6)) is None
    for s in (S.Search(event_type=1), S.Search(gtid="x"), S.Search(changed_column="a")):
        assert S.snapshot_reason(s)
    with pytest.raises(ValueError):
        S.snapshot_filter(S.Search(column_eq=[("a;b", "1")]))
    with pytest.raises(ValueError):
        S.parse_time("yesterday")


def test_merge_keeps_the_first_source(spark):
    a = spark.createDataFrame([(1, "live")], "event_id long, v string")
    b = spark.createDataFrame([(1, "old", 5), (2, "old", 6)], "event_id long, v string, extra int")
    assert {tuple(r) for r in S.merge_sources([a, b]).collect()} == {(1, "live", None), (2, "old", 6)}


def test_state_is_the_fold_of_history(spark, sf_dir):
    at = "1999-06-01"
    base, log = orders_baseline(spark, sf_dir), orders_log(spark, sf_dir)
    folded = {}
    for r in timetravel.history(base, log, "1998-01-01", at).orderBy("event_timestamp", "event_id").collect():
        folded[r.pk_values] = r.state
    got = {r.pk_values: r.row_image for r in timetravel.state_at(base, log, at).collect()}
    assert got == {k: v for k, v in folded.items() if v is not None}


def test_time_travel_cases(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "pk_values string, row_image string")
    t = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, t, 2, "2", "b2"), (2, t, 3, "3", None), (3, t, 1, "4", "d"), (4, t, 2, "1", None), (5, t, 1, "5", "e"), (6, t, 3, "5", None)], "event_id long, event_timestamp timestamp, event_type int, pk_values string, row_after string")
    assert {tuple(r) for r in timetravel.state_at(base, log, "2024-01-02").collect()} == {("2", "b2", "updated"), ("4", "d", "inserted")}
    assert timetravel.report(base, log, "2024-01-02").first().asDict() == {"passthrough": 0, "updated": 1, "inserted": 1, "deleted": 1, "invalid": 1, "events": 6}
    with pytest.raises(KeyError):
        timetravel.row_state_at(base, log, ["9"], "2024-01-02", strict=True)
    done, failed = timetravel.states_at({"a": (base, log), "b": (None, log), "c": (log, log)}, "2024-01-02")
    assert set(done) == {"a", "b"} and set(failed) == {"c"} and done["b"].count() == 2
    moved = log.withColumn("row_before", F.lit("x")).filter("event_id = 1")
    assert {(r.event_type, r.pk_values) for r in timetravel.split_pk_moves(moved, F.lit("9")).collect()} == {(3, "2"), (1, "9")}


def test_undo_errors(spark):
    rows = [(1, datetime(2024, 1, 1), "app", "accounts", 3, "1", None, None, 1), (2, datetime(2024, 1, 1), "app", "accounts", 6, "1", None, "{}", 1), (3, datetime(2024, 1, 1), "app", "accounts", 1, "1", None, '{"user_id":1}', 99)]
    log = spark.createDataFrame(rows, "event_id long, event_timestamp timestamp, schema_name string, table_name string, event_type int, pk_values string, row_before string, row_after string, schema_version int")
    out = {r.event_id: r for r in undo.statements(log, spark.sql(SNAPSHOTS)).collect()}
    assert out[1].statement is None and out[1].error and out[2].error and out[2].statement is None
    assert out[3].statement == "DELETE FROM `app`.`accounts` WHERE `user_id` = 1;"  # the latest version's key isn't whole here


def test_policy_lists(spark):
    from tidemark.plans.registry import FLAGS, PROFILES, RULES

    assert [r.flag for r in policy.list_flags(spark.sql(FLAGS), table="wallets").collect()] == ["billing"]
    assert policy.list_access(spark.sql(RULES), spark.sql(PROFILES), "dev").count() == 1


def test_gaps(spark):
    hours = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in (0, 1, 4)], "hour timestamp")
    found = coverage.hour_coverage(hours, hours.limit(0), "2024-01-01 00:00:00", "2024-01-01 05:00:00")
    with pytest.raises(coverage.GapError):
        coverage.check_gaps(found, strict=True)
    with pytest.warns(UserWarning):
        coverage.check_gaps(found, strict=False)
    assert coverage.open_range(hours, hours) is None and coverage.open_range(hours, hours, since=None, until=1)[0] == datetime(2024, 1, 1)


def test_gtid_sets(spark):
    spans = gtid.parse_sets(spark.createDataFrame([("u:1-5:7,v:3",)], "s string"), "s")
    assert {tuple(r) for r in spans.collect()} == {("u", 1, 5), ("u", 7, 7), ("v", 3, 3)}
    other = gtid.parse_sets(spark.createDataFrame([("u:1-3:4-5:7, v:3",)], "s string"), "s")
    assert gtid.sets_equal(spans, other) and not gtid.sets_equal(spans, other.limit(1))


@pytest.mark.parametrize("seed", range(3))
def test_intervals_unite_across_blocks(spark, seed):
    import random

    chance = random.Random(seed)
    spans = [(u, lo, lo + chance.choice((0, 1, 3, 40))) for u in "uv" for lo in chance.sample(range(300), 40)]
    want = set()
    for u in "uv":
        held = sorted({n for v, lo, hi in spans if v == u for n in range(lo, hi + 1)})
        starts = [n for n in held if n - 1 not in set(held)]
        want |= {(u, a, next(n for n in range(a, 10_000) if n + 1 not in set(held))) for a in starts}
    out = gtid.joined(spark.createDataFrame(spans, "uuid string, lo long, hi long"), block=16)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_keys_of_several_tables_raise(spark):
    rows = [(1, datetime(2024, 1, 1), "a", t, 2, "k", "{}") for t in ("t", "u")]
    log = spark.createDataFrame(rows, "event_id long, event_timestamp timestamp, schema_name string, table_name string, event_type int, pk_values string, row_after string")
    start = spark.createDataFrame([], "pk_values string, row_image string")
    with pytest.raises(Exception, match="several tables have the key k"):
        timetravel.state_at(start, log, "2024-01-02").collect()
    assert timetravel.state_at(start, timetravel.of_table(log, "a", "t"), "2024-01-02").count() == 1


def test_foreign_keys_and_totals(spark):
    snaps = spark.sql(SNAPSHOTS)
    keys = spark.createDataFrame([(1, "fk")], "snapshot_id int, constraint_name string")
    assert {tuple(r) for r in coverage.snapshot_stats(snaps, keys).collect()} == {(1, 3, 9, 1), (2, 2, 6, 0)}
    report = spark.createDataFrame([(1, 2)], "updated long, deleted long")
    assert tuple(coverage.run_totals([report, report]).first()) == (2, 2, 4)
    assert identity.audit_rows(spark.sql("SELECT 's' AS server_id, array(named_struct('field','host','old','a','new','b')) AS changes")).count() == 1


def test_normalise_rejects(spark):
    feed = spark.createDataFrame([(1, "app", "accounts", 1, [["1", "k", "5"], ["x"]]), (1, "app", "none", 1, [["1"]])], "schema_version int, schema_name string, table_name string, event_type int, rows array<array<string>>")
    assert {r.reject for r in normalise.with_columns(feed, spark.sql(SNAPSHOTS)).collect()} == {"column_count_mismatch", "unknown_table"}
    assert normalise.included(feed, ["app"], ["app.none"]).count() == 1


def test_schema_snapshot(spark):
    catalogue = spark.createDataFrame([("app", "t", "a", "STORED GENERATED"), ("mysql", "u", "b", "")], "schema_name string, table_name string, column_name string, extra string")
    row = normalise.schema_snapshot(catalogue, spark.sql(SNAPSHOTS), "2024-01-01").first()
    assert (row.snapshot_id, row.is_generated, row.table_name) == (3, 1, "t")


def test_archive_tolerates_old_files(spark, sf_dir, tmp_path):
    log = accounts(spark, sf_dir)
    archive.write_archive(log.drop("connection_id"), str(tmp_path / "a"), "s1")
    log.limit(5).coalesce(1).write.parquet(str(tmp_path / "loose"))
    out = archive.read_archive(spark, str(tmp_path / "a"), loose=[str(tmp_path / "loose")])
    assert out.count() == log.count() + 5 and out.filter("server_id IS NOT NULL AND connection_id IS NOT NULL").count() == 0
    good, bad = archive.usable(spark, [str(tmp_path / "a"), str(tmp_path / "none")])
    assert len(good) == len(bad) == 1
    with pytest.raises(OSError):
        archive.usable(spark, [str(tmp_path / "none")], strict=True)


def test_baseline_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "2024-01-01 00:00:00"), ("bad", None, "x")], "id string, name string, at string")
    columns = [("id", "int", "int"), ("name", "varchar", "varchar(5)"), ("at", "datetime", "datetime")]
    path = baseline.write_baseline(rows, columns, str(tmp_path), "2026-02-28T00-00-00Z", "app", "t", "f1", 5)
    assert baseline.write_baseline(rows.limit(0), columns, str(tmp_path), "2026-02-28T00-00-00Z", "app", "t") == path
    own = spark.read.parquet(path)
    assert {r.id for r in own.collect()} == {1, None} and dict(own.dtypes)["at"] == "timestamp"
    assert [r.table_name for r in baseline.inventory(spark, str(tmp_path)).collect()] == ["t"]
    found = baseline.discover(spark, str(tmp_path)).first()
    assert (found.schema_name, found.table_name, found.snapshot_time) == ("app", "t", datetime(2026, 2, 28))
    keyed = {r.pk_values: r.row_image for r in baseline.keyed(own, [("id", "int", "int")]).collect()}
    assert keyed["<nil>"] == '{"at":null,"id":null,"name":null}'
    with pytest.raises(ValueError):
        baseline.keyed(own, [("none", "int", "int")])
    assert baseline.spark_type("int", "int unsigned") == "bigint" and baseline.spark_type("decimal") == "string"


def test_dump_reading(spark, tmp_path):
    (tmp_path / "app.t.00000.sql").write_text("INSERT INTO `t` VALUES\n(1,'a''b\\'c\\n(;)',NULL,X'0aff'),\n(-2.5,'NULL',now(3),\"q\");\n")
    (tmp_path / "app.t-schema.sql").write_text("CREATE TABLE `t` (\n  `id` int(11) unsigned NOT NULL,\n  `v` varchar(9),\n  PRIMARY KEY (`id`)\n);\n")
    (tmp_path / "app.v-schema-view.sql").write_text("x")
    (tmp_path / "metadata").write_text("Started dump at: 2024-01-01 00:00:00\nSHOW MASTER STATUS:\n\tLog: bin.1\n\tPos: 42\n\tGTID: u:1-5\n")
    got = [r["values"] for r in dumps.read_sql_dump(spark, str(tmp_path / "app.t.00000.sql")).collect()]
    assert got == [["1", "a'b'c\n(;)", None, "X'0aff'"], ["-2.5", "NULL", "now(3)", "q"]]
    assert [tuple(r) for r in dumps.discover_dump(spark, str(tmp_path)).collect()] == [("app", "t", "app.t-schema.sql", ["app.t.00000.sql"])]
    assert tuple(dumps.dump_coordinates(spark, str(tmp_path / "metadata")).first()) == (datetime(2024, 1, 1), "bin.1", 42, "u:1-5")
    assert [(r.column_name, r.data_type, r.column_type) for r in dumps.table_columns(spark, str(tmp_path / "app.t-schema.sql")).collect()] == [("id", "int", "int(11) unsigned"), ("v", "varchar", "varchar(9)")]


def test_dump_line_ends(spark, tmp_path):
    """CRLF, comments, and line breaks and semicolons inside quotes lose no statement; an open quote raises."""
    text = "/*!40101 SET NAMES binary*/;\r\n-- it's; here\r\nINSERT INTO `a;b` VALUES\r\n(1,'x;\ny'),\r\n(2,\"q;\");\r\nINSERT INTO t VALUES (3,'it''s');"
    (tmp_path / "a.b.00000.sql").write_bytes(text.encode())
    got = [r["values"] for r in dumps.read_sql_dump(spark, str(tmp_path / "a.b.00000.sql")).collect()]
    assert got == [["1", "x;\ny"], ["2", "q;"], ["3", "it's"]]
    (tmp_path / "bad.sql").write_text("INSERT INTO t VALUES (1,'open);\n")
    with pytest.raises(Exception, match="not closed"):
        dumps.read_sql_dump(spark, str(tmp_path / "bad.sql")).collect()


def test_dump_round_trip(spark, tmp_path):
    rows = spark.range(25).selectExpr("CAST(id AS INT) AS id", "concat('v;', chr(10), id) AS v", "CASE WHEN id % 2 = 0 THEN 1.5e-9D * id END AS d").repartition(3)
    for _ in range(2):  # a second dump takes the place of the first
        names = dumps.write_dump(rows, str(tmp_path), "app", "t", "CREATE TABLE `t` (`id` int)", "2024-01-01 00:00:00", "bin.7", 99, "u:1-5", 4, 8)
    assert sorted(names) == sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("."))
    found = dumps.discover_dump(spark, str(tmp_path)).first()
    assert (found.schema_name, found.table_name, found.schema_file) == ("app", "t", "app.t-schema.sql") and found.data_files == sorted(n for n in names if n.endswith("0.sql") or "schema" not in n and n != "metadata")
    got = {tuple(r["values"]) for r in dumps.read_sql_dump(spark, [str(tmp_path / n) for n in found.data_files]).collect()}
    assert len(got) == 25 and ("2", "v;\n2", "0.000000003") in got and ("3", "v;\n3", None) in got
    assert tuple(dumps.dump_coordinates(spark, str(tmp_path / "metadata")).first()) == (datetime(2024, 1, 1), "bin.7", 99, "u:1-5")


def test_merge_leaves_images_of_other_hours(spark, sf_dir):
    """Of sources that share no hour, no image is shuffled."""
    log = accounts(spark, sf_dir)
    halves = [log.filter("event_timestamp < '2024-01-15'"), log.filter("event_timestamp >= '2024-01-15'")]
    assert S.merge_sources(halves).count() == log.count()
    a = spark.createDataFrame([(1, datetime(2024, 1, 1, 5), "a", "{}"), (2, datetime(2024, 1, 1, 6), "a", "{}")], "event_id long, event_timestamp timestamp, origin string, row_after string")
    b = spark.createDataFrame([(2, datetime(2024, 1, 1, 6), "b"), (3, datetime(2024, 1, 1, 6), "b"), (4, datetime(2024, 1, 1, 9), "b"), (5, None, "b")], "event_id long, event_timestamp timestamp, origin string")
    assert sorted((r.event_id, r.origin) for r in S.merge_sources([a, b]).collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")]
    limited = S.merge_and_trim([a, b], limit=3)
    assert [r.event_id for r in limited.collect()] == [5, 1, 2]


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_merge_of_six_sources(spark, tmp_path):
    """At most three scans a source, lone hours outside any exchange, and the first source wins, whatever hours are shared."""
    rng = random.Random(4)
    events = {i: datetime(2024, 1, 1, rng.randrange(12)) for i in range(300)}
    held = []
    for n in range(6):
        own = [(i, t, f"s{n}", "x" * 10) for i, t in events.items() if t.hour % 6 == n or t.hour < 8 and rng.random() < 0.4] + [(None, None, f"s{n}", "y")]
        held.append(own)
        spark.createDataFrame(own, "event_id long, event_timestamp timestamp, origin string, row_after string").write.parquet(str(tmp_path / str(n)))
    sources = [spark.read.parquet(str(tmp_path / str(n))) for n in range(6)]
    merged = S.merge_sources(sources)
    assert scans(merged) <= 3 * 6
    first = {}
    for own in held:
        for i, _, origin, _ in own:
            if i is not None:
                first.setdefault(i, origin)
    got = sorted((r.event_id, r.origin) for r in merged.collect() if r.event_id is not None)
    assert got == sorted(first.items()) and merged.filter("event_id IS NULL").count() == 6
    assert sorted((r.event_id, r.origin) for r in S.merge_sources(sources, by_hour=False).filter("event_id IS NOT NULL").collect()) == got
    alone = [s.filter(f"hour(event_timestamp) = {8 + n}") for n, s in enumerate(sources[:4])]
    assert "Exchange hashpartitioning" not in S.merge_sources(alone)._jdf.queryExecution().executedPlan().toString()


def test_merge_sends_no_image_of_lone_hours(spark, tmp_path):
    """Of rows whose hour no other source has, none goes through the exchange."""
    for n, hours in enumerate((range(10), range(9, 20))):
        spark.range(2000).selectExpr(f"id * 2 + {n} AS event_id", f"timestamp_seconds(1704067200 + 3600 * ({hours.start} + id % {len(hours)})) AS event_timestamp", "repeat('x', 50) AS row_after").write.parquet(str(tmp_path / str(n)))
    merged = S.merge_sources([spark.read.parquet(str(tmp_path / str(n))) for n in range(2)])
    assert merged.count() == 4000
    merged.write.format("noop").mode("overwrite").save()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan or "SortAggregate" in plan
    shared = merged.filter("hour(event_timestamp) = 9").count()
    assert 0 < shared < 500 and S.source_presence([spark.read.parquet(str(tmp_path / str(n))) for n in range(2)]).filter("sources = 3").count() == 1


def test_baseline_pick_meets_few_rows(spark):
    """A table of many snapshots and requests over years: as a plain search has it, and without a row more than went in."""
    rng = random.Random(9)
    moments = [datetime(2020 + rng.randrange(4), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24)) for _ in range(300)]
    have = [("s", rng.choice("tuv"), t, f"p{i}") for i, t in enumerate(moments[:200])]
    asked = [("s", rng.choice("tuvw"), t) for t in [*moments[100:], datetime(2019, 1, 1), datetime(2030, 1, 1), moments[0]]]
    picked = timetravel.pick_baseline(spark.createDataFrame(have, "schema_name string, table_name string, snapshot_time timestamp, path string"), spark.createDataFrame(asked, "schema_name string, table_name string, at timestamp"))
    want = []
    for s, t, at in asked:
        best = max(((x[2], x[3]) for x in have if x[1] == t and x[2] <= at), default=(None, None))
        want.append((s, t, at, *best))
    assert sorted(map(tuple, picked.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in str(picked._jdf.queryExecution().optimizedPlan().toString()).split("Join LeftOuter", 1)[0]



def test_state_output(spark):
    entries = spark.createDataFrame([("1", datetime(2024, 1, 1), 0, "baseline", '{"a":1,"time":"x"}'), ("1", datetime(2024, 1, 2), 7, "log", '{"a":null,"b":"q"}'), ("1", datetime(2024, 1, 3), 8, "log", None)], "pk_values string, event_timestamp timestamp, event_id long, source string, state string")
    table = timetravel.history_table(entries)
    assert table.columns == ["pk_values", "time", "source", "event_id", "gtid", "a", "b", "state_time"]
    assert [tuple(r)[5:] for r in table.orderBy("event_id").collect()] == [("1", "", "x"), ("", "q", ""), ("", "", "")]
    assert [r.text for r in timetravel.history_json(entries).orderBy("event_id").collect()] == ['{"time":"2024-01-01T00:00:00Z","source":"baseline","state":{"a":1,"time":"x"}}', '{"time":"2024-01-02T00:00:00Z","source":"log","event_id":7,"state":{"a":null,"b":"q"}}', '{"time":"2024-01-03T00:00:00Z","source":"log","event_id":8,"state":null}']
    state = spark.createDataFrame([("9", "n", "inserted"), ("5", "o", "passthrough"), ("10", "n", "inserted")], "pk_values string, row_image string, action string")
    assert [r.pk_values for r in timetravel.inserted_last(state).collect()] == ["5", "10", "9"]


def test_sources_by_name(spark, tmp_path):
    ledger = spark.createDataFrame([("s1", None, "b", "x/server_id=s1/event_date=2024-01-01/event_hour=3/p.parquet"), ("s1", "/d/server_id=s1/event_date=2024-01-01/event_hour=3/p.parquet", None, None), ("s2", None, "b", "y/server_id=s2/event_date=2024-01-01/event_hour=3/p.parquet")], "server_id string, local_path string, s3_bucket string, s3_key string")
    assert {tuple(r) for r in archive.archive_roots(ledger).collect()} == {("s1", "/d"), ("s2", "s3a://b/y")}
    payload = spark.createDataFrame([(1, "s1", "app.t", "2024-01-01")], "event_id long, server_id string, schema_table string, date string")
    archive.write_payload(payload, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("schema_table = 'app.t'").count() == 1
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert [r.v for r in baseline.row(rows, {"id": "2"}).collect()] == ["b"]
    with pytest.raises(ValueError, match="nope"):
        baseline.row(rows, {"nope": 1})
    assert one(spark, F.to_json(X.normal_value(F.lit("2024-01-02 03:04:05.678").cast("timestamp"), "timestamp"))) == '"2024-01-02 03:04:05"'


def test_retention(spark, sf_dir):
    log = accounts(spark, sf_dir)
    hours = coverage.hour_stats(log).select("hour")
    assert retention.beyond_known(log, hours).count() == 0 and retention.beyond_known(log, hours.limit(0)).count() == log.count()
    assert retention.recent(log, "2024-02-01 00:00:00", "1 day").filter("event_timestamp < '2024-01-31'").count() == 0


def test_streaming(spark, sf_dir, tmp_path):
    log = accounts(spark, sf_dir)
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    feed = ingest.start_after(ingest.read_feed(spark, str(tmp_path / "in"), log.schema, 1), "mysql-bin.099999", 0)
    progress = ingest.Progress(spark, str(tmp_path / "progress"))
    spark.streams.addListener(progress)
    write = ingest.split_sinks("s1", str(tmp_path / "m"), str(tmp_path / "p"))
    ingest.observed(feed).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.streams.removeListener(progress)
    progress.flush()
    meta = spark.read.parquet(str(tmp_path / "m"))
    assert meta.count() == log.count() and not {"pk_values", "row_before", "row_after"} & set(meta.columns)
    assert spark.read.parquet(str(tmp_path / "p")).count() == log.count()
    table = spark.read.parquet(str(tmp_path / "progress"))
    assert table.agg(F.sum("received"), F.sum("indexed"), F.max("last_event")).first()[:3] == (log.count(), log.count(), log.agg(F.max("event_timestamp")).first()[0]) and table.filter("lag_seconds <= 0").count() == 0
    sizes = spark.createDataFrame([(1,), (2,), (3,), (0,)], "rows long")
    assert {tuple(r) for r in ingest.batch_sizes(sizes).collect()} == {(0, 1), (1, 2)}


def test_stream_helpers(spark, tmp_path):
    versions = spark.createDataFrame([("f", 50, 2, "ALTER TABLE"), ("f", 70, 9, "TRUNCATE TABLE")], "binlog_file string, end_pos long, snapshot_id int, ddl_type string")
    batch = spark.createDataFrame([("f", 10, 1), ("f", 60, 2), ("f", 80, 3)], "binlog_file string, end_pos long, event_id long")
    assert {(r.event_id, r.schema_version) for r in ingest.schema_versions(batch, versions, 1).collect()} == {(1, 1), (2, 2), (3, 2)}
    feed = spark.createDataFrame([("s", "u1", datetime(2024, 1, 1), 1), ("s", "u2", datetime(2024, 1, 2), 2)], "server_id string, server_uuid string, event_timestamp timestamp, event_id long")
    assert [r.event_id for r in ingest.identity_changes(feed).collect()] == [2]
    ledger = spark.createDataFrame([("a", "completed"), ("b", "failed")], "binlog_file string, status string")
    assert {r.binlog_file for r in ingest.pending_files(spark.createDataFrame([("a",), ("b",), ("c",)], "binlog_file string"), ledger).collect()} == {"b", "c"}
    mixed = spark.createDataFrame([(1, "", "s"), (4, "DROP TABLE t", "s"), (5, "", "s")], "event_type int, query string, schema_name string")
    for _ in range(2):
        ingest.route(str(tmp_path / "log"), str(tmp_path / "ddl"))(mixed, 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1 and spark.read.parquet(str(tmp_path / "ddl")).first().ddl_type == "DROP TABLE"


def test_newest_within_caps(spark):
    """Against ranks and running sums over all rows, with many rows in a second, null sizes and caps that nothing reaches."""
    rng = random.Random(4)
    rows = [(i, datetime(2024, 1, 1 + rng.randrange(2), rng.randrange(3), 0, rng.randrange(4)), rng.choice([None, 0, 5, 9])) for i in range(200)]
    log = spark.createDataFrame([*rows, (999, None, 5)], "event_id long, event_timestamp timestamp, size long")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    for events, size in ((None, None), (37, None), (None, 300), (60, 300), (60, 90), (0, None), (None, 0), (1000, 10**6)):
        want, held = set(), 0
        for n, (key, _, own) in enumerate(ordered, 1):
            held += own or 0
            if (events is None or n <= events) and (size is None or held <= size):
                want.add(key)
        out = retention.newest(log, events, size)
        assert {r.event_id for r in out.collect()} == want and out.columns == log.columns
