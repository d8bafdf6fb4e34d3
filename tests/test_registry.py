"""Every query against its DuckDB equivalent on the driver's tables, and the plans of the main ones."""

from collections import Counter

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck, sf_dir):
    out = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(out.columns)
    assert Counter(map(tuple, out.select(columns).collect())) == Counter(want.fetchall())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_undo_script(spark, sf_dir):
    rows = QUERIES["undo_script"](spark, sf_dir).collect()
    assert rows[0].text.endswith("BEGIN;") and rows[-1].text == "COMMIT;"
    keys = [(r.event_timestamp, r.event_id) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_plans_have_no_python(spark, sf_dir):
    for name in ("state_at", "undo_update", "search_column_eq", "redact_columns", "latest_n_per_pk", "split_metadata"):
        assert "Python" not in plan(QUERIES[name](spark, sf_dir)) and "Arrow" not in plan(QUERIES[name](spark, sf_dir))


def test_archive_prunes_partitions(spark, sf_dir):
    text = plan(QUERIES["archive_round_trip"](spark, sf_dir))
    assert "PartitionFilters: [" in text and "event_date" in text.split("PartitionFilters: [")[1].split("]")[0]
