"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = [n for n in entry.queries() if entry.queries()[n].__module__.split(".")[1] != "llm"]


#: what tells the rows of the queries without SQL apart
KEYS = {
    "create_series": ["series_key"], "approx_series_cardinality": ["measurement"], "sample": ["time", "event_type", "sample", "event_id"], "explain": [], "p5_grid": ["stmt_id", "measurement", "host", "bucket_us"],
    "p3_points": ["file_seq", "measurement", "time", "host", "field_id", "field", "as_float", "as_integer", "as_unsigned", "as_boolean", "as_string", "state"],
}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in found)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        # what SQL can't say: rows without repeats of their key, columns and rows that every table gives
        assert got and name in KEYS, "a query without SQL needs a property"
        at = [df.columns.index(c) for c in KEYS[name]]
        keys = [tuple(r[i] for i in at) for r in df.collect()]
        assert not at or (len(set(keys)) == len(keys) and all(k[0] is not None for k in keys))
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", ["sum_by_time_whole", "fill_null_whole", "fill_none_whole", "fill_value_whole", "fill_previous_whole", "fill_linear_whole"])
def test_whole_tables_are_grouped_and_filled(spark, duck, name):
    days = {r[0].date() for r in entry.queries()[name](spark, FOLDER).select("time").distinct().collect()}
    assert days >= {r[0] for r in duck.execute("SELECT DISTINCT ts::DATE FROM events").fetchall()}
    assert name in entry.oracle_sql()


def test_flagship(spark, duck):
    assert entry.entry(spark).columns == ["time", "sum"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
