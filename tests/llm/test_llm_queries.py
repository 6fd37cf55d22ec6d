"""Every query of the subpackage on the smallest tables."""

import os

import pytest

from chronolith.llm import queries as q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: what tells the rows of the queries without SQL apart
KEYS = {
    "p1_series_counts": ["totals", "day", "db", "measurement", "region"], "p1_sketches": ["totals", "day", "db", "measurement", "region"], "p1_measurement_counts": ["totals", "field_type"], "p7_ids": ["doc_id"],
    "p8_containers": ["container", "pack_id", "doc_id", "piece"], "p8_bounds": ["pack_id"], "p8_partitions": ["pack_id", "round", "part"], "p9_found": ["doc_a", "doc_b"], "p9_spans": ["doc_a", "doc_b", "start_a", "start_b"], "p9_shared": ["doc_id"],
}


@pytest.mark.parametrize("name", list(q.queries()))
def test_query(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    duckdb = pytest.importorskip("duckdb")
    df = q.queries()[name](spark, FOLDER)
    got = df.collect()
    assert got
    if name in KEYS:
        keys = [tuple(r[c] for c in KEYS[name]) for r in got]
        assert len(set(keys)) == len(keys)
    if name in q.oracle_sql():
        c = duckdb.connect()
        for t in ("series_log", "series_segments", "measurement_fields"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        cursor = c.execute(q.oracle_sql()[name])
        order = [df.columns.index(d[0]) for d in cursor.description]
        assert sorted((tuple(r[i] for i in order) for r in got), key=str) == sorted(cursor.fetchall(), key=str)
