"""Storage semantics against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import storage as S
from chronolith.session import parts_for, shared_folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_last_write(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([0, 1, 2]), rng.choice([1.0, 2.0, None])) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, t bigint, seq bigint, v double")
    want = {}
    for k, t, s, v in data:
        want[k, t] = max(want.get((k, t), (-1, -1.0)), (s, -1.0 if v is None else v))
    got = {(r["k"], r["t"]): (r["seq"], -1.0 if r["v"] is None else r["v"]) for r in S.last_write(df, ["k", "t"], ["seq"]).collect()}
    assert got == want
    assert S.last_write(df.limit(0), ["k"], ["seq"]).collect() == []


def test_key_conditions_pass_below_the_last_write(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("a", 1, 1, 1.0)], "k string, t bigint, seq bigint, v double").write.parquet(path)
    df = S.last_write(spark.read.parquet(path), ["k", "t"], ["seq"])
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t,1)" in plan(df.where("t = 1")) and "EqualTo(v,1.0)" not in plan(df.where("v = 1"))


def test_merging_files(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "k string, t bigint, v double")
    b = spark.createDataFrame([("x", 2, 20.0, 5), ("y", 1, 3.0, 6)], "k string, t bigint, v double, w bigint")
    assert rows(S.merge_files([a, b], ["k", "t"]).select("k", "t", "v", "w")) == [("x", 1, 1.0, None), ("x", 2, 20.0, 5), ("y", 1, 3.0, 6)]
    with pytest.raises(ValueError):
        S.merge_files([], ["k"])


@pytest.mark.parametrize("few", [True, False, None])
def test_tombstones(spark, few):
    points = [(k, t) for k in ("a", "b", None) for t in range(20)] + [("a", None)]
    gone = [("a", 3, 5), ("a", 5, 8), ("a", 10, 9), (None, 0, 100), ("b", 19, 30), ("c", 0, 9)]
    df = S.apply_tombstones(spark.createDataFrame(points, "k string, time bigint"), spark.createDataFrame(gone, "k string, min_time bigint, max_time bigint"), ["k"], few=few)
    want = [(k, t) for k, t in points if t is None or not any(k == g and a <= t <= b for g, a, b in gone)]
    assert rows(df) == sorted(want, key=str)


def test_tombstones_merge(spark):
    gone = spark.createDataFrame([("a", 1, 3), ("a", 3, 4), ("a", 6, 7), ("b", 1, 1), ("b", 5, 2)], "k string, min_time bigint, max_time bigint")
    assert rows(S.coalesce_ranges(gone, ["k"])) == [("a", 1, 4), ("a", 6, 7), ("b", 1, 1)]


def test_ranges_of_time(spark):
    df = spark.createDataFrame([(t,) for t in [1, 2, 3, 4, None]], "time bigint")
    assert rows(S.include(df, F.lit(2), F.lit(3))) == [(2,), (3,)] and rows(S.exclude(df, F.lit(2), F.lit(3))) == [(1,), (4,), (None,)]
    assert rows(S.time_range(df)) == [(1, 4)] and rows(S.time_range(df.limit(0))) == [(None, None)]
    assert [r[0] for r in S.seek(df, F.lit(3)).collect()] == [3, 4] and [r[0] for r in S.seek(df, F.lit(3), True).collect()] == [3, 2, 1]
    stats = spark.createDataFrame([(1, 5), (6, 9)], "min_time bigint, max_time bigint")
    assert rows(S.overlapping(stats, F.lit(5), F.lit(5))) == [(1, 5)] and len(rows(S.overlapping(stats, F.lit(5), F.lit(6)))) == 2


def test_wide_and_long(spark):
    long = [("a", 1, "f", 1.0, 1), ("a", 1, "f", 2.0, 2), ("a", 1, "f", None, 3), ("a", 1, "g", 5.0, 1), ("b", 1, "g", 6.0, 1), ("b", 1, "other", 6.0, 1)]
    df = spark.createDataFrame(long, "k string, t bigint, field string, value double, seq bigint")
    wide = S.to_wide(df, ["k", "t"], "field", "value", ["f", "g"], "seq")
    assert rows(wide) == [("a", 1, 2.0, 5.0), ("b", 1, None, 6.0)]
    assert rows(S.to_long(wide, ["k", "t"], ["f", "g"])) == [("a", 1, "f", 2.0), ("a", 1, "g", 5.0), ("b", 1, "g", 6.0)]
    a, b = df.where("field = 'f'").select("k", F.col("value").alias("f")).limit(1), df.where("k = 'b'").select("k", F.col("value").alias("g")).limit(1)
    assert rows(S.align_fields([a, b], ["k"])) == [("a", 1.0, None), ("b", None, 6.0)]


def test_series(spark):
    a = spark.createDataFrame([("x", None), ("x", "1"), ("x", "1")], "k string, l string")
    b = spark.createDataFrame([("x", None)], "k string, l string")
    assert rows(S.series(a, ["k", "l"])) == [("x", "1"), ("x", None)]
    assert rows(S.known_series(S.series(a, ["k", "l"]), b, ["k", "l"])) == [("x", None)]
    assert rows(S.known_series(S.series(a, ["k", "l"]), b, ["k", "l"], missing=True)) == [("x", "1")]
    assert rows(S.delete_keys(a, b, ["k", "l"])) == [("x", "1"), ("x", "1")]


def test_rewriting(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "host string, time bigint, v double")
    S.write_sorted(df, path, ["host"], 2)
    S.rewrite(spark, spark.read.parquet(path).where("host = 'a'"), path, ["host"])
    assert rows(spark.read.parquet(path)) == [("a", 1, 1.0)] and sorted(os.listdir(tmp_path)) == ["m"]


def test_settings(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert parts_for(spark.createDataFrame([(1,)], "a int"), 1 << 20, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(spark.range(1000), 1000, 2) == 8


def test_new_series(spark):
    old = spark.createDataFrame([("a", 1), ("b", 10), ("b", 26), (None, 3)], "series_key string, series_id bigint")
    new = spark.createDataFrame([("a",), ("b",), (None,), ("a",)] + [(f"k{i % 400}",) for i in range(1000)], "series_key string")
    got = S.create_series(old, new).collect()
    ids = {r["series_key"]: r["series_id"] for r in got}
    assert len(got) == len(ids) == 402 and len(set(ids.values())) == 402 and (ids["a"], ids["b"]) == (1, 10)
    for p in range(8):
        made = sorted(r["series_id"] for r in got if r["partition_id"] == p and r["is_new"])
        start = {0: 1, 1: 26, 2: 3}.get(p, p + 1 - 8)
        assert made == [start + 8 * (k + 1) for k in range(len(made))]
    assert S.create_series(old.limit(0), new.limit(0)).collect() == []


def test_deleted_series_get_new_ids(spark, tmp_path):
    """The query against plain Python: deleted, re-created and live keys, in several spellings."""
    from chronolith.plans.language_queries import create_series

    rng = random.Random(5)
    segments = [(i, (i - 1) % 8, rng.choice([1, 1, 2]), f"m,t={rng.randrange(150)}" + rng.choice(["", ",x="])) for i in range(1, 200)]
    # a log's own form of a deletion: the id again, without the key
    segments += [(5000, 7, 1, "m,t=gone"), (5000, 7, 2, None), (6001, 0, 2, "m,t=1000"), (6009, 0, 1, "m,t=1000")]
    log = [f"m,t={i}" for i in range(250)] + ["m,t=gone", "m,x=,t=3", "m,t=1000", None]
    spark.createDataFrame(segments, "series_id bigint, partition_id int, flag int, series_key string").write.parquet(str(tmp_path / "series_segments.parquet"))
    spark.createDataFrame([(k,) for k in log], "series_key string").write.parquet(str(tmp_path / "series_log.parquet"))
    dead, live = {s[0] for s in segments if s[2] == 2}, {}
    for i, _, f, k in segments:
        if f == 1 and i not in dead:
            k = k.replace(",x=", "")
            live[k] = min(i, live.get(k, i))
    got = {r["series_key"]: r for r in create_series(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k in log if k and ",x=" not in k}
    assert {k: r["series_id"] for k, r in got.items() if not r["is_new"]} == {k: live[k] for k in got if k in live}
    for p in range(8):
        made = sorted(r["series_id"] for r in got.values() if r["is_new"] and r["partition_id"] == p)
        top = max(s[0] for s in segments if s[1] == p)
        assert made == [top + 8 * (k + 1) for k in range(len(made))]


def test_series_cardinality(spark, tmp_path):
    """The estimate against the exact number of tag sets, within four standard errors."""
    from chronolith.plans.language_queries import approx_series_cardinality

    data = [(f"m{i % 2}", f"h{i % 7001}", (None, "", "a", "b")[i % 4]) for i in range(60_000)] + [("x", "a", None), ("x", None, "a"), ("x", "", "a"), ("x", "a", "")]
    df = spark.createDataFrame(data, "measurement string, host string, region string")
    df.write.parquet(str(tmp_path / "readings.parquet"))
    exact = {}
    for m, h, g in data:
        exact.setdefault(m, set()).add((h or "", g or ""))
    for got in (approx_series_cardinality(spark, str(tmp_path)), S.series_cardinality(df, ["measurement", "host", "region"], ["measurement"])):
        found = {r["measurement"]: r for r in got.collect()}
        assert set(found) == set(exact) and found["x"]["series"] == 2
        assert all(abs(r["series"] / len(exact[m]) - 1) <= 4 * r["error"] for m, r in found.items())
    assert abs(S.series_cardinality(df, ["measurement", "host", "region"]).first()["series"] / sum(map(len, exact.values())) - 1) <= 4 * S.CARDINALITY_ERROR


def test_tombstone_log(spark, tmp_path):
    from chronolith.operators.tombstones import TombstoneLog

    log = TombstoneLog(spark, str(tmp_path / "log"))
    assert not log.has_tombstones() and log.walk().collect() == [] and log.stats() == (0, 0, 0)
    log.add_range(["a", "b"], 3, 5)
    log.add_range(["a"], 5, 3)
    assert log.walk().collect() == []
    log.commit()
    log.add(["c"])
    log.rollback()
    log.add(["d"])
    log.commit()
    log.commit()
    assert rows(log.walk()) == [("a", 3, 5), ("b", 3, 5), ("d", -(1 << 63), (1 << 63) - 1)]
    n, size, when = log.stats()
    assert n == 2 and size > 0 and when > 0
    points = spark.createDataFrame([("a", 4), ("a", 6), ("d", 0)], "key string, time bigint")
    assert rows(S.apply_tombstones(points, log.walk(), ["key"])) == [("a", 6)]
    log.delete()
    assert not log.has_tombstones()


def test_many_tombstones_of_one_key(spark):
    """Neither the ranges nor the points of a key meet in one task; null keys, null and odd times."""
    rng = random.Random(8)
    ranges = [("hot", a, a + rng.choice([-1, 0, 3, 40, 5000])) for a in rng.sample(range(-50_000, 200_000), 3000)] + [(None, 5, 10), ("all", -(1 << 63), (1 << 63) - 1), ("late", 90_000, 1 << 60)]
    points = [(k, t, i) for i, (k, t) in enumerate([(rng.choice(["hot"] * 8 + [None, "all", "late", "free"]), rng.choice([None, rng.randrange(-60_000, 210_000)])) for _ in range(5000)])]
    p = spark.createDataFrame(points, "k string, time bigint, n int")
    g = spark.createDataFrame(ranges, "k string, min_time bigint, max_time bigint")
    want = sorted(n for k, t, n in points if t is None or not any(k == kk and a <= t <= b for kk, a, b in ranges))
    for more in ({"stretch": 1000}, {"stretch": 7}, {}, {"few": True}):
        kept = S.apply_tombstones(p, g, ["k"], **more)
        assert kept.columns == ["k", "time", "n"] and sorted(r["n"] for r in kept.collect()) == want
    assert S.apply_tombstones(p, g.limit(0), ["k"]).count() == 5000 and S.apply_tombstones(p.limit(0), g, ["k"]).collect() == []


def test_last_write_keeps_whole_rows(spark):
    rows = [("a", 1, None, 5, "x"), ("a", 1, 3, None, "y"), ("a", 1, 3, 7, None), ("b", 2, None, None, None), ("b", 2, None, None, None), (None, 1, 1, 1, "z")]
    got = S.last_write(spark.createDataFrame(rows, "k string, t int, seq int, v int, s string"), ["k", "t"], ["seq"])
    assert got.columns == ["k", "t", "seq", "v", "s"] and sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 3, 7, None), ("b", 2, None, None, None), (None, 1, 1, 1, "z")], key=str)
