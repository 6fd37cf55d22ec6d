"""Ranges, drifting fields, grids and skewed keys against plain Python."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions.series_keys import canonical_key, key_measurement, key_tags
from chronolith.operators.drift import consistent_points, field_changes, field_lifespans
from chronolith.operators.heavy import heavy_keys, key_statistics
from chronolith.operators.intervals import SHARD_BITS, decode_runs, encode_runs, periods_and_gaps, union_runs
from chronolith.operators.regular import duration_us, empty_buckets, modelled_gaps, regular_series

ABSENT = -(1 << 63)
SHARD = 1 << SHARD_BITS


# -- ranges --------------------------------------------------------------------


def plain_periods(ranges):
    by = defaultdict(list)
    for k, a, b in ranges:
        if k is not None and a is not None and b is not None and a <= b and ABSENT not in (a, b):
            by[k].append((a, b))
    out = []
    for k, own in by.items():
        own.sort()
        lo, hi = own[0]
        for a, b in own[1:]:
            if a > hi + 1:
                out += [(k, False, lo, hi), (k, True, hi + 1, a - 1)]
                lo, hi = a, b
            hi = max(hi, b)
        out.append((k, False, lo, hi))
    return sorted(out)


def spark_periods(spark, ranges):
    df = spark.createDataFrame(ranges, "entity string, lo bigint, hi bigint")
    return sorted(tuple(r) for r in periods_and_gaps(df, ["entity"], "lo", "hi").collect())


def test_ranges_at_random(spark):
    rng = random.Random(1)
    rows = []
    for e in range(12):
        scale = [3, 50, SHARD // 2, SHARD * 3, SHARD * 40][e % 5]
        for _ in range(rng.choice([1, 5, 60])):
            a = rng.randrange(-4 * scale, 4 * scale)
            rows.append((f"e{e}", a, a + rng.choice([0, 1, rng.randrange(scale)])))
    # touching ranges, ends of shards, long ranges over others
    rows += [("t", 0, 9), ("t", 10, 19), ("t", 21, 30), ("t", 21, 30)]
    rows += [("s", SHARD - 5, SHARD - 1), ("s", SHARD, SHARD + 3), ("s", 2 * SHARD - 1, 2 * SHARD), ("s", 5 * SHARD, 6 * SHARD - 1)]
    rows += [("l", -3 * SHARD, 7 * SHARD + 5)] + [("l", k * SHARD + 10 * i, k * SHARD + 10 * i + 3) for k in range(-2, 9) for i in range(5)]
    rows += [("edge", -(1 << 63) + 1, -(1 << 63) + 1), ("edge", (1 << 63) - 1, (1 << 63) - 1)]
    rng.shuffle(rows)
    assert spark_periods(spark, rows) == plain_periods(rows)


def test_unusable_ranges(spark):
    rows = [("a", None, 5), ("a", 5, None), ("a", 9, 3), ("a", ABSENT, 3), (None, 1, 2), ("b", 4, 4), ("", 1, 1)]
    assert spark_periods(spark, rows) == [("", False, 1, 1), ("b", False, 4, 4)]
    assert spark_periods(spark, []) == []


def test_one_entity_holds_most_ranges(spark):
    rows = [("hot", 10 * i, 10 * i + (i % 12)) for i in range(3000)] + [(f"e{i}", i, i + 1) for i in range(50)]
    assert spark_periods(spark, rows) == plain_periods(rows)


def test_run_bitmaps():
    s, e = np.array([0, 7, 3, 1, 9]), np.array([2, 8, 3, 1, 9])
    bounds = np.array([0, 2, 2, 3, 5])
    got = decode_runs(encode_runs(s, e, bounds))
    assert [x.tolist() for x in got] == [s.tolist(), e.tolist(), bounds.tolist()]
    # more groups than fit at a time
    g = np.arange(200_000)
    a, b, c = union_runs(np.repeat(g, 2), np.tile([5, 0], 200_000), np.tile([9, 4], 200_000))
    assert (a == g).all() and (b == 0).all() and (c == 9).all()


def test_range_columns_may_clash(spark):
    df = spark.createDataFrame([("a", 1, 2, 5, "x")], "entity string, min_time bigint, max_time bigint, p bigint, whole string")
    assert [tuple(r) for r in periods_and_gaps(df, ["entity"], "min_time", "max_time").collect()] == [("a", False, 1, 2)]


# -- drifting fields ---------------------------------------------------------------


def plain_changes(rows):
    files, state = defaultdict(set), {}
    for s, m, i, n, t in rows:
        if m is not None:
            files[m].add(s)
            if i is not None:
                state[m, s, i] = (n, t if t in (1, 2, 3, 4, 9) else None)
    out = []
    for m, seqs in files.items():
        before, last_type = {}, {}
        for s in sorted(seqs):
            now = {i: v for (mm, ss, i), v in state.items() if (mm, ss) == (m, s)}
            for i, (n, t) in now.items():
                if i not in before:
                    # the first file is compared with none
                    out += [(m, s, i, "added")] if s > min(seqs) else []
                    last_type[i] = t
                    continue
                if n != before[i][0]:
                    out.append((m, s, i, "renamed"))
                if t is not None:
                    if last_type[i] is not None and last_type[i] != t:
                        out.append((m, s, i, "retyped"))
                    last_type[i] = t
            out += [(m, s, i, "removed") for i in before if i not in now]
            before = now
    return sorted(out)


FIELDS = "file_seq bigint, measurement string, field_id int, field_name string, field_type int"


def test_changes_at_random(spark):
    rng = random.Random(2)
    rows = []
    for m in ["a", "b", None, ""]:
        for s in rng.sample(range(100), 20):
            rows += [(s, m, i, rng.choice("xyz"), rng.choice([0, None, 1, 2, 7, 9])) for i in range(6) if rng.random() < 0.7]
    rows += rows[:40]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in field_changes(spark.createDataFrame(rows, FIELDS)).collect())
    assert got == plain_changes(rows)
    assert field_changes(spark.createDataFrame([], FIELDS)).collect() == []


def test_a_file_without_fields_counts(spark):
    rows = [(1, "m", 1, "a", 1), (2, "m", None, None, None), (3, "m", 1, "a", 2)]
    got = sorted(tuple(r) for r in field_changes(spark.createDataFrame(rows, FIELDS)).collect())
    assert got == [("m", 2, 1, "removed"), ("m", 3, 1, "added")]


def test_lifespans_and_points(spark):
    fields = [(1, "m", 1, "a", 2), (2, "m", 1, "a", 1), (3, "m", 1, "b", None), (5, "m", 2, "c", 4), (6, "m", 1, "z", 3)]
    f = spark.createDataFrame(fields, FIELDS)
    spans = sorted(tuple(r)[:6] + (r["name"], r["type"]) for r in field_lifespans(f).collect())
    assert spans == [("m", 1, 1, 1, 3, 3, "b", 1), ("m", 1, 2, 6, 6, 1, "z", 3), ("m", 2, 1, 5, 5, 1, "c", 4)]
    t = datetime(2024, 1, 1)
    points = [
        (1, "m", t, "h", '{"a": 5}'), (1, "m", t, "h", '{"a": 5}'), (2, "m", t, "h", '{"a": "x"}'), (3, "m", t, "h", '{"b": 2.5, "other": 1}'), (5, "m", t, None, '{"c": true, "a": null}'),
        (6, "m", None, "h", '{"z": "text"'), (6, "m", t, "h", None), (6, "m", t, "h", '{"z": null}'), (6, None, t, "h", '{"z": "q"}'),
    ]
    df = spark.createDataFrame(points, "file_seq bigint, measurement string, time timestamp_ntz, host string, fields string")
    got = sorted(((r["file_seq"], r["measurement"], r["field"], r["as_float"], r["as_boolean"], r["as_string"], r["state"]) for r in consistent_points(df, f).collect()), key=str)
    assert got == sorted(
        [
            (1, "m", "b", 5.0, None, None, "cast"), (2, "m", "b", None, None, "x", "unfit"), (3, "m", "b", 2.5, None, None, "kept"), (3, "m", "other", None, None, "1", "unknown"),
            (5, "m", "c", None, True, None, "kept"), (5, "m", "a", None, None, None, "unknown"), (6, "m", None, None, None, None, "no fields"), (6, "m", None, None, None, None, "no fields"),
            (6, "m", "z", None, None, None, "null"), (6, None, "z", None, None, "q", "unknown"),
        ],
        key=str,
    )
    assert consistent_points(df.limit(0), f).collect() == []


def test_cut_off_points_keep_their_values(spark):
    f = spark.createDataFrame([(1, "m", i, n, t) for i, (n, t) in enumerate([("a", 1), ("b", 3), ("c", 2)])], FIELDS)
    t = datetime(2024, 1, 1)
    texts = {
        '{"a": 1.5, "b": "x, \\"y\\"", "c": 12': {("a", "1.5"), ("b", 'x, "y"')},
        '{"a": 1.5, "b": "whole"': {("a", "1.5"), ("b", "whole")},
        '{"a": 2.5, "b": "cu, t': {("a", "2.5")}, '{"c": 7, "a"': {("c", "7")}, '{"c": 7,': {("c", "7")},
        '{"b": [1, 2], "a": [3': {("b", "[1,2]")}, '{"a': set(), "{": set(), '{"c": 1': set(),
    }
    points = [(1, "m", t, str(i), x) for i, x in enumerate(texts)] + [(1, "m", t, "null", None), (1, "m", t, "empty", "{}"), (1, "m", t, "good", '{"c": 3}')]
    got = defaultdict(list)
    for r in consistent_points(spark.createDataFrame(points, "file_seq bigint, measurement string, time timestamp_ntz, host string, fields string"), f, read_cut=True).collect():
        value = next((r[c] for c in ("as_float", "as_integer", "as_string") if r[c] is not None), None)
        got[r["host"]].append((r["field"], None if value is None else str(value).replace(" ", "") if r["field"] == "b" and str(value).startswith("[") else str(value), r["state"]))
    for i, (x, want) in enumerate(texts.items()):
        own = got[str(i)]
        assert [v for n, v, s in own if s == "cut off"] == [x]
        assert {(n, v) for n, v, s in own if s == "kept"} == want and len(own) == 1 + len(want)
    assert got["null"] == got["empty"] == [(None, None, "no fields")] and got["good"] == [("c", "3", "kept")]


# -- grids -----------------------------------------------------------------------------

READINGS = "measurement string, series_key string, host string, region string, time timestamp_ntz, usage double, file_seq bigint, ingested_at timestamp_ntz"
STATEMENTS = "stmt_id bigint, measurement string, time_interval string, time_offset string, fill string, time_from timestamp_ntz, time_to timestamp_ntz"
T0 = datetime(2024, 1, 1)


def reading(m, h, minutes, v, seq=1):
    t = None if minutes is None else T0 + timedelta(minutes=minutes)
    return (m, "k", h, None, t, v, seq, T0)


def us(minutes):
    return int(((T0 - datetime(1970, 1, 1)) + timedelta(minutes=minutes)).total_seconds()) * 10**6


@pytest.mark.parametrize("text,value", [("1h30m", 5400), ("30m30m", 3600), ("7200000ms", 7200), (" 2H ", 7200), ("1d", 86400), ("10 m", 600), ("", None), ("5", None), ("m", None), ("1x", None), (None, None)])
def test_durations(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(duration_us("t")).first()[0]
    assert got == (None if value is None else value * 10**6)


def test_empty_buckets(spark):
    rows = [reading("m", "a", 5, 1.0), reading("m", "a", 35, 2.0), reading("m", "a", 15, None), reading("m", "a", 25, float("nan")), reading("m", None, 15, 1.0), reading("m", "a", None, 1.0), reading("m", "b", 15, None), reading("n", "c", 0, 1.0), reading("x", "a", 0, 1.0), reading("n", "c", 61, 1.0)]
    r = spark.createDataFrame(rows, READINGS)
    s = spark.createDataFrame([(1, "m", "10m", None, None, T0 - timedelta(minutes=12), T0 + timedelta(minutes=50)), (2, "n", "30m", "5m", "fill(none)", None, None), (3, "m", "zero", None, None, None, None), (4, None, "1m", None, None, None, None)], STATEMENTS)
    got = sorted(tuple(x) for x in empty_buckets(r, s).collect())
    assert got == [(1, "m", "a", us(m)) for m in (-20, -10, 10, 20, 40)] + [(2, "n", "c", us(5))]
    assert empty_buckets(r.limit(0), s).collect() == [] == empty_buckets(r, s.limit(0)).collect()


def test_fills_and_last_write(spark):
    rows = [reading("m", "a", 0, 1.0), reading("m", "a", 0, 3.0, 2), reading("m", "a", 30, 9.0), reading("m", "a", 31, 11.0), reading("m", "a", 31, 11.0)]
    r = spark.createDataFrame(rows, READINGS)
    end = T0 + timedelta(minutes=45)
    want = {"fill(previous)": [3.0, 3.0, 3.0, 10.0, 10.0], "FILL(Linear)": [3.0, 3.0 + 7 / 3, 3.0 + 14 / 3, 10.0, None], "Fill(-2.5)": [3.0, -2.5, -2.5, 10.0, -2.5], "fill(null)": [3.0, None, None, 10.0, None], None: [3.0, None, None, 10.0, None], "fill(none)": [3.0, 10.0]}
    for i, (fill, values) in enumerate(want.items()):
        s = spark.createDataFrame([(i, "m", "10m", None, fill, None, end)], STATEMENTS)
        got = sorted((x["bucket_us"], x["value"], x["n"], x["observed"]) for x in regular_series(r, s).collect())
        assert [x[1] for x in got] == [None if v is None else pytest.approx(v) for v in values]
        assert [x[2] for x in got if x[3]] == [1, 2]


def test_model_follows_the_day(spark):
    """Held-out buckets of a daily wave with a trend are predicted; a straight line is not enough."""
    rng = np.random.default_rng(3)
    value = lambda m: 20 + 0.002 * m + 5 * np.sin(2 * np.pi * m / 1440)
    minutes = [m for m in range(0, 6 * 1440, 10) if not 2000 < m < 3200]
    rows = [reading("m", "a", m, float(value(m) + rng.normal(0, 0.1))) for m in minutes]
    s = spark.createDataFrame([(1, "m", "10m", None, "fill(linear)", None, None)], STATEMENTS)
    got = regular_series(spark.createDataFrame(rows, READINGS), s).where("not observed").collect()
    truth = {us(m): value(m) for m in range(0, 6 * 1440, 10)}
    model = np.array([x["model"] - truth[x["bucket_us"]] for x in got])
    line = np.array([x["value"] - truth[x["bucket_us"]] for x in got])
    assert len(got) == 119 and np.abs(model).max() < 0.5 and np.abs(line).max() > 2


def test_model_of_few_readings(spark):
    rows = [reading("m", "a", 0, 4.0), reading("m", "b", 0, 4.0), reading("m", "b", 40, 6.0)]
    s = spark.createDataFrame([(1, "m", "10m", None, None, None, T0 + timedelta(minutes=60))], STATEMENTS)
    got = regular_series(spark.createDataFrame(rows, READINGS), s).collect()
    assert len(got) == 12 and all(x["model"] is not None and np.isfinite(x["model"]) for x in got)


@pytest.mark.parametrize("fill", ["fill(linear)", "fill(none)"])
def test_empty_buckets_come_from_the_model(spark, fill):
    """Every missing bucket, of any fill, has the regression's value, and its plan has the solve."""
    value = lambda m: 20 + 0.002 * m + 5 * np.sin(2 * np.pi * m / 1440)
    minutes = [m for m in range(0, 6 * 1440, 10) if not 2000 < m < 3200]
    r = spark.createDataFrame([reading("m", "a", m, float(value(m))) for m in minutes], READINGS)
    s = spark.createDataFrame([(1, "m", "10m", None, fill, None, None)], STATEMENTS)
    got = {x["bucket_us"]: x["model"] for x in modelled_gaps(r, s).collect()}
    assert set(got) == {us(m) for m in range(2010, 3200, 10)}
    assert max(abs(got[us(m)] - value(m)) for m in range(2010, 3200, 10)) < 0.1
    found = empty_buckets(r, s)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {x["bucket_us"] for x in found.collect()} == set(got) and "MapInArrow" in plan and "SIN(" in plan.upper() and "an empty bucket has no model value" in plan


# -- skewed keys -------------------------------------------------------------------------


def test_heavy_keys(spark):
    rows = [("a", "x")] * 30 + [("a", None)] * 40 + [("b", "y")] * 2 + [(f"c{i}", "z") for i in range(28)]
    df = spark.createDataFrame(rows, "m string, h string")
    assert sorted((tuple(r) for r in heavy_keys(df, ["m", "h"]).collect()), key=str) == [("a", "x", 30), ("a", None, 40)]
    assert len(heavy_keys(df, ["m", "h"], 2).collect()) == 3
    assert heavy_keys(df.limit(0), ["m"]).collect() == []


def test_statistics(spark):
    rows = [("a", 1.0, T0), ("a", 3.0, T0), ("a", float("nan"), T0 + timedelta(1)), ("a", None, None), (None, 2.0, None), ("b", None, T0)]
    df = spark.createDataFrame(rows, "k string, v double, t timestamp_ntz")
    got = {r["k"]: r for r in key_statistics(df, ["k"], "v", "t").collect()}
    a = got["a"]
    assert (a["n"], a["n_values"], a["total"], a["mean"], a["least"], a["most"], a["first_value"], a["last_value"]) == (4, 2, 4.0, 2.0, 1.0, 3.0, 1.0, 3.0)
    assert a["last_time"] == T0 + timedelta(1) and got[None]["first_value"] is None and got["b"]["n"] == 1


# -- series keys ---------------------------------------------------------------------------


def plain_key(key):
    pieces, cur, marks, i = [], [], [], 0
    while i < len(key):
        c = key[i]
        if c == "\\" and i + 1 < len(key) and key[i + 1] in ",= ":
            cur.append((key[i + 1], True))
            i += 2
            continue
        if c == ",":
            pieces.append(cur)
            cur = []
        else:
            cur.append((c, False))
        i += 1
    pieces.append(cur)
    tags = set()
    for p in pieces[1:]:
        at = next((k for k, x in enumerate(p) if x == ("=", False)), None)
        if at is not None and at + 1 < len(p):
            tags.add(("".join(c for c, _ in p[:at]), "".join(c for c, _ in p[at + 1 :])))
    return "".join(c for c, _ in pieces[0]), frozenset(tags)


def test_keys(spark):
    rng = random.Random(4)
    keys = ["cpu,host=a,region=b", "cpu,region=b,host=a", "cpu,host=a,host=a,region=b,dc=", "cpu,host=a", "a\\ b,x=1", "a b,x=1", "m,t=a\\,b", "m,t=a,b", "m,t=a\\=b", "m,t=a=b", "m\\,t=1", "", "m,t\\=a=b", "m,t=a\\\\,b=c", "m,t=\x01c", "m,t=\\,", "m,=v", "m,t=x\\"]
    keys += ["".join(rng.choice("ab,=\\ \x01ce") for _ in range(rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    got = df.select("k", canonical_key("k").alias("c"), key_measurement("k").alias("m"), key_tags("k").alias("t")).collect()
    canon = defaultdict(set)
    for r in got:
        if r["k"] is None:
            assert r["c"] is None and r["m"] is None and r["t"] is None
            continue
        m, tags = plain_key(r["k"])
        canon[r["c"]].add((m, tags))
        assert r["m"] == m and {tuple(x) for x in r["t"]} == tags
    assert all(len(v) == 1 for v in canon.values())
    assert len(canon) == len(set().union(*canon.values()))
    assert Counter(len(v) for v in canon.values())[1] == len(canon)


def test_keys_of_very_many_pieces(spark):
    """Two keys that differ only after a million pieces are different."""
    long = F.concat(F.lit("m"), F.repeat(F.lit(",a="), F.lit(1_000_000)), F.concat(F.lit(",b="), F.col("id")))
    got = [r[0] for r in spark.range(1, 3).select(canonical_key(long)).collect()]
    assert got == ["m,b=1", "m,b=2"]
