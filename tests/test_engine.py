"""Statements over small hand-made measurements."""

import random
from datetime import datetime as D

import pytest

from chronolith.catalog import Catalog
from chronolith.engine import Engine
from chronolith.functions.registry import REGISTRY, Function, register_function
from chronolith.lang import ast as A
from chronolith.lang.errors import AnalysisError, ParseError
from chronolith.lang.parser import parse_expression, parse_statement
from chronolith.plans.bind import constant_ns, parse_time, reduce

MINUTE = 60


def at(minutes, seconds=0):
    return D(2024, 1, 1, minutes // 60, minutes % 60, seconds)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, now_ns=parse_time("2024-01-01 02:00:00"))
    rows = [
        (at(0), "a", "x", 1.0, 1, True, "n1", 5), (at(1), "a", None, 3.0, 2, False, None, None), (at(12), "a", "x", None, 3, None, "n3", 7), (at(25), "a", "x", 7.0, None, True, "", 9),
        (at(5), "b", "y", 10.0, 10, True, "m", 1), (at(35), "b", "y", float("nan"), 20, False, "m", 2), (at(45), "b", "y", 30.0, 30, None, "m", 3), (at(3), None, "y", 100.0, 0, True, "z", 4),
    ]
    df = spark.createDataFrame([(*r[:7], None if r[7] is None else str(r[7])) for r in rows], "time timestamp_ntz, host string, region string, usage double, n bigint, ok boolean, note string, u string").selectExpr("*", "cast(u as decimal(20,0)) u2").drop("u").withColumnRenamed("u2", "u")
    e.catalog.add("cpu", df, "time", ["host", "region"])
    ns = spark.createDataFrame([(-1, "a", 1.0), (0, "a", 2.0), (1, "a", 3.0), (1500, "b", 4.0)], "time_ns bigint, host string, v double")
    e.catalog.add("fine", ns, "time_ns", ["host"], nanos=True)
    hobart = [D(2024, 4, 6, 13, 30), D(2024, 4, 6, 14, 30), D(2024, 4, 6, 15, 30), D(2024, 4, 6, 16, 30), D(2024, 4, 7, 14, 30), D(2024, 10, 5, 15, 30), D(2024, 10, 5, 16, 30)]
    e.catalog.add("dst", spark.createDataFrame([(t, float(i)) for i, t in enumerate(hobart)], "time timestamp_ntz, v double"), "time", [])
    return e


def run(engine, text, **params):
    return [tuple(r) for r in engine.sql(text, params).collect()]


def test_raw_points(engine):
    assert sorted(run(engine, "SELECT usage FROM cpu WHERE host = 'a'")) == [(at(0), 1.0), (at(1), 3.0), (at(25), 7.0)]
    # NaN is no value; a point with none of the fields is no row
    assert len(run(engine, "SELECT usage FROM cpu")) == 6
    assert run(engine, "SELECT host, usage FROM cpu WHERE n = 30") == [(at(45), "b", 30.0)]


def test_null_tags_are_empty(engine):
    assert run(engine, "SELECT usage FROM cpu WHERE host = ''") == [(at(3), 100.0)]
    assert sorted(r[1] for r in run(engine, "SELECT usage FROM cpu WHERE host != 'b'")) == [1.0, 3.0, 7.0, 100.0]
    assert sorted(r[1] for r in run(engine, "SELECT usage FROM cpu WHERE host !~ /a/")) == [10.0, 30.0, 100.0]
    assert [r[1] for r in run(engine, "SELECT usage FROM cpu WHERE host =~ /^$/")] == [100.0]
    # a null field fits no comparison, not even unequal
    assert sorted(r[1] for r in run(engine, "SELECT n FROM cpu WHERE usage != 1")) == [0, 2, 10, 30]


def test_conditions(engine):
    assert len(run(engine, "SELECT n FROM cpu WHERE true")) == 7
    assert run(engine, "SELECT n FROM cpu WHERE false OR 1 = 2") == []
    assert sorted(r[1] for r in run(engine, "SELECT n FROM cpu WHERE ok")) == [0, 1, 10]
    assert [r[1] for r in run(engine, "SELECT n FROM cpu WHERE ok = false AND n < 5")] == [2]
    # types that don't compare
    assert run(engine, "SELECT n FROM cpu WHERE n = 'x'") == [] == run(engine, "SELECT n FROM cpu WHERE unknown = 1")
    assert [r[1] for r in run(engine, "SELECT n FROM cpu WHERE '2024-01-01 00:45:00' <= time")] == [30]
    assert [r[1] for r in run(engine, "SELECT n FROM cpu WHERE time > now() - 1h - 16m")] == [30]
    assert [r[1] for r in run(engine, "SELECT n FROM cpu WHERE time = '2024-01-01T01:05:00+01:00'")] == [10]
    assert run(engine, "SELECT n FROM cpu WHERE n = $n AND host = $h", n=10, h="b") == [(at(5), 10)]
    with pytest.raises(AnalysisError):
        run(engine, "SELECT n FROM cpu WHERE n = $missing")
    with pytest.raises(AnalysisError):
        run(engine, "SELECT n FROM cpu WHERE time > n")


def test_arithmetic(engine):
    assert run(engine, "SELECT n / 0 AS z, n % 0 AS m, usage / 0 AS f, 10 / 4 AS c, 10.0 / 0 AS d, u + 1 AS u FROM cpu WHERE n = 10") == [(at(5), 0.0, None, 0.0, 2, 0.0, 2)]
    assert run(engine, "SELECT n & 6 AS a, n | 1 AS o, n ^ 3 AS x, -n AS m FROM cpu WHERE n = 10") == [(at(5), 2, 11, 9, -10)]
    with pytest.raises(AnalysisError):
        run(engine, "SELECT usage & 1 FROM cpu")
    with pytest.raises(AnalysisError):
        run(engine, "SELECT note + 1 FROM cpu")


@pytest.mark.parametrize("text,value", [("10 + 2", 12), ("10 - 2", 8), ("10 * 2", 20), ("10 / 5", 2), ("10 / 0", 0), ("7 / 2", 3), ("-7 / 2", -3), ("10 % 2", 0), ("15 & 10", 10), ("5 | 10", 15), ("13 ^ 10", 7), ("10.0 / 0.0", 0.0), ("10.0 / 4", 2.5)])
def test_constant_folding(text, value):
    got = reduce(parse_expression(text))
    assert isinstance(got, A.Literal) and got.value == value and type(got.value) is type(value)


def test_constants_that_do_not_fold():
    assert isinstance(reduce(parse_expression("10.5 & 2")), A.Binary)
    assert str(reduce(parse_expression("5m * 10"))) == "50m"
    assert constant_ns(parse_expression("now() - 1m"), 10**12) == 10**12 - 60 * 10**9
    assert parse_time("2024-01-01", "Australia/Hobart") == parse_time("2023-12-31 13:00:00")
    with pytest.raises(AnalysisError):
        parse_time("2024-13-01")


def test_casts(engine):
    assert run(engine, "SELECT usage::integer AS i, n::float AS f, note::string AS s, note::integer AS x, usage::field AS u FROM cpu WHERE n = 10") == [(at(5), 10, 10.0, "m", None, 10.0)]
    assert run(engine, "SELECT n, host::tag AS t, host::field AS f FROM cpu WHERE n = 10") == [(at(5), 10, "b", None)]


def test_wildcards(engine):
    assert engine.sql("SELECT * FROM cpu").columns == ["time", "n", "note", "ok", "u", "usage", "host", "region"]
    assert engine.sql("SELECT * FROM cpu GROUP BY host").columns == ["time", "host", "n", "note", "ok", "u", "usage", "region"]
    assert engine.sql("SELECT *::tag, /^u/ FROM cpu").columns == ["time", "host", "region", "u", "usage"]
    assert engine.sql("SELECT mean(*), count(/n/) AS k FROM cpu").columns == ["mean_n", "mean_u", "mean_usage", "k_n", "k_note"]
    assert engine.sql("SELECT n, n, n AS usage, usage FROM cpu").columns == ["time", "n", "n_1", "usage", "usage_1"]


def test_group_without_time(engine):
    assert sorted(run(engine, "SELECT sum(n), count(usage) FROM cpu GROUP BY host"), key=str) == [("a", 6, 3), ("b", 60, 2), (None, 0, 1)]
    assert run(engine, "SELECT sum(n) FROM cpu") == [(66,)]
    assert sorted(run(engine, "SELECT max(n) FROM cpu GROUP BY /^ho/"), key=str) == [("a", 3), ("b", 30), (None, 0)]


def filled(engine, fill, bounds=""):
    return run(engine, f"SELECT mean(usage) FROM cpu WHERE host = 'a'{bounds} GROUP BY TIME(5m) {fill} ORDER BY time")


def test_fill(engine):
    times = [at(5 * k) for k in range(6)]
    assert filled(engine, "FILL(none)") == [(at(0), 2.0), (at(10), None), (at(25), 7.0)]
    assert filled(engine, "") == list(zip(times, [2.0, None, None, None, None, 7.0])) == filled(engine, "FILL(null)")
    assert filled(engine, "FILL(-1)") == list(zip(times, [2.0, -1.0, -1.0, -1.0, -1.0, 7.0]))
    assert filled(engine, "FILL(previous)") == list(zip(times, [2.0, 2.0, 2.0, 2.0, 2.0, 7.0]))
    assert filled(engine, "FILL(linear)") == list(zip(times, [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]))
    # bounds of the condition make the grid; ends have nothing to lean on
    bounds = " AND time >= '2023-12-31 23:50:00' AND time < '2024-01-01 00:35:00'"
    got = filled(engine, "FILL(linear)", bounds)
    assert [r[0] for r in got][0] == D(2023, 12, 31, 23, 50) and got[-1] == (at(30), None) and got[0][1] is None and len(got) == 9
    assert filled(engine, "FILL(previous)", bounds)[-1] == (at(30), 7.0)
    assert run(engine, "SELECT mean(usage) FROM cpu WHERE host = 'nobody' GROUP BY TIME(5m)") == []


def test_fill_is_by_series(engine):
    got = run(engine, "SELECT count(n) FROM cpu WHERE host =~ /a|b/ GROUP BY TIME(15m), host")
    assert sorted(got, key=str) == [(at(0), "a", 3), (at(0), "b", 1), (at(15), "a", 0), (at(15), "b", None), (at(30), "b", 1), (at(45), "b", 1)]


def test_window_offset_and_now(engine):
    assert [r[0] for r in run(engine, "SELECT sum(n) FROM cpu WHERE host = 'b' GROUP BY TIME(10m, 3m) FILL(none) ORDER BY time")] == [at(3), at(33), at(43)]
    assert [r[0] for r in run(engine, "SELECT sum(n) FROM cpu WHERE host = 'b' GROUP BY TIME(1h, -15m) FILL(none) ORDER BY time")] == [D(2023, 12, 31, 23, 45), at(45)]
    with pytest.raises(AnalysisError):
        run(engine, "SELECT sum(n) FROM cpu GROUP BY TIME(0s)")
    with pytest.raises(AnalysisError):
        run(engine, "SELECT n FROM cpu GROUP BY TIME(1m)")


def test_zones(engine):
    # days of 25 and 23 hours
    got = run(engine, "SELECT count(v) FROM dst GROUP BY TIME(1d) FILL(none) TZ('Australia/Hobart')")
    assert sorted(got) == [(D(2024, 4, 6, 13), 4), (D(2024, 4, 7, 14), 1), (D(2024, 10, 5, 14), 2)]
    # the repeated hour stays two
    got = run(engine, "SELECT count(v) FROM dst WHERE time < '2024-04-07T00:00:00Z' GROUP BY TIME(1h) FILL(none) TZ('Australia/Hobart')")
    assert sorted(got) == [(D(2024, 4, 6, h), 1) for h in (13, 14, 15, 16)]
    spine = run(engine, "SELECT count(v) FROM dst WHERE time >= '2024-04-05' AND time < '2024-04-09' GROUP BY TIME(1d) FILL(0) TZ('Australia/Hobart')")
    assert [r[0] for r in sorted(spine)] == [D(2024, 4, 4, 13), D(2024, 4, 5, 13), D(2024, 4, 6, 13), D(2024, 4, 7, 14)]
    # times without an offset are local
    assert len(run(engine, "SELECT v FROM dst WHERE time < '2024-04-07 01:00:00' TZ('Australia/Hobart')")) == 1


def test_nanoseconds(engine):
    assert sorted(run(engine, "SELECT sum(v) FROM fine GROUP BY TIME(2ns) FILL(none)")) == [(-2, 1.0), (0, 5.0), (1500, 4.0)]
    assert run(engine, "SELECT v FROM fine WHERE time = 1") == [(1, 3.0)]
    assert len(run(engine, "SELECT sum(v) FROM fine WHERE host = 'a' GROUP BY TIME(1ns)")) == 3


def test_selectors(engine):
    assert run(engine, "SELECT first(usage), last(usage) FROM cpu WHERE host = 'a'") == [(1.0, 7.0)]
    assert run(engine, "SELECT max(usage), n, note FROM cpu WHERE host = 'b'") == [(at(45), 30.0, 30, "m")]
    assert sorted(run(engine, "SELECT top(usage, 2), n FROM cpu GROUP BY region"), key=str) == sorted([(at(0), "x", 1.0, 1), (at(25), "x", 7.0, None), (at(3), "y", 100.0, 0), (at(45), "y", 30.0, 30), (at(1), None, 3.0, 2)], key=str)
    assert run(engine, "SELECT bottom(usage, host, 1) FROM cpu") == [(at(0), 1.0, "a")]
    assert run(engine, "SELECT percentile(usage, 50) FROM cpu WHERE host = 'a'") == [(3.0,)]
    assert run(engine, "SELECT percentile(usage, 50), note FROM cpu WHERE host = 'b'") == [(at(5), 10.0, "m")]
    assert len(run(engine, "SELECT sample(n, 3) FROM cpu")) == 3
    for bad in ("SELECT max(usage), sum(n), note FROM cpu", "SELECT sum(n), note FROM cpu", "SELECT top(usage, 0) FROM cpu", "SELECT percentile(usage, 101) FROM cpu"):
        with pytest.raises(AnalysisError):
            run(engine, bad)


def test_distinct(engine):
    assert sorted(run(engine, "SELECT DISTINCT note FROM cpu"), key=str) == [("",), ("m",), ("n1",), ("n3",), ("z",)]
    assert sorted(run(engine, "SELECT distinct(ok) FROM cpu GROUP BY host"), key=str) == [("a", False), ("a", True), ("b", False), ("b", True), (None, True)]
    assert run(engine, "SELECT count(DISTINCT note) FROM cpu") == [(5,)]
    with pytest.raises(AnalysisError):
        run(engine, "SELECT DISTINCT note, n FROM cpu")


def test_transforms(engine):
    assert run(engine, "SELECT difference(usage) AS d, elapsed(usage, 1m) AS e FROM cpu WHERE host = 'a' ORDER BY time") == [(at(1), 2.0, 1), (at(25), 4.0, 24)]
    assert run(engine, "SELECT derivative(usage, 1m) AS d FROM cpu WHERE host = 'a' ORDER BY time") == [(at(1), 2.0), (at(25), 4.0 / 24)]
    assert run(engine, "SELECT cumulative_sum(n) AS c, moving_average(n, 2) AS m FROM cpu WHERE host = 'b' ORDER BY time") == [(at(5), 10, None), (at(35), 30, 15.0), (at(45), 60, 25.0)]
    assert run(engine, "SELECT difference(sum(n)) + 1 AS d FROM cpu WHERE host = 'b' GROUP BY TIME(10m) FILL(0) ORDER BY time") == [(at(10), -9), (at(20), 1), (at(30), 21), (at(40), 11)]
    assert run(engine, "SELECT integral(n, 1m) FROM cpu WHERE host = 'b'") == [(700.0,)]
    with pytest.raises(AnalysisError):
        run(engine, "SELECT difference(sum(n)) FROM cpu")


def test_limits(engine):
    assert run(engine, "SELECT n FROM cpu LIMIT 2 OFFSET 1") == [(at(1), 2), (at(3), 0)]
    assert run(engine, "SELECT n FROM cpu GROUP BY host ORDER BY time DESC LIMIT 1 SLIMIT 2") == [(at(3), None, 0), (at(12), "a", 3)]
    assert run(engine, "SELECT sum(n) FROM cpu GROUP BY host SLIMIT 1 SOFFSET 1") == [("a", 6)]
    assert sorted(run(engine, "SELECT sum(n) FROM cpu GROUP BY host SOFFSET 1")) == [("a", 6), ("b", 60)]
    assert run(engine, "SELECT n FROM cpu LIMIT 0") == [] == run(engine, "SELECT n FROM cpu SLIMIT 0")


def test_sources(engine):
    got = run(engine, "SELECT count(n) AS n, count(v) AS v FROM cpu, dst")
    assert sorted(got) == [("cpu", 7, 0), ("dst", 0, 7)]
    assert engine.sql("SELECT n FROM /cp/").columns == ["name", "time", "n"]
    assert run(engine, "SELECT max(s) FROM (SELECT sum(n) AS s FROM cpu GROUP BY host)") == [(60,)]
    assert sorted(run(engine, "SELECT mean(m) FROM (SELECT max(n) AS m FROM cpu GROUP BY TIME(15m), host FILL(0)) GROUP BY host"), key=str) == [("a", 1.5), ("b", 15.0), (None, 0.0)]
    for bad in ("SELECT a FROM nothing", "SELECT a FROM /nothing/", "SELECT a FROM other..cpu", "SELECT foo(n) FROM cpu", "SELECT sum(n, 2) FROM cpu", "SELECT sum(note) FROM cpu", "SELECT n FROM cpu, fine"):
        with pytest.raises(AnalysisError):
            run(engine, bad)


def test_types_meet_in_a_union(spark):
    e = Engine(spark)
    e.catalog.add("a", spark.sql("select timestamp_ntz'2024-01-01' t, 1L v, 'x' w"), "t", [])
    e.catalog.add("b", spark.sql("select timestamp_ntz'2024-01-01' t, 2.5D v, 3L w"), "t", [])
    assert sorted(run(e, "SELECT v, w FROM a, b")) == [("a", D(2024, 1, 1), 1.0, "x"), ("b", D(2024, 1, 1), 2.5, "3")]


def test_metadata(spark):
    e = Engine(spark)
    e.catalog.add("m", spark.sql("select timestamp_ntz'2024-01-01' t, 'a' k, cast(null as string) l, 1 v"), "t", ["k", "l"])
    assert run(e, "SHOW MEASUREMENTS") == [("m",)] == run(e, "SHOW MEASUREMENTS WHERE k = 'a'")
    assert run(e, "SHOW MEASUREMENTS ON *") == [("main", "autogen", "m")]
    assert run(e, "SHOW MEASUREMENTS WHERE k = 'b'") == [] == run(e, "SHOW MEASUREMENTS OFFSET 1")
    assert run(e, "SHOW TAG KEYS") == [("m", "k"), ("m", "l")] and run(e, "SHOW TAG KEYS WHERE k = 'a'") == [("m", "k")]
    assert run(e, "SHOW TAG VALUES WITH KEY != x") == [("m", "k", "a")] == run(e, "SHOW TAG VALUES WITH KEY =~ /k/")
    assert run(e, "SHOW FIELD KEYS") == [("m", "v", "integer")]
    e.query("CREATE DATABASE d; CREATE DATABASE d WITH DURATION 1w REPLICATION 3 NAME r")
    assert run(e, "SHOW DATABASES") == [("d",), ("main",)]
    assert run(e, "SHOW RETENTION POLICIES ON d") == [("d", "autogen", "0s", "0s", 1, False), ("d", "r", "1w", "0s", 3, True)]
    e.query("DELETE FROM m WHERE k = 'a'")
    assert run(e, "SELECT v FROM m") == []
    e.query("DROP MEASUREMENT m")
    assert run(e, "SHOW MEASUREMENTS") == []
    with pytest.raises(AnalysisError):
        run(e, "SHOW TAG KEYS ON nowhere")
    with pytest.raises(ParseError):
        e.sql("SHOW DATABASES; SHOW DATABASES")


@pytest.mark.parametrize("how", ["", "VERBOSE ", "ANALYZE ", "ANALYZE VERBOSE "])
def test_explain(engine, how):
    assert any("Aggregate" in r[0] for r in run(engine, f"EXPLAIN {how}SELECT sum(n) FROM cpu"))


def test_own_function(engine):
    register_function("double_sum", Function("agg", (1, 1), lambda v, t, a, n: __import__("pyspark").sql.functions.sum(v * 2)))
    try:
        assert run(engine, "SELECT double_sum(n) FROM cpu") == [(132,)]
    finally:
        del REGISTRY["double_sum"]


def test_rewritten_statement(engine):
    s = parse_statement("SELECT n FROM cpu")
    s.limit = A.Count("LIMIT", 1)
    assert len(engine.run(s).collect()) == 1


def test_time_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.sql("select timestamp_ntz'2024-01-01' time, 'a' host, 1.0D usage, 2.0D other").write.parquet(path)
    e = Engine(spark, Catalog(spark))
    e.catalog.add("m", spark.read.parquet(path), "time", ["host"])
    plan = e.sql("SELECT sum(usage) FROM m WHERE time >= '2024-01-01' AND host = 'a' GROUP BY TIME(1h)")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time" in plan and "EqualTo(host,a)" in plan and "other" not in plan


def plain_transforms(points):
    """difference, elapsed, sum so far and mean of the last 3 rows of one series' (time, value), by time."""
    out, last, total, rows = {}, None, 0, []
    for t, v in points:
        rows.append(v)
        three = rows[-3:]
        mean = sum(three) / 3 if len(three) == 3 and None not in three else None
        if v is not None:
            total += v
            out[t] = (None if last is None else v - last[1], None if last is None else t - last[0], total, mean)
            last = (t, v)
        elif mean is not None:
            out[t] = (None, None, None, mean)
    return out


def test_functions_over_time_work_in_stretches(spark, monkeypatch):
    """Each series, null tags too, is cut in stretches and blocks, and gives what it gives whole."""
    from chronolith.plans import select

    monkeypatch.setattr(select, "STRETCH_NS", 50)
    monkeypatch.setattr(select, "BLOCK_POINTS", 16)
    rng = random.Random(5)
    series = {h: [(t, rng.choice([None, rng.randrange(100)])) for t in sorted(rng.sample(range(-2000, 5000), n))] for h, n in (("a", 900), ("b", 40), (None, 60), ("c", 1))}
    df = spark.createDataFrame([(t, h, v) for h, points in series.items() for t, v in points], "time bigint, host string, v bigint")
    e = Engine(spark)
    e.catalog.add("m", df, "time", ["host"], nanos=True)
    got = e.sql("SELECT difference(v) AS d, elapsed(v, 1) AS e, cumulative_sum(v) AS c, moving_average(v, 3) AS m, difference(v) * 2 AS twice FROM m GROUP BY host").collect()
    found = {(r["host"], r["time"]): (r["d"], r["e"], r["c"], r["m"]) for r in got}
    want = {(h, t): x for h, points in series.items() for t, x in plain_transforms(points).items()}
    assert found == {k: (d, e, c, None if m is None else pytest.approx(m)) for k, (d, e, c, m) in want.items()} and all(r["twice"] == (None if r["d"] is None else 2 * r["d"]) for r in got)
    whole = {(None, r["time"]): (r["d"], r["c"]) for r in e.sql("SELECT difference(v) AS d, cumulative_sum(v) AS c FROM m WHERE host = 'a'").collect()}
    assert whole == {(None, t): (d, c) for t, (d, _, c, _) in plain_transforms(series["a"]).items() if c is not None}
    area = {r["host"]: r["integral"] for r in e.sql("SELECT integral(v, 1) FROM m GROUP BY host").collect()}
    for h, points in series.items():
        own = [p for p in points if p[1] is not None]
        assert area[h] == (pytest.approx(sum((b[1] + a[1]) / 2 * (b[0] - a[0]) for a, b in zip(own, own[1:]))) if own else None)


def test_a_fill_of_very_many_buckets(spark):
    """Empty buckets are spelled out a stretch at a time, not as one array."""
    df = spark.createDataFrame([(0, "a", 1.0), (3 * 10**15, "a", 3.0)], "time bigint, host string, v double")
    e = Engine(spark)
    e.catalog.add("m", df, "time", ["host"], nanos=True)
    r = e.sql("SELECT mean(v) AS v FROM m GROUP BY TIME(1s), host FILL(linear)").selectExpr("count(*) n", "count(distinct time) d", "min(v) a", "max(v) b", "avg(v) c").first()
    assert (r["n"], r["d"], r["a"], r["b"]) == (3_000_001, 3_000_001, 1.0, 3.0) and abs(r["c"] - 2) < 1e-9
    bounds = e.sql("SELECT sum(v) AS v FROM m WHERE time >= -2h AND time < 1h GROUP BY TIME(1h), host FILL(previous)").orderBy("time").collect()
    assert [(x["time"] // 3_600_000_000_000, x["v"]) for x in bounds] == [(-2, None), (-1, None), (0, 1.0)]
