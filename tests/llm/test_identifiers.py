"""Distinct counts and seen keys against exact sets."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm.distinct import distinct_counts, estimate, merge, merge_sketches, pack, sketch, unpack
from chronolith.llm.membership import CuckooTable, audit, seen_before


def hashes(n, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


# -- sketches -----------------------------------------------------------------------------------


def coupons(values, bits=12):
    bucket = (values & np.uint64((1 << bits) - 1)).astype(np.int64)
    rest = (values >> np.uint64(bits)) | np.uint64(1 << (63 - bits))
    low = rest & (~rest + np.uint64(1))
    return np.unique(bucket << 6 | np.round(np.log2(low.astype(float))).astype(np.int64))


def of(values):
    e = coupons(values)
    n, error = estimate(np.bincount(e & 63, minlength=64)[None, :])
    return float(n[0]), float(error[0])


@pytest.mark.parametrize("n", [0, 1, 10, 500, 4000, 30_000, 1_000_000])
def test_estimates_keep_their_error(n):
    rng = np.random.default_rng(n)
    off = []
    for _ in range(3 if n > 10**5 else 40):
        got, error = of(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        off.append((got - n) / max(error, 1e-3 * max(n, 1), 0.5))
        assert error <= 0.0115 * n + 1
    off = np.array(off)
    assert np.abs(off).max() < 4.5 and np.abs(off.mean()) < 4 / np.sqrt(len(off))


def test_sketch_forms():
    few, many = coupons(hashes(100)), coupons(hashes(100_000))
    for e in (few, many, np.empty(0, np.int64)):
        assert unpack(pack(e)).tolist() == e.tolist()
    assert pack(few)[:1] == b"\0" and pack(many)[:1] == b"\1" and len(pack(many)) == 1 + (8 << 12)
    assert unpack(merge([pack(few), pack(many), pack(few)])).tolist() == np.union1d(few, many).tolist()


def test_counts_by_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), f"k{rng.randrange(3000)}", "x") for _ in range(20_000)] + [("c", 1, None, "x")]
    df = spark.createDataFrame(rows, "g string, h int, k string, totals string")
    got = distinct_counts(sketch(df.drop("totals"), F.col("k"), ["g", "h"])).collect()
    truth = defaultdict(set)
    for g, h, k, _ in rows:
        for t, key in ((0, (g, h)), (1, (None, h)), (2, (g, None)), (3, (None, None))):
            truth[t, key] |= {k} - {None}
    assert {(r["totals"], (r["g"], r["h"])) for r in got} == set(truth) and len(got) == len(truth)
    for r in got:
        n = len(truth[r["totals"], (r["g"], r["h"])])
        assert r["low"] - 1 <= n <= r["high"] + 1 and abs(r["estimate"] - n) <= 0.05 * n + 1


def test_partial_results_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    whole = sketch(df, F.col("k"), ["g"])
    parts = sketch(df.where("id < 12000"), F.col("k"), ["g"]).unionByName(sketch(df.where("id >= 9000"), F.col("k"), ["g"]))
    assert sorted(map(tuple, merge_sketches(parts).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_sketches_merge_in_a_tree(spark, monkeypatch):
    """A task sends one sketch a group, and no row of a merge holds more than FAN_IN of them."""
    from chronolith.llm import distinct

    monkeypatch.setattr(distinct, "FAN_IN", 3)
    df = spark.range(30_000).select((F.col("id") % 3000).alias("g"), (F.col("id") % 7).alias("h"), F.col("id").cast("string").alias("k"))
    made, tasks = distinct.partial_sketches(df, F.col("k"), ["g", "h"])
    made = made.cache()
    assert tasks == 12 and made.groupBy("g", "h", "totals", "__task").count().agg(F.max("count")).first()[0] == 1
    assert made.where("totals = 3").count() == 12
    merged = merge_sketches(made, tasks=tasks)
    plan = merged._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 4  # one makes them, three levels merge 12, 4 and 2
    whole = merged.where("totals = 3").first()["sketch"]
    assert whole == merge([r["sketch"] for r in made.where("totals = 3").collect()])
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, merge_sketches(made.drop("__task")).collect()), key=str)


def test_no_rows_and_no_groups(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert sketch(df.limit(0), F.col("k"), []).count() <= 1
    assert [round(r["estimate"]) for r in distinct_counts(sketch(df, F.col("k"), [])).collect()] == [2]
    assert sketch(df.limit(0).withColumn("g", F.lit(1)), F.col("k"), ["g"]).collect() == []


# -- cuckoo tables -------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [8, 12, 16, 32])
def test_table_misses_nothing(bits):
    t, h = CuckooTable(bits, 16), hashes(50_000)
    for part in np.array_split(h, 7):
        t.add(part)
        assert t.has(part).all()
    assert t.has(h).all() and len(t) == len(h) and len(t.generations) > 3
    wrong = t.has(hashes(200_000, 1)).mean()
    assert wrong <= 1.2 * t.wrong_rate + 1e-4
    if bits <= 12:
        assert wrong > 0


def test_saturation_loses_nothing():
    """More copies of one hash than its two buckets hold."""
    t = CuckooTable(16, 16)
    t.add(np.repeat(hashes(1), 30))
    assert len(t) == 30 and t.has(hashes(1)).all()
    assert t.delete(np.repeat(hashes(1), 30)).all() and not t.has(hashes(1)).any() and len(t) == 0


def test_deletion():
    t, h = CuckooTable(32, 64), hashes(3000)
    t.add(h)
    assert t.delete(h[:1000]).all()
    assert not t.has(h[:1000]).any() and t.has(h[1000:]).all() and len(t) == 2000
    assert not t.delete(h[:10]).any()


def test_see_in_order():
    rng = np.random.default_rng(2)
    h = hashes(500)[rng.integers(0, 500, 5000)]
    t, seen = CuckooTable(32), set()
    for part in np.array_split(h, 9):
        want = []
        for x in part.tolist():
            want.append(x in seen)
            seen.add(x)
        assert t.see(part).tolist() == want


def log_of(seed, n, hot):
    rng = random.Random(seed)
    keys = [f"m{i % 5},host=h{i},region=r" for i in range(n)]

    def spell(k):
        m, *tags = k.split(",")
        rng.shuffle(tags)
        return ",".join([m, *tags, *(["x="] if rng.random() < 0.3 else []), *([tags[0]] if rng.random() < 0.3 else [])])

    log = [(i, None if rng.random() < 0.01 else spell(keys[0] if rng.random() < hot else rng.choice(keys)), 1) for i in range(4 * n)]
    rng.shuffle(log)
    return [(i, spell(k)) for i, k in enumerate(rng.sample(keys, n // 4))], log


def plain_seen(segments, log):
    canon = lambda k: (k.split(",")[0], frozenset(t for t in k.split(",")[1:] if not t.endswith("=")))
    old, out = {canon(k) for _, k in segments}, {}
    for i, k, _ in sorted(log, key=lambda r: r[0]):
        out[i] = None if k is None else canon(k) in old
        if k is not None:
            old.add(canon(k))
    return out


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_seen_before(spark, hot):
    segments, log = log_of(7, 800, hot)
    s, d = spark.createDataFrame(segments, "series_id bigint, series_key string"), spark.createDataFrame(log, "entry_id bigint, series_key string, seen int").repartition(5)
    got = {r["entry_id"]: r["seen"] for r in seen_before(s, d).collect()}
    assert got == plain_seen(segments, log)
    a = audit(s, d).first()
    assert (a["missed"], a["wrongly_seen"], a["records"]) == (0, 0, sum(k is not None for _, k, _ in log))


def test_short_fingerprints_err_on_one_side(spark):
    segments, log = log_of(8, 3000, 0.0)
    s, d = spark.createDataFrame(segments, "series_id bigint, series_key string"), spark.createDataFrame(log, "entry_id bigint, series_key string, seen int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        a = audit(s, d, 5).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert a["missed"] == 0 and 0 < a["wrong_rate"] < 0.25


def test_nothing_seen(spark):
    s, d = spark.createDataFrame([], "series_id bigint, series_key string"), spark.createDataFrame([], "entry_id bigint, series_key string")
    assert seen_before(s, d).collect() == []
    one = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "")], "entry_id bigint, series_key string")
    assert sorted(tuple(r) for r in seen_before(s, one).collect()) == [(1, False), (2, None), (3, False), (4, True)]
