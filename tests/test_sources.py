"""Codecs and files: golden bytes and round trips."""

import math
import random
import zlib
from decimal import Decimal

import pytest

from chronolith.engine import Engine
from chronolith.operators.storage import last_write
from chronolith.sources import codecs as C
from chronolith.sources.blockfile import BlockFileReader, BlockFileWriter, Entry, block_measurement, read_block_files, read_block_index, parts_of, write_block_files
from chronolith.sources.segments import INSERT, TOMBSTONE, decode_series_key, delete_series, encode_series_key, live_series, read_segment, read_segments, series_offsets, write_segment, write_segments


def test_golden_file(tmp_path):
    """One point: the bytes other implementations write."""
    path = str(tmp_path / "one.tsm")
    w = BlockFileWriter(path)
    w.write("cpu", "float", [0], [1.0])
    w.close()
    data = open(path, "rb").read()
    assert len(data) == 83 and zlib.crc32(data) == 1704948981


RNG = random.Random(1)
INTEGERS = [[], [5], [1, 2], [-3, 7, 100], [7] * 300, [1] * 241, list(range(0, 3000, 10)), list(range(100, 0, -1)), [-(1 << 63), (1 << 63) - 1, 0], [RNG.randrange(-(1 << 63), 1 << 63) for _ in range(50)], [RNG.randrange(1 << 20) for _ in range(999)], [0, 1 << 61, 5]]
TIMES = [[], [0], [-5], [1, 2], [10**18, 10**18 + 220 * 10**9], [k * 10**10 for k in range(100)], sorted(RNG.randrange(10**18) for _ in range(500)), [-(1 << 63), (1 << 63) - 1], [5, 3, 1], [0, 1000, 3000, 3500 * 1000], sorted(RNG.randrange(-(10**9), 10**9) * 1000 for _ in range(300))]
FLOATS = [[], [0.0], [1.0, 1.0, 1.0], [12.0, 12.5, 24.0, -0.0, math.inf, -math.inf, 5e-324], [3.4e37, 1.78e306, -1e300], [RNG.gauss(0, 1) for _ in range(500)], [float(k % 7) for k in range(120)], [6.00065e06, 6.000656e06, 6.000657e06, 6.000659e06, 6.000661e06]]


@pytest.mark.parametrize("values", INTEGERS)
def test_integers(values):
    assert C.decode_integers(C.encode_integers(values)) == values
    assert C.decode_unsigned(C.encode_unsigned([v % (1 << 64) for v in values])) == [v % (1 << 64) for v in values]


@pytest.mark.parametrize("values", TIMES)
def test_times(values):
    data = C.encode_times(values)
    assert C.decode_times(data) == values and C.count_times(data) == len(values)


def test_encodings_are_chosen_by_the_values():
    kinds = [C.encode_times(t)[0] for t in ([0, 10**10, 2 * 10**10], [0, 10, 30], [0, 1 << 61])]
    assert kinds == [C.REPEATED << 4 | 10, C.PACKED << 4 | 1, C.REPEATED << 4 | 0] and C.encode_times([0, 1 << 61, 5 + (1 << 61)])[0] == 0
    assert [C.encode_integers(v)[0] >> 4 for v in ([1, 2, 3], [1, 2], [0, 1 << 61, 0])] == [C.REPEATED, C.PACKED, C.RAW]


@pytest.mark.parametrize("values", FLOATS)
def test_floats(values):
    got = C.decode_floats(C.encode_floats(values))
    assert [math.copysign(1, x) for x in got] == [math.copysign(1, x) for x in values] and got == values


def test_no_nan():
    with pytest.raises(C.CodecError, match="unsupported value: NaN"):
        C.encode_floats([1.0, math.nan])


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 100])
def test_booleans_and_strings(n):
    flags = [RNG.random() < 0.5 for _ in range(n)]
    texts = [f"value {k} é" * (k % 3) for k in range(n)]
    assert C.decode_booleans(C.encode_booleans(flags)) == flags and C.decode_strings(C.encode_strings(texts)) == texts
    assert C.decode_booleans(b"") == C.decode_strings(b"") == []


def test_packed_words():
    for n, bits in C.PACKINGS:
        for v in ([1] * n, [(1 << bits) - 1] * n if bits else [1] * n):
            words = C.pack(v)
            assert C.unpack(words) == v and C.count_packed(words) == n
    assert C.unpack(C.pack([1] * 365)) == [1] * 365
    with pytest.raises(C.CodecError):
        C.pack([1 << 60])


def test_small_codes():
    for v in (0, 1, 127, 128, 300, (1 << 64) - 1):
        assert C.get_varint(C.put_varint(v)) == (v, len(C.put_varint(v)))
    assert [C.zigzag(v) for v in (0, -1, 1, -2)] == [0, 1, 2, 3] and all(C.unzigzag(C.zigzag(v)) == v for v in (0, -1, 5, -(1 << 63), (1 << 63) - 1))


@pytest.mark.parametrize("data", [b"\x30" + bytes(9), b"\x20" + bytes(3), b"\x10" + bytes(12), b"\x20" + bytes(8)])
def test_damaged_values(data):
    for decode in (C.decode_times, C.decode_integers):
        with pytest.raises(C.CodecError):
            decode(data)
    with pytest.raises(C.CodecError):
        C.decode_floats(b"\x10\x00")
    with pytest.raises(C.CodecError):
        C.decode_block(b"\x09")
    with pytest.raises(C.CodecError):
        C.decode_block(C.encode_block("float", [1], [1.0]), "integer")


def test_file_of_several_keys(tmp_path):
    path = str(tmp_path / "a.tsm")
    w = BlockFileWriter(path)
    data = {"a#!~#f": ("float", 2.5), "b#!~#i": ("integer", 7), "c#!~#b": ("boolean", True), "d#!~#s": ("string", "x"), "e#!~#u": ("unsigned", (1 << 64) - 1)}
    times = [k * 1000 for k in range(25)]
    for key, (kind, v) in data.items():
        w.write(key, kind, times, [v] * 25, block_points=10)
    for bad in (("a", "float", [1], [1.0]), ("z", "float", [2, 1], [1.0, 1.0]), ("z" * 70_000, "float", [1], [1.0])):
        with pytest.raises(ValueError):
            w.write(*bad)
    w.close()
    r = BlockFileReader(path)
    assert r.time_range() == (0, 24_000) and r.key_range() == ("a#!~#f", "e#!~#u") and r.block_type("c#!~#b") == "boolean"
    assert [len(r.entries(k)) for k in data] == [3] * 5 and r.entries("no") == [] and r.count("a#!~#f") == 25
    assert r.entry("a#!~#f", 10_000).min_time == 10_000 and r.entry("a#!~#f", 25_000) is None
    for key, (_, v) in data.items():
        assert list(r.read(key)) == [(t, v) for t in times]
        assert list(r.read(key, 5000, 11_000)) == [(t, v) for t in times[5:12]]
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(C.CodecError, match="damaged"):
        list(BlockFileReader(path).read("a#!~#f"))
    open(path, "wb").write(b"nothing")
    with pytest.raises(C.CodecError):
        BlockFileReader(path)
    assert Entry(1, 5, 0, 0).overlaps(5, 9) and not Entry(1, 5, 0, 0).overlaps(6, 9)


def test_spark_reads_and_writes_block_files(spark, tmp_path):
    rows = [(f"cpu,host=h{k % 7}", "usage", 1000 * k, float(k)) for k in range(3000)] + [("cpu,host=h0", "usage", 0, -5.0)]
    folder = str(tmp_path / "files")
    paths = write_block_files(spark.createDataFrame(rows, "series_key string, field string, time_ns bigint, value double"), folder, 3)
    assert 1 <= len(paths) <= 3
    got = sorted((r["series_key"], r["field"], r["time_ns"], r["as_float"]) for r in read_block_files(spark, folder).collect())
    assert got == sorted(r for r in rows if r[3] >= 0)
    some = read_block_files(spark, folder, mintime=5000, maxtime=9000, keyprefix="cpu,host=h").collect()
    assert sorted(r["time_ns"] for r in some) == [5000, 6000, 7000, 8000, 9000]
    # a later file wins
    w = BlockFileWriter(folder + "/z.tsm")
    w.write("cpu,host=h1#!~#usage", "float", [1000], [99.0])
    w.close()
    merged = last_write(read_block_files(spark, folder), ["series_key", "field", "time_ns"], ["file_seq"])
    assert merged.count() == 3000 and merged.where("time_ns = 1000").first()["as_float"] == 99.0
    assert read_block_files(spark, str(tmp_path / "none*")).collect() == []


def test_series_segments(spark, tmp_path):
    key = ("cpu", [("host", "a"), ("region", "é")])
    assert decode_series_key(encode_series_key(*key)) == (*key, len(encode_series_key(*key)))
    entries = [(INSERT, 1, *key), (INSERT, 9, "mem", []), (TOMBSTONE, 1, None, None)]
    path = str(tmp_path / "0000")
    write_segment(path, entries)
    assert list(read_segment(path)) == entries
    df = spark.createDataFrame([(f, i, None if m is None else ",".join([m, *(f"{k}={v}" for k, v in t)])) for f, i, m, t in read_segment(path)], "flag int, series_id bigint, series_key string")
    assert [tuple(r) for r in live_series(df).collect()] == [(9, "mem")]
    open(path, "ab").write(b"\x07" + bytes(8))
    with pytest.raises(C.CodecError):
        list(read_segment(path))


def test_index_lookups(tmp_path):
    path = str(tmp_path / "a.tsm")
    w = BlockFileWriter(path)
    for k in ("b", "d", "f"):
        w.write(k, "integer", [10, 20, 30], [1, 2, 3], block_points=2)
    w.write("f", "integer", [40], [4])
    for bad in (("f", "float", [50], [1.0]), ("f", "integer", [40], [1])):
        with pytest.raises(ValueError):
            w.write(*bad)
    w.close()
    r = BlockFileReader(path)
    assert [r.seek(k) for k in ("a", "b", "c", "g")] == [0, 0, 1, 3] and [r.search(k) for k in ("d", "e")] == [1, None]
    assert [r.key_at(k) for k in (0, 2, 3, -1)] == ["b", "f", None, None] and r.key_count() == 3
    assert r.contains("d") and not r.contains("e") and r.contains("d", 30) and not r.contains("d", 25) and len(r.entries("f")) == 3
    assert r.overlaps_keys("a", "b") and not r.overlaps_keys("g", "h") and r.overlaps_times(40, 90) and not r.overlaps_times(41, 90)
    assert list(r.read("f", 20, 40)) == [(20, 2), (30, 3), (40, 4)]


TYPED = "series_key string, field string, time_ns bigint, as_float double, as_integer bigint, as_boolean boolean, as_string string, as_unsigned decimal(20,0)"


def test_a_heavy_key_and_all_types(spark, tmp_path):
    """A key with most points is spread over files and blocks are whole; values of all types come back."""
    folder = str(tmp_path / "f")
    heavy = spark.range(20_000).selectExpr("'hot' series_key", "'v' field", "id * 7 time_ns", "cast(null as double) as_float", "id as_integer", "cast(null as boolean) as_boolean", "cast(null as string) as_string", "cast(null as decimal(20,0)) as_unsigned")
    rest = [("m,a=é", "f", 5, 1.5, None, None, None, None), ("m,a=é", "b", 5, None, None, True, None, None), ("m,a=é", "s", 5, None, None, None, "", None), ("m,a=é", "u", 5, None, None, None, None, Decimal((1 << 64) - 1)), ("m,a=é", "n", 5, None, None, None, None, None), (None, "n", 5, 1.0, None, None, None, None)]
    paths = write_block_files(heavy.unionByName(spark.createDataFrame(rest, TYPED)), folder, 4)
    assert len(paths) == 4
    index = read_block_index(spark, folder)
    of_hot = index.where("key = 'hot#!~#v'").collect()
    assert len({r["path"] for r in of_hot}) >= 3 and sum(r["points"] for r in of_hot) == 20_000 and sorted(r["points"] for r in of_hot)[5:-1] == [1000] * (len(of_hot) - 6)
    got = read_block_files(spark, folder, series=["m,a=é"]).collect()
    assert sorted((r["field"], r["type"], r["as_float"], r["as_boolean"], r["as_string"], r["as_unsigned"]) for r in got) == [("b", "boolean", None, True, None, None), ("f", "float", 1.5, None, None, None), ("s", "string", None, None, "", None), ("u", "unsigned", None, None, None, str((1 << 64) - 1))]
    mixed = spark.createDataFrame([("m", "f", 1, 1.0, None, None, None, None), ("m", "f", 2, None, 1, None, None, None)], TYPED)
    with pytest.raises(Exception, match="values of several types"):
        write_block_files(mixed, str(tmp_path / "mixed"), 1)
    assert write_block_files(mixed.limit(0), str(tmp_path / "none"), 2) == [] and read_block_files(spark, str(tmp_path / "none")).count() == 0


def test_conditions_choose_blocks(spark, tmp_path):
    """A damaged block that no condition wants is not read."""
    folder = str(tmp_path / "f")
    rows = [(k, "v", t, float(t)) for k in ("a", "b") for t in range(3000)]
    (path,) = write_block_files(spark.createDataFrame(rows, "series_key string, field string, time_ns bigint, value double"), folder, 1)
    e = BlockFileReader(path).entries("a#!~#v")[1]
    raw = bytearray(open(path, "rb").read())
    raw[e.offset + 9] ^= 1
    open(path, "wb").write(raw)
    n = lambda **o: read_block_files(spark, folder, **o).count()
    assert n(keyprefix="b") == n(series=["b", "c"]) == n(tags={"x": ["", "y"]}, series=["b"]) == 3000 and n(maxtime=999) == 2000 and n(mintime=2500, fields=["v", "w"]) == 1000 and n(tags={"x": ["y"]}) == 0
    with pytest.raises(Exception, match="damaged"):
        n()
    e = Engine(spark)
    block_measurement(e.catalog, "b", folder, ["host"], {"v": "float", "w": "integer"})
    assert e.sql("SELECT count(v) FROM b WHERE time < 10 OR time > 2990").first()["count"] == 19 and e.sql("SELECT max(v) FROM b WHERE (time < 10) AND host = ''").first()["max"] == 9.0
    block_measurement(e.catalog, "a", folder, ["host"], {"v": "float"})
    assert e.sql("SELECT count(v) FROM a WHERE time >= 2000us * 1 - 1997000").first()["count"] == 0 and e.sql("SELECT v FROM a WHERE time >= 2990").count() == 10
    with pytest.raises(Exception, match="damaged"):
        e.sql("SELECT count(v) FROM a WHERE time > 5 OR host = 'x'").collect()


def test_parts_of_a_key():
    assert parts_of("m\\,x,a=1,b=c\\,d\\=e=f,g=,h,i\\ j= k") == ("m,x", {"a": "1", "b": "c,d=e=f", "i j": " k"})


def test_segments_roll_over(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "s")
    ids = spark.range(1, 2001)
    log = ids.select((F.pmod(F.col("id") - 1, F.lit(8))).alias("partition_id"), F.lit(INSERT).alias("flag"), F.col("id").alias("series_id"), F.lit("m").alias("measurement"), F.expr("array(struct('host' as tag, concat('h', id) as value))").alias("tags"))
    n = write_segments(log, folder, first=2000)
    back = read_segments(spark, folder)
    assert n > 16 and back.count() == 2000 and back.select("partition_id", "offset").distinct().count() == 2000
    at = {r["series_id"]: (r["partition_id"], r["offset"]) for r in series_offsets(back).collect()}
    assert len(at) == 2000 and all(at[r["series_id"]] == (r["partition_id"], r["offset"]) for r in back.collect())
    assert len({o >> 32 for p, o in at.values() if p == 0}) > 1
    after = delete_series(back, spark.createDataFrame([(5,), (7,), (7,), (9999,)], "series_id bigint"))
    write_segments(after, str(tmp_path / "t"))
    again = read_segments(spark, str(tmp_path / "t"))
    assert again.count() == 2002 and series_offsets(again).count() == 1998
    assert series_offsets(delete_series(again, spark.createDataFrame([(5,)], "series_id bigint"))
                          .withColumn("offset", F.lit(1))).count() == 1998
