"""Block files as a source and a sink.

A block file is a header, blocks with checksums, an index sorted by key, and
the offset of the index.  The driver only lists files; a reading task takes a
stretch of bytes of one file (or several small files), reads the index once and
of its stretch the blocks that the wanted keys and times need.  Paths are local
or any that Arrow's file systems open (``s3://``, ``gs://``, ``hdfs://``, …).
"""

from __future__ import annotations

import bisect
import fnmatch
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import SPARK_TYPES, Catalog
from ..functions.series_keys import key_measurement, key_tags
from .codecs import TYPES, CodecError, block_arrays, block_count, decode_block, encode_block

# The magic number and version, limits, the mark between series and field.
HEADER = bytes.fromhex("16d116d101")
MOST_KEY_BYTES = 65_535
MOST_BLOCKS = 65_535
MOST_FILE_BYTES = 2 << 30
FIELD_MARK = "#!~#"
#: Points of a written block.
BLOCK_POINTS = 1000
#: Bytes of files that a reading task takes.
TASK_BYTES = 64 << 20
#: Points of a batch that a reading task hands on.
BATCH_POINTS = 1 << 16

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_ENTRY = np.dtype([("min_time", ">i8"), ("max_time", ">i8"), ("offset", ">u8"), ("size", ">u4")])


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder that end in ``suffix``, or of a pattern for the last part of a path; sorted."""
    fs, at = file_system(path)
    root = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        folder, pattern = (at, "*" + suffix) if info.type == pafs.FileType.Directory else at.rstrip("/").rpartition("/")[::2]
        found = fs.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
        found = [i for i in found if i.type == pafs.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern)]
    return sorted((root + i.path, i.size) for i in found)


@dataclass
class Entry:
    min_time: int
    max_time: int
    offset: int
    size: int

    def overlaps(self, low: int, high: int) -> bool:
        return self.min_time <= high and self.max_time >= low


class BlockFileWriter:
    """Writes one file; keys in ascending order, times of a key too.

    The file is written beside its place, under ``mark`` of who writes it, and
    moved there when it is complete.
    """

    def __init__(self, path: str, mark: str = "tmp"):
        self.fs, self.path = file_system(path)
        self.beside = f"{self.path}.{mark}"
        self.file, self.at = self.fs.open_output_stream(self.beside), 0
        self.index: list[tuple[bytes, str, list[Entry]]] = []

    def write(self, key: str, kind: str, times: list[int] | np.ndarray, values: list | np.ndarray, block_points: int = BLOCK_POINTS) -> None:
        """A key's points; another call with the same key goes on with it."""
        name = key.encode()
        if len(name) > MOST_KEY_BYTES:
            raise ValueError("key too long")
        t = np.asarray(times, np.int64)
        if (t[:-1] >= t[1:]).any():
            raise ValueError("times must ascend and differ")
        goes_on = bool(self.index) and name == self.index[-1][0]
        if self.index and (name < self.index[-1][0] or (goes_on and (kind != self.index[-1][1] or (len(t) and t[0] <= self.index[-1][2][-1].max_time)))):
            raise ValueError("keys must ascend, and times and types within a key agree")
        if not len(t):
            return
        entries = self.index[-1][2] if goes_on else []
        if len(entries) + -(-len(t) // block_points) > MOST_BLOCKS:
            raise ValueError("too many blocks for a key")
        for k in range(0, len(t), block_points):
            part = t[k : k + block_points]
            block = encode_block(kind, part, values[k : k + block_points])
            if not self.at:
                self._put(HEADER)
            entries.append(Entry(int(part[0]), int(part[-1]), self.at, len(block) + 4))
            self._put(struct.pack(">I", zlib.crc32(block)) + block)
        if not goes_on:
            self.index.append((name, kind, entries))

    def full(self, key: str) -> bool:
        """Whether what follows of a key should go to another file."""
        return self.at >= MOST_FILE_BYTES // 2 or (bool(self.index) and self.index[-1][0] == key.encode() and len(self.index[-1][2]) >= MOST_BLOCKS // 2)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def close(self) -> None:
        """Writes the index and puts the file in its place; nothing is there before."""
        if not self.at:
            self._put(HEADER)
        start = self.at
        for name, kind, entries in self.index:
            self._put(struct.pack(">H", len(name)) + name + bytes([TYPES.index(kind)]) + struct.pack(">H", len(entries)))
            self._put(np.array([(e.min_time, e.max_time, e.offset, e.size) for e in entries], _ENTRY).tobytes())
        self._put(struct.pack(">Q", start))
        self.file.close()
        self.fs.move(self.beside, self.path)

    def remove(self) -> None:
        self.file.close()
        self.fs.delete_file(self.beside)


class BlockFileReader:
    """Reads one file: its index at once, blocks as they are asked for."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.path, self.file = path, fs.open_input_file(at)
        size = self.file.size()
        if size < 13 or self.file.read_at(5, 0) != HEADER:
            raise CodecError(f"{path} is not a block file of version 1")
        (start,) = struct.unpack(">Q", self.file.read_at(8, size - 8))
        if not 5 <= start <= size - 8:
            raise CodecError(f"{path} has no index")
        data = self.file.read_at(size - 8 - start, start)
        #: type and entries (an array) of each key, in the keys' order
        self.arrays: dict[str, tuple[str, np.ndarray]] = {}
        at = 0
        try:
            while at < len(data):
                (n,) = struct.unpack_from(">H", data, at)
                name = data[at + 2 : at + 2 + n].decode()
                kind, count = struct.unpack_from(">BH", data, at + 2 + n)
                self.arrays[name] = (TYPES[kind], np.frombuffer(data, _ENTRY, count, at + 5 + n))
                at += 5 + n + _ENTRY.itemsize * count
        except (struct.error, IndexError, ValueError) as e:
            raise CodecError(f"{path}: the index is cut off") from e
        self.names = [k.encode() for k in self.arrays]

    def close(self) -> None:
        self.file.close()

    # -- the index ----------------------------------------------------------------------------------
    @property
    def keys(self) -> dict[str, tuple[str, list[Entry]]]:
        return {k: (kind, self.entries(k)) for k, (kind, _) in self.arrays.items()}

    def key_count(self) -> int:
        return len(self.names)

    def key_at(self, place: int) -> str | None:
        """The key at a place of the index, from 0."""
        return self.names[place].decode() if 0 <= place < len(self.names) else None

    def seek(self, key: str) -> int:
        """The place of the first key that is not less; the number of keys if there is none."""
        return bisect.bisect_left(self.names, key.encode())

    def search(self, key: str) -> int | None:
        """The place of a key."""
        at = self.seek(key)
        return at if self.key_at(at) == key else None

    def contains(self, key: str, time: int | None = None) -> bool:
        """Whether it has the key, or a block of it that may hold a time."""
        return key in self.arrays if time is None else self.entry(key, time) is not None

    def time_range(self) -> tuple[int, int] | None:
        if not self.arrays:
            return None
        return min(int(e["min_time"].min()) for _, e in self.arrays.values()), max(int(e["max_time"].max()) for _, e in self.arrays.values())

    def key_range(self) -> tuple[str, str] | None:
        return (self.names[0].decode(), self.names[-1].decode()) if self.names else None

    def overlaps_times(self, low: int, high: int) -> bool:
        own = self.time_range()
        return own is not None and own[0] <= high and own[1] >= low

    def overlaps_keys(self, low: str, high: str) -> bool:
        return bool(self.names) and self.names[0] <= high.encode() and self.names[-1] >= low.encode()

    def block_type(self, key: str) -> str:
        return self.arrays[key][0]

    def entries(self, key: str) -> list[Entry]:
        return [Entry(*e) for e in self.arrays[key][1].tolist()] if key in self.arrays else []

    def entry(self, key: str, time: int) -> Entry | None:
        """The block that may hold a time."""
        return next((e for e in self.entries(key) if e.overlaps(time, time)), None)

    # -- blocks ---------------------------------------------------------------------------------------
    def block_at(self, offset: int, size: int) -> bytes:
        data = self.file.read_at(size, offset)
        if len(data) != size or struct.unpack(">I", data[:4])[0] != zlib.crc32(data[4:]):
            raise CodecError(f"{self.path}: the block at {offset} is damaged")
        return data[4:]

    def read_block(self, e: Entry) -> bytes:
        return self.block_at(e.offset, e.size)

    def blocks(self, key: str) -> Iterator[bytes]:
        return (self.read_block(e) for e in self.entries(key))

    def read(self, key: str, low: int = _LEAST, high: int = _MOST) -> Iterator[tuple[int, object]]:
        """(time, value) of a key from low to high, block by block."""
        for e in self.entries(key):
            if e.overlaps(low, high):
                _, times, values = decode_block(self.read_block(e))
                yield from ((t, v) for t, v in zip(times, values) if low <= t <= high)

    def count(self, key: str) -> int:
        """Points of a key, without decoding them."""
        return sum(map(block_count, self.blocks(key)))


# -- the source ------------------------------------------------------------------------------------

_ARROW = {"float": pa.float64(), "integer": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "unsigned": pa.uint64()}
_COLUMNS = ("file_seq", "series_key", "field", "type", "time_ns", *(f"as_{t}" for t in TYPES))


class _Stretches(InputPartition):
    """(path, number of the file, first byte, byte after the last) of what a task reads."""

    def __init__(self, files: list[tuple[str, int, int, int]]):
        super().__init__(0)
        self.files = files


class _Batch:
    """Blocks on their way to a batch."""

    def __init__(self):
        self.heads: list[tuple[int, str, str | None, str]] = []
        self.times: list[np.ndarray] = []
        self.values: list[np.ndarray | list[str]] = []
        self.points = 0

    def add(self, head: tuple[int, str, str | None, str], times: np.ndarray, values) -> None:
        self.heads.append(head)
        self.times.append(times)
        self.values.append(values)
        self.points += len(times)

    def made(self) -> pa.RecordBatch:
        n = np.array([len(t) for t in self.times])
        owner = pa.array(np.repeat(np.arange(len(n)), n))
        first = np.concatenate([[0], np.cumsum(n)])
        numbers, series, fields, kinds = zip(*self.heads)
        columns = [pa.array(numbers, pa.int32()).take(owner), pa.array(series, pa.string()).take(owner), pa.array(fields, pa.string()).take(owner), pa.array(kinds, pa.string()).take(owner), pa.array(np.concatenate(self.times))]
        for t in TYPES:
            of = [k for k, kind in enumerate(kinds) if kind == t]
            if not of:
                columns.append(pa.nulls(self.points, pa.string() if t == "unsigned" else _ARROW[t]))
                continue
            where = np.full(self.points, -1)
            where[np.concatenate([np.arange(first[k], first[k + 1]) for k in of])] = np.arange(sum(n[k] for k in of))
            own = pa.concat_arrays([pa.array(self.values[k], _ARROW[t]) for k in of])
            column = own.take(pa.array(where, mask=where < 0))
            columns.append(column.cast(pa.string()) if t == "unsigned" else column)
        return pa.RecordBatch.from_arrays(columns, _COLUMNS)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.low = int(options.get("mintime", _LEAST))
        self.high = int(options.get("maxtime", _MOST))
        self.prefix = options.get("keyprefix", "")
        #: what a series key or a field must be one of
        self.series, self.fields = (frozenset(json.loads(options[o])) if o in options else None for o in ("series", "fields"))
        self.measurement = options.get("measurement")
        self.tags: dict[str, list[str]] = json.loads(options.get("tags", "{}"))

    def partitions(self) -> list[InputPartition]:
        out, part, size = [], [], 0
        for number, (name, n) in enumerate(list_files(self.path, ".tsm")):
            for start in range(0, n, TASK_BYTES):
                stop = min(n, start + TASK_BYTES)
                if part and size + stop - start > TASK_BYTES:
                    out.append(_Stretches(part))
                    part, size = [], 0
                part.append((name, number, start, stop))
                size += stop - start
        if part or not out:
            out.append(_Stretches(part))
        return out

    def wanted(self, key: str) -> bool:
        series, _, field = key.partition(FIELD_MARK)
        if not key.startswith(self.prefix) or (self.series is not None and series not in self.series) or (self.fields is not None and field not in self.fields):
            return False
        if self.measurement is None and not self.tags:
            return True
        name, own = parts_of(series)
        return self.measurement in (None, name) and all(own.get(t, "") in values for t, values in self.tags.items())

    def read(self, partition: _Stretches) -> Iterator[pa.RecordBatch]:
        batch = _Batch()
        for name, number, start, stop in partition.files:
            reader = BlockFileReader(name)
            for key, (kind, entries) in reader.arrays.items():
                if not self.wanted(key):
                    continue
                series, _, field = key.partition(FIELD_MARK)
                of = entries[(entries["offset"] >= start) & (entries["offset"] < stop) & (entries["min_time"] <= self.high) & (entries["max_time"] >= self.low)]
                for e in of:
                    _, times, values = block_arrays(reader.block_at(int(e["offset"]), int(e["size"])), kind)
                    if e["min_time"] < self.low or e["max_time"] > self.high:
                        keep = (times >= self.low) & (times <= self.high)
                        times, values = times[keep], [v for v, k in zip(values, keep) if k] if isinstance(values, list) else values[keep]
                    batch.add((number, series, field or None, kind), times, values)
                    if batch.points >= BATCH_POINTS:
                        yield batch.made()
                        batch = _Batch()
            reader.close()
        if batch.points:
            yield batch.made()


def parts_of(series_key: str) -> tuple[str, dict[str, str]]:
    """(measurement, tags) of a key text; a backslash makes a comma, an equals sign or a blank part of a name or value."""
    name, *pieces = re.split(r"(?<!\\),", series_key)
    pairs = (re.split(r"(?<!\\)=", p, maxsplit=1) for p in pieces)
    plain = lambda t: re.sub(r"\\([,= ])", r"\1", t)
    return plain(name), {plain(p[0]): plain(p[1]) for p in pairs if len(p) == 2 and p[1]}


class BlockFileSource(DataSource):
    """``spark.read.format("blockfile").load(path)``: all points of a file or of a folder's *.tsm files.

    Options choose the blocks that are read: ``mintime`` and ``maxtime``
    (nanoseconds, included), ``keyprefix``, ``measurement``, ``series`` and
    ``fields`` (JSON lists) and ``tags`` (a JSON object of the values that a tag may have, the
    empty text for none).  Conditions on the DataFrame choose nothing: Spark 4.1
    keeps the filters that one query pushed into a Python source for the next
    query over the same DataFrame.  A measurement bound by
    ``block_measurement`` gets these options from a statement's WHERE.
    ``file_seq`` numbers the files by name, so that ``last_write`` merges
    overlapping ones.  as_unsigned is text, since it may exceed a long.
    """

    @classmethod
    def name(cls) -> str:
        return "blockfile"

    def schema(self) -> str:
        return "file_seq int, series_key string, field string, type string, time_ns bigint, as_float double, as_integer bigint, as_boolean boolean, as_string string, as_unsigned string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_block_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The points of block files; ``options`` as of ``BlockFileSource``, lists and objects as they are."""
    spark.dataSource.register(BlockFileSource)
    reader = spark.read.format("blockfile")
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v) if isinstance(v, dict) else json.dumps(sorted(v)) if isinstance(v, (list, tuple, set, frozenset)) else str(v))
    return reader.load(path)


def block_measurement(catalog: Catalog, name: str, path: str, tags: list[str], fields: dict[str, str]) -> None:
    """Binds a folder of block files as a measurement with times in nanoseconds; ``fields`` are names and types.

    A statement reads the blocks of its bounds of time, its tags' values and the
    fields it names.  Of a series, field and time the latest file's value counts.
    """
    spark = catalog.spark

    def points(low: int | None, high: int | None, wanted: dict[str, set[str]], used: set[str] | None) -> DataFrame:
        own = [f for f in fields if used is None or f in used] or list(fields)[:1]
        bounds = {k: v for k, v in (("mintime", low), ("maxtime", high)) if v is not None}
        if wanted:
            bounds["tags"] = {t: sorted(v) for t, v in wanted.items()}
        rows = read_block_files(spark, path, measurement=name, fields=own, **bounds)
        rows = rows.where(key_measurement("series_key") == name)
        cells = [F.max_by(F.when(F.col("field") == f, F.col(f"as_{fields[f]}")), F.when(F.col("field") == f, F.col("file_seq"))).cast(SPARK_TYPES[fields[f]]).alias(f) for f in own]
        wide = rows.groupBy("series_key", "time_ns").agg(*cells).withColumn("__tags", F.map_from_entries(key_tags("series_key")))
        missing = [F.lit(None).cast(SPARK_TYPES[fields[f]]).alias(f) for f in fields if f not in own]
        return wide.select(F.col("time_ns").alias("time"), *[F.try_element_at("__tags", F.lit(t)).alias(t) for t in tags], *own, *missing)

    catalog.add(name, points(None, None, {}, None), "time", tags, list(fields), nanos=True, finite=True).scan = points


_INDEX = "file_seq int, path string, key string, place int, type string, min_time bigint, max_time bigint, block_offset bigint, block_size bigint, points bigint"


def read_block_index(spark: SparkSession, path: str) -> DataFrame:
    """(file_seq, path, key, place, type, min_time, max_time, block_offset, block_size, points): every block of every file.

    ``place`` is the key's in its file's index; points are counted from the
    blocks' timestamps without decoding them.
    """
    files = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(list_files(path, ".tsm"))], "file_seq int, path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name in zip(*(c.to_pylist() for c in batch.columns)):
                reader = BlockFileReader(name)
                for place, (key, (kind, e)) in enumerate(reader.arrays.items()):
                    n = len(e)
                    points = [block_count(reader.block_at(int(x["offset"]), int(x["size"]))) for x in e]
                    whole = [pa.array(e[c].astype(np.int64)) for c in ("min_time", "max_time", "offset", "size")]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array([name] * n), pa.array([key] * n), pa.array([place] * n, pa.int32()), pa.array([kind] * n), *whole, pa.array(points, pa.int64())], [c.split()[0] for c in _INDEX.split(", ")])
                reader.close()

    return files.repartition(max(1, files.count())).mapInArrow(run, _INDEX) if files.take(1) else spark.createDataFrame([], _INDEX)


# -- the sink --------------------------------------------------------------------------------------

_KINDS = {T.DoubleType: "float", T.LongType: "integer", T.BooleanType: "boolean", T.StringType: "string", T.DecimalType: "unsigned"}


def write_block_files(points: DataFrame, folder: str, files: int, generation: int = 0) -> list[str]:
    """Writes points as ``files`` or more block files in a folder that all executors share; the files' paths.

    ``points`` is (series_key, field, time_ns) with a column ``value`` of the
    one type, or columns as_float, as_integer, as_boolean, as_string and
    as_unsigned (any of them), of which a point has one.  A key has values of
    one type, or it is an error.  Files hold ranges of (key, time): a key with many
    points is in several, whose times do not overlap; of a repeated time the greatest value is
    kept.  A file appears when it is complete, under a name that only its
    contents' partition decides, so a task that runs again replaces it.  Files of
    a later ``generation`` come after those of earlier ones in the same folder.
    """
    kinds = {f.name: _KINDS[type(f.dataType)] for f in points.schema if f.name == "value"} or {f"as_{t}": t for t in TYPES if f"as_{t}" in points.columns}
    columns = list(kinds)
    own = points.select(F.concat_ws(FIELD_MARK, "series_key", "field").alias("key"), "time_ns", *[F.col(c).cast("decimal(20,0)").alias(c) if kinds[c] == "unsigned" else F.col(c) for c in columns])
    own = own.where(F.col("key").isNotNull() & F.col("time_ns").isNotNull() & F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    own = own.groupBy("key", "time_ns").agg(*[F.max(c).alias(c) for c in columns])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get()
        fs, inside = file_system(folder)
        fs.create_dir(inside, recursive=True)
        made, writer, held = [], None, None
        written = 0

        def opened() -> BlockFileWriter:
            made.append(f"{folder}/{generation:04d}{at.partitionId():05d}-{len(made) + 1:02d}.tsm")
            return BlockFileWriter(made[-1], f"tmp-{at.taskAttemptId()}")

        def put(key: str, kind: str, times: np.ndarray, values) -> None:
            nonlocal writer, written
            if writer is not None and writer.full(key):
                writer.close()
                writer = None
            writer = writer or opened()
            writer.write(key, kind, times, values)
            written += len(times)

        def flush(whole: bool) -> None:
            """Writes what is held of the last key; without ``whole`` only full blocks."""
            nonlocal held
            key, kind, times, values = held
            n = len(times) if whole else len(times) - len(times) % BLOCK_POINTS
            if n:
                put(key, kind, times[:n], values[:n])
            held = None if whole else (key, kind, times[n:], values[n:])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            codes = keys.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            times = batch.column(1).to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                key = keys.dictionary[int(codes[a])].as_py()
                of = [c for c in columns if batch.column(2 + columns.index(c)).slice(a, b - a).null_count < b - a]
                column = batch.column(2 + columns.index(of[0])).slice(a, b - a)
                if len(of) > 1 or column.null_count or (held and held[0] == key and held[1] != kinds[of[0]]):
                    raise CodecError(f"{key} has values of several types")
                kind = kinds[of[0]]
                values = column.to_pylist() if kind == "string" else np.array([int(v) for v in column.to_pylist()], np.uint64) if kind == "unsigned" else column.to_numpy(zero_copy_only=False)
                if held and held[0] != key:
                    flush(True)
                if held:
                    values = held[3] + values if kind == "string" else np.concatenate([held[3], values])
                    held = (key, kind, np.concatenate([held[2], times[a:b]]), values)
                else:
                    held = (key, kind, times[a:b], values)
                flush(False)
        if held and len(held[2]):
            flush(True)
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([written] * len(made), pa.int64())], ["path", "points"])

    # ranges, so that a key with most of the points is spread too
    spread = own.repartitionByRange(files, "key", "time_ns").sortWithinPartitions("key", "time_ns")
    return sorted(r["path"] for r in spread.mapInArrow(write, "path string, points bigint").collect())
