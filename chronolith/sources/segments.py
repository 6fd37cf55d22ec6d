"""Logs of series: which ids were given to which keys, and taken away.

A segment is a header and entries: a flag, an id and, with an insertion, the
series' measurement and tags.  A partition's segments are numbered; one that is
full is followed by another.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockfile import file_system
from .codecs import CodecError, get_varint, put_varint

# The mark and version, the flags, the size of a partition's first segment (each next one is twice as large, up to the largest).
SEGMENT_HEADER = b"SSEG"
INSERT, TOMBSTONE = 1, 2
FIRST_SEGMENT, LARGEST_SEGMENT = 4 << 20, 256 << 20
#: An entry's offset: the segment's number above, the place in it below.
OFFSET_BITS = 32

def encode_series_key(measurement: str, tags: list[tuple[str, str]]) -> bytes:
    def text(t: str) -> bytes:
        b = t.encode()
        return struct.pack(">H", len(b)) + b

    return text(measurement) + put_varint(len(tags)) + b"".join(text(k) + text(v) for k, v in tags)


def decode_series_key(data: bytes, at: int = 0) -> tuple[str, list[tuple[str, str]], int]:
    """(measurement, tags, where it ends)."""

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from(">H", data, at)
        at += 2 + n
        if at > len(data):
            raise CodecError("a series key is cut off")
        return data[at - n : at].decode()

    try:
        name = text()
        count, at = get_varint(data, at)
        return name, [(text(), text()) for _ in range(count)], at
    except struct.error as e:
        raise CodecError("a series key is cut off") from e



Tags = list[tuple[str, str]]


def _entry(flag: int, number: int, name: str | None, tags: Tags | None) -> bytes:
    return struct.pack(">BQ", flag, number) + (encode_series_key(name, tags or []) if flag == INSERT else b"")


def write_segment(path: str, entries: list[tuple[int, int, str | None, Tags | None]]) -> None:
    """Entries (flag, series id, measurement, tags) as a log."""
    fs, at = file_system(path)
    with fs.open_output_stream(at + ".tmp") as f:
        f.write(SEGMENT_HEADER + b"\x01")
        for e in entries:
            f.write(_entry(*e))
    fs.move(at + ".tmp", at)


def segment_entries(data: bytes, path: str) -> Iterator[tuple[int, int, int, str | None, Tags | None]]:
    """(place, flag, series id, measurement, tags) of a segment's bytes; a zero flag ends it."""
    if data[:4] != SEGMENT_HEADER or data[4:5] != b"\x01":
        raise CodecError(f"{path} is not a series segment of version 1")
    at = 5
    while at < len(data) and data[at]:
        if at + 9 > len(data):
            raise CodecError(f"{path} is cut off")
        start, (flag, number) = at, struct.unpack_from(">BQ", data, at)
        at += 9
        if flag == INSERT:
            name, tags, at = decode_series_key(data, at)
            yield start, flag, number, name, tags
        elif flag == TOMBSTONE:
            yield start, flag, number, None, None
        else:
            raise CodecError(f"unknown flag {flag}")


def read_segment(path: str) -> Iterator[tuple[int, int, str | None, Tags | None]]:
    """The entries of a log."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        data = f.read()
    return (e[1:] for e in segment_entries(data, path))


_TAGS = "array<struct<tag:string,value:string>>"


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(partition_id, offset, flag, series_id, measurement, tags) of every entry of every partition below a folder.

    Segments are read whole by Spark's own file source, so any of its paths
    will do; the format bounds their size.  ``offset`` is unique in a partition.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                partition, segment = (int(x, 16) for x in path.rsplit("/", 2)[1:])
                rows = list(segment_entries(data, path))
                yield pa.RecordBatch.from_pydict(
                    {
                        "partition_id": pa.array([partition] * len(rows), pa.int32()), "offset": pa.array([segment << OFFSET_BITS | r[0] for r in rows], pa.int64()), "flag": pa.array([r[1] for r in rows], pa.int32()), "series_id": pa.array([r[2] for r in rows], pa.int64()),
                        "measurement": pa.array([r[3] for r in rows], pa.string()), "tags": pa.array([None if r[4] is None else [{"tag": k, "value": v} for k, v in r[4]] for r in rows], pa.list_(pa.struct([("tag", pa.string()), ("value", pa.string())]))),
                    }
                )

    return files.mapInArrow(run, f"partition_id int, offset bigint, flag int, series_id bigint, measurement string, tags {_TAGS}")


def write_segments(entries: DataFrame, folder: str, partitions: int = 8, first: int = FIRST_SEGMENT) -> int:
    """Writes (partition_id, flag, series_id, measurement, tags) as segments folder/partition/number; how many there are then.

    Within a partition entries go by series_id, an insertion before its
    tombstone.  A segment that is full is followed by one of twice the size.
    Nothing may be in the folder before.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, inside = file_system(folder)
        mark = f".tmp-{TaskContext.get().taskAttemptId()}"
        partition, number, size, out, made = None, 0, 0, None, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                path = f"{inside}/{partition:02x}/{number:04x}"
                fs.move(f"{inside}/_{partition:02x}{number:04x}{mark}", path)
                out = None

        for batch in batches:
            for p, flag, i, name, tags in zip(*(c.to_pylist() for c in batch.columns)):
                data = _entry(flag, i, name, [(t["tag"], t["value"]) for t in tags or []])
                if out is not None and (p != partition or size + len(data) > min(first << number, LARGEST_SEGMENT)):
                    close()
                    number += 1
                if p != partition:
                    partition, number = p, 0
                if out is None:
                    fs.create_dir(f"{inside}/{p:02x}", recursive=True)
                    out = fs.open_output_stream(f"{inside}/_{p:02x}{number:04x}{mark}")
                    out.write(SEGMENT_HEADER + b"\x01")
                    size, made = 5, made + 1
                out.write(data)
                size += len(data)
        close()
        yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.int64())})

    rows = entries.select(F.col("partition_id").cast("int"), F.col("flag").cast("int"), F.col("series_id").cast("long"), "measurement", "tags")
    spread = rows.repartition(partitions, "partition_id").sortWithinPartitions("partition_id", "series_id", "flag")
    return spread.mapInArrow(write, "made bigint").agg(F.sum("made")).first()[0] or 0


def series_offsets(entries: DataFrame) -> DataFrame:
    """(series_id, partition_id, offset) of the insertion of each live series."""
    gone = entries.where(F.col("flag") == TOMBSTONE).select("series_id")
    return entries.where(F.col("flag") == INSERT).join(gone, "series_id", "left_anti").groupBy("series_id").agg(F.min_by("partition_id", "offset").alias("partition_id"), F.min("offset").alias("offset"))


def delete_series(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The log with a tombstone for each series_id of ``gone`` that is live; the others stay as they are."""
    live = series_offsets(entries)
    marks = live.join(gone.select("series_id").distinct(), "series_id", "left_semi")
    marks = marks.select("partition_id", F.lit(TOMBSTONE).alias("flag"), "series_id", F.lit(None).cast("string").alias("measurement"), F.lit(None).cast(_TAGS).alias("tags"))
    return entries.select("partition_id", "flag", "series_id", "measurement", "tags").unionByName(marks)


def live_series(entries: DataFrame) -> DataFrame:
    """(series_id, series_key) of a log's series without a tombstone."""
    gone = entries.where(f"flag = {TOMBSTONE}").select("series_id").distinct()
    return entries.where(f"flag = {INSERT}").join(gone, "series_id", "left_anti").select("series_id", "series_key")
