"""Overlapping and gapped ranges: continuous periods and the gaps between them (problem 2).

Time is discrete, in units of the ranges' integers.  It is cut into shards of
2**SHARD_BITS units; of an entity and shard, the covered units are a run bitmap.
A range across shards sets a run in its first and last shard and, in a bitmap
of whole shards, one run for all between, so its length costs nothing.  Tasks
union what they read before it is shuffled, entity and shard, so that an entity
with most ranges is spread over its shards.  What lies inside a shard is final;
only its first and last run meet the neighbours, in a window of at most a few
rows a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BITS = 46
#: What shard numbers are raised by, to be positive in the bitmap of whole shards.
_RAISE = 1 << (63 - SHARD_BITS)
ABSENT = -(1 << 63)


def encode_runs(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Run bitmaps: of each, the lengths of clear and set runs in turn.  ``bounds``: where the runs of each begin, and the end."""
    before = np.empty(len(ends), np.int64)
    before[1:] = ends[:-1]
    before[bounds[:-1][bounds[:-1] < len(ends)]] = -1
    flat = np.empty(2 * len(starts), np.int64)
    flat[0::2] = starts - before - 1
    flat[1::2] = ends - starts + 1
    return pa.ListArray.from_arrays(pa.array(2 * bounds, pa.int32()), pa.array(flat))


def decode_runs(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first unit of each run, last unit, ``bounds``) of run bitmaps."""
    bounds = runs.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    edges = np.concatenate([[0], np.cumsum(runs.flatten().to_numpy())])
    edges = edges[1:] - np.repeat(edges[bounds[:-1]], np.diff(bounds))
    return edges[0::2], edges[1::2] - 1, bounds // 2


#: Groups united at a time.
_GROUPS = 1 << (62 - SHARD_BITS)


def union_runs(group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites the runs of each group, which is a number from 0; units from 0 to 2**SHARD_BITS - 1."""
    top = int(group.max(initial=-1)) + 1
    if top > _GROUPS:
        parts = [(first, (group >= first) & (group < first + _GROUPS)) for first in range(0, top, _GROUPS)]
        made = [(first, union_runs(group[m] - first, starts[m], ends[m])) for first, m in parts]
        return np.concatenate([f + x[0] for f, x in made]), np.concatenate([x[1] for _, x in made]), np.concatenate([x[2] for _, x in made])
    base = group.astype(np.int64) << SHARD_BITS
    order = np.argsort(base + starts, kind="stable")
    g, a, b = group[order], (base + starts)[order], (base + ends)[order]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] > reach[:-1] + 1) | (g[1:] != g[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(a)) - 1 if len(a) else begin
    mask = (1 << SHARD_BITS) - 1
    return g[begin], a[begin] & mask, reach[last] & mask


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number from 0 for each different row of these columns."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = pd.factorize(c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False))[0]
        code = pd.factorize(code * (own.max(initial=0) + 1) + own)[0]
    return code


def _to_bitmaps(n_keys: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes(batch.columns[:n_keys])
            g, s, e = union_runs(code, batch.column(n_keys).to_numpy(), batch.column(n_keys + 1).to_numpy())
            count = int(code.max()) + 1
            example = np.empty(count, np.int64)
            example[code] = np.arange(len(code))
            at = pa.array(example)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n_keys)), encode_runs(s, e, np.searchsorted(g, np.arange(count + 1)))], names)

    return run


def _union_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(batch.num_columns - 1)
        each = np.diff(lists.offsets.to_numpy())
        s, e, bounds = decode_runs(lists.flatten())
        g, s, e = union_runs(np.repeat(np.repeat(np.arange(len(each)), each), np.diff(bounds)), s, e)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], encode_runs(s, e, np.searchsorted(g, np.arange(len(each) + 1)))], [*batch.schema.names[:-1], "runs"])


def _insides(n_keys: int, names: list[str]):
    """Of each bitmap: the runs and gaps between its first and its last run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, e, bounds = decode_runs(batch.column(n_keys + 1))
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            base = batch.column(n_keys).to_numpy()[owner] << SHARD_BITS
            k = np.arange(len(s))
            first, last = k == bounds[owner], k == bounds[owner + 1] - 1
            inner, gap = np.flatnonzero(~first & ~last), np.flatnonzero(~first)
            row = pa.array(np.concatenate([owner[inner], owner[gap]]))
            lo = np.concatenate([s[inner] + base[inner], e[gap - 1] + 1 + base[gap]])
            hi = np.concatenate([e[inner] + base[inner], s[gap] - 1 + base[gap]])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(n_keys + 1)), pa.array(lo), pa.array(hi), pa.array(np.arange(len(lo)) >= len(inner))], names)

    return run


def _edges(n_keys: int, names: list[str]):
    """Of each bitmap: its first and its last run; of one, that run alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, e, bounds = decode_runs(batch.column(n_keys + 1))
            base = batch.column(n_keys).to_numpy() << SHARD_BITS
            first, last = bounds[:-1], bounds[1:] - 1
            more = np.flatnonzero(last > first)
            owner = np.concatenate([np.arange(len(first)), more])
            k = np.concatenate([first, last[more]])
            row = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(n_keys + 1)), pa.array(s[k] + base[owner]), pa.array(e[k] + base[owner]), pa.array(np.arange(len(k)) >= len(first))], names)

    return run


def periods_and_gaps(ranges: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """(keys..., is_gap, first, last): the continuous periods of each entity and the gaps between them.

    Ranges hold both their ends; ranges that touch (a unit apart) are
    continuous.  A range counts if its keys and both ends are present (neither
    null nor -2**63) and low <= high.  An entity without a counted range gives
    no row.  Repeated ranges change nothing; other columns are not read.  Key
    columns must not be called first, last, shard or runs.
    """
    n = len(keys)
    lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
    counted = ranges.select(*keys, lo.alias("__lo"), hi.alias("__hi")).where((F.col("__lo") <= F.col("__hi")) & (F.col("__lo") != ABSENT) & (F.col("__hi") != ABSENT))
    for k in keys:
        counted = counted.where(F.col(k).isNotNull())
    mask = (1 << SHARD_BITS) - 1
    s, e = F.shiftright("__lo", SHARD_BITS), F.shiftright("__hi", SHARD_BITS)
    within_lo, within_hi = F.col("__lo").bitwiseAND(mask), F.col("__hi").bitwiseAND(mask)

    def piece(whole: bool, shard, a, b):
        return F.struct(F.lit(whole).alias("whole"), shard.cast("long").alias("shard"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    pieces = F.when(s == e, F.array(piece(False, s, within_lo, within_hi))).otherwise(
        F.filter(
            F.array(
                piece(False, s, within_lo, F.lit(mask)), piece(False, e, F.lit(0), within_hi),
                F.when(e > s + 1, piece(True, F.lit(0), s + 1 + _RAISE, e - 1 + _RAISE)),
            ),
            lambda p: p.isNotNull(),
        )
    )
    cut = counted.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.whole", "p.shard", "p.a", "p.b")
    kinds = [cut.schema[k] for k in (*keys, "whole", "shard")]
    grouped = [*keys, "whole", "shard"]
    blob = T.StructType([*kinds, T.StructField("runs", T.ArrayType(T.LongType()))])
    # a task sends one bitmap for each group of a batch, so a list is as long as there are batches
    bitmaps = cut.mapInArrow(_to_bitmaps(n + 2, blob.names), blob).groupBy(*grouped).agg(F.collect_list("runs").alias("runs")).mapInArrow(_union_bitmaps, blob)
    shards = bitmaps.where("not whole").select(*keys, "shard", "runs")
    span = T.StructType([*(cut.schema[k] for k in keys), cut.schema["shard"], T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("flag", T.BooleanType())])

    def of_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, bounds = decode_runs(batch.column(n))
            row = pa.array(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
            first, last = first - _RAISE, last - _RAISE
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(n)), pa.array(first), pa.array(first << SHARD_BITS), pa.array(last << SHARD_BITS | mask), pa.nulls(len(row), pa.bool_())], span.names)

    whole = bitmaps.where("whole").select(*keys, "runs").mapInArrow(of_whole, span)
    edges = shards.mapInArrow(_edges(n, span.names), span)
    line = Window.partitionBy(*keys).orderBy("first", F.col("flag").asc_nulls_first(), "last")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    met = whole.unionByName(edges).withColumn("reach", F.max("last").over(before)).withColumn("covered", F.max(F.when(F.col("flag").isNull(), F.col("last"))).over(before) >= F.col("last"))
    # what lies in a shard that a long range covers is neither a period nor a gap
    covered = met.where("covered and flag is not null").select(*keys, "shard").distinct()
    inside = shards.join(covered, [*keys, "shard"], "left_anti").select(*keys, "shard", "runs").mapInArrow(_insides(n, span.names), span).select(*keys, F.col("flag").alias("is_gap"), "first", "last")
    # an inner edge's gap is inside its shard, unless that is covered
    breaks = F.col("reach").isNull() | (F.col("reach") < F.col("first") - 1)
    met = met.withColumn("new", breaks)
    between = met.where("new and reach is not null and not coalesce(flag, false)").select(*keys, F.lit(True).alias("is_gap"), (F.col("reach") + 1).alias("first"), (F.col("first") - 1).alias("last"))
    islands = met.withColumn("island", F.sum(F.col("new").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return inside.unionByName(between).unionByName(islands.select(*keys, F.lit(False).alias("is_gap"), "first", "last"))
