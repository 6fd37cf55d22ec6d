"""Distinct counts over huge sets of identifiers (problem 1).

A sketch is a bit matrix: an identifier's hash picks one of ``buckets`` rows at
random and, with probability 2**-(r+1), column r of it.  Sketches of parts are
merged by bitwise union.  The count is the maximum-likelihood estimate from how
many bits of each column are set; the Fisher information of the same columns
bounds its variance.

While few bits are set, a sketch is the sorted list of set bits.

Rows first become one word for each group and matrix row, united before and
after their shuffle.  Tasks turn the words of many groups at once into sketches
of every combination of groups, which are merged in a tree: no row ever holds
more than FAN_IN sketches, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parts_for

#: Relative standard error about 0.7 / sqrt(buckets): 1.1 %.
BUCKET_BITS = 12
_COLUMNS = 64 - BUCKET_BITS
#: Bits per packed entry for the column; an entry is bucket << 6 | column.
_SHIFT = 6
#: Sketches that are merged at once.
FAN_IN = 32
#: Words that a task turns into sketches at once.
TASK_WORDS = 1 << 20
#: Input bytes for each task that makes sketches.
PART_BYTES = 64 << 20


def _word(hash_column: Column, bucket_bits: int) -> tuple[Column, Column]:
    """(matrix row, word with the one bit of the column) of a 64-bit hash."""
    rest = F.shiftrightunsigned(hash_column, bucket_bits).bitwiseOR(F.lit(1 << (63 - bucket_bits)))
    # the lowest bit that is set stands where the column's bit does
    return hash_column.bitwiseAND(F.lit((1 << bucket_bits) - 1)).cast("int"), rest.bitwiseAND(F.negative(rest))


def pack(coupons: np.ndarray, bucket_bits: int = BUCKET_BITS) -> bytes:
    """A sketch of sorted different entries: 0 and the list, or 1 and the matrix, whichever is shorter."""
    if 4 * len(coupons) <= 8 << bucket_bits:
        return b"\0" + coupons.astype("<u4").tobytes()
    rows = np.zeros(1 << bucket_bits, np.uint64)
    np.bitwise_or.at(rows, coupons >> _SHIFT, np.uint64(1) << (coupons & ((1 << _SHIFT) - 1)).astype(np.uint64))
    return b"\1" + rows.tobytes()


def unpack(sketch: bytes) -> np.ndarray:
    """The sorted entries of a sketch."""
    if sketch[:1] == b"\0":
        return np.frombuffer(sketch, "<u4", -1, 1).astype(np.int64)
    rows = np.frombuffer(sketch, "<u8", -1, 1)
    bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), 8), axis=1, bitorder="little")
    bucket, column = np.nonzero(bits)
    return bucket << _SHIFT | column


def merge(sketches: list[bytes], bucket_bits: int = BUCKET_BITS) -> bytes:
    """The sketch of the union."""
    return pack(np.unique(np.concatenate([unpack(s) for s in sketches])) if sketches else np.empty(0, np.int64), bucket_bits)


def estimate(columns: np.ndarray, bucket_bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, standard errors) from the set bits in each column, a row for each sketch."""
    buckets, last = 1 << bucket_bits, 63 - bucket_bits
    chance = 2.0 ** -(np.arange(last + 1) + 1.0) / buckets
    chance[last] *= 2  # the last column takes the rest
    columns = columns[:, : last + 1].astype(float)
    low, high = np.full(len(columns), -2.0), np.full(len(columns), 70.0)  # powers of 2
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for _ in range(70):
            mid = (low + high) / 2
            load = np.exp2(mid)[:, None] * chance
            # the likelihood rises while this is positive
            slope = (columns * chance / np.expm1(load) - (buckets - columns) * chance).sum(1)
            low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
        n = np.exp2((low + high) / 2)
        load = n[:, None] * chance
        information = (buckets * chance**2 / np.expm1(load)).sum(1)
        # as if the count itself were random; without its own variance:
        variance = np.maximum(1 / information - n, 0)
    n = np.where(columns.sum(1) == 0, 0.0, n)
    return n, np.where(n > 0, np.sqrt(variance), 0.0)


def _groupings(n: int) -> list[tuple[int, ...]]:
    return [c for k in range(n, -1, -1) for c in combinations(range(n), k)]


def sketch(rows: DataFrame, identifier: Column, dims: list[str], combine: bool = True, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(dims..., totals, sketch) for each group and, with ``combine``, each combination of groups.

    ``totals`` has a bit for each dimension that the row sums over, the first
    one lowest; there the dimension is null.  A null in a dimension is a group
    of its own (with the bit unset).  Null identifiers don't count; a group with
    no others has an empty sketch.  With no rows there are no groups, not even a
    total.
    """
    made, tasks = partial_sketches(rows, identifier, dims, combine, bucket_bits)
    return merge_sketches(made, bucket_bits, tasks)


def partial_sketches(rows: DataFrame, identifier: Column, dims: list[str], combine: bool = True, bucket_bits: int = BUCKET_BITS) -> tuple[DataFrame, int]:
    """The sketches that tasks make of their own groups, with ``__task``, and how many tasks there are."""
    kinds = [rows.schema[d].dataType for d in dims]
    sets = _groupings(len(dims)) if combine else [tuple(range(len(dims)))]
    tasks = parts_for(rows, PART_BYTES)
    hashed = rows.select(*dims, F.when(identifier.isNotNull(), F.xxhash64(identifier)).alias("__hash"))
    row, bit = _word(F.col("__hash"), bucket_bits)
    # united within tasks and after a shuffle that spreads every group over its matrix rows; then a group has at most so many rows as its matrix
    words = hashed.groupBy(*dims, row.alias("__row")).agg(F.bit_or(bit).alias("__bits")).repartition(tasks, *(dims or ["__row"]))
    names = [*dims, "totals", "sketch", "__task"]
    keyed = T.StructType([T.StructField(d, k) for d, k in zip(dims, kinds)] + [T.StructField("totals", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("__task", T.IntegerType())])

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), table.num_rows
        at, bits = table.column(len(dims)).combine_chunks(), table.column(len(dims) + 1).combine_chunks()
        # every set bit as an entry, with the word it is in
        words = bits.fill_null(0).to_numpy().view(np.uint64)
        owner, column = np.nonzero(np.unpackbits(words.view(np.uint8).reshape(n, 8), axis=1, bitorder="little"))
        flat = at.fill_null(0).to_numpy().astype(np.int64)[owner] << _SHIFT | column
        # numbers for the values of each dimension; null has its own
        codes = [pd.factorize(table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False))[0] for i in range(len(dims))]
        for s in sets:
            group = np.zeros(n, np.int64)
            for i in s:
                group = pd.factorize(group * (codes[i].max() + 1) + codes[i])[0]
            pairs = np.unique(group[owner] << 24 | flat)
            count = int(group.max()) + 1
            cut = np.searchsorted(pairs >> 24, np.arange(count + 1))
            example = np.zeros(count, np.int64)
            example[group[::-1]] = np.arange(n)[::-1]
            where = pa.array(example)
            columns = [table.column(i).combine_chunks().take(where) if i in s else pa.nulls(count, table.column(i).type) for i in range(len(dims))]
            totals = sum(1 << i for i in range(len(dims)) if i not in s)
            found = [pack(pairs[a:b] & 0xFFFFFF, bucket_bits) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([totals] * count, pa.int32()), pa.array(found, pa.binary()), pa.array([task] * count, pa.int32())], names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_WORDS:
                yield from made(pa.Table.from_batches(held))
                held = []
        if held:
            yield from made(pa.Table.from_batches(held))

    return words.mapInArrow(part, keyed), tasks


def merge_sketches(sketches: DataFrame, bucket_bits: int = BUCKET_BITS, tasks: int | None = None) -> DataFrame:
    """One sketch a group from several tables' sketches; every column but ``sketch`` (and ``__task``) is part of the group.

    With a column ``__task`` of numbers below ``tasks``, those of FAN_IN
    neighbouring tasks are merged first, and then theirs, until one is left.
    Without, the sketches of a group are spread over as many parts as the table
    has partitions of input, which is the most that a table of one row a group
    and part can have.
    """
    keys = [c for c in sketches.columns if c not in ("sketch", "__task")]
    if tasks is None:
        tasks = max(FAN_IN, parts_for(sketches, PART_BYTES))
        sketches = sketches.withColumn("__task", F.pmod(F.xxhash64("sketch"), F.lit(tasks)).cast("int"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("sketches")
            made = [s[0] if len(s) == 1 else merge(s, bucket_bits) for s in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(made, pa.binary())], [*batch.schema.names[:at], "sketch"])

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        level = [*keys, "__task"] if tasks > 1 else keys
        united = sketches.withColumn("__task", F.expr(f"__task div {FAN_IN}").cast("int")).groupBy(*level).agg(F.collect_list("sketch").alias("sketches"))
        out = T.StructType([united.schema[c] for c in level] + [T.StructField("sketch", T.BinaryType())])
        sketches = united.mapInArrow(union, out)
    return sketches.select(*keys, "sketch")


def distinct_counts(sketches: DataFrame, bucket_bits: int = BUCKET_BITS, deviations: float = 3.0) -> DataFrame:
    """Adds (estimate, std_error, low, high) and drops ``sketch``.

    low and high are the estimate -/+ ``deviations`` standard errors, low at
    least the number of set bits, which no smaller set can set.
    """
    keys = [c for c in sketches.columns if c != "sketch"]
    out = T.StructType([sketches.schema[c] for c in keys] + [T.StructField(c, T.DoubleType()) for c in ("estimate", "std_error", "low", "high")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack(s) for s in batch.column(len(keys)).to_pylist()]
            columns = np.array([np.bincount(e & ((1 << _SHIFT) - 1), minlength=64) for e in found]).reshape(len(found), 64)
            n, error = estimate(columns, bucket_bits)
            sure = np.array([len(e) for e in found], float)
            n = np.maximum(n, sure)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(n), pa.array(error), pa.array(np.maximum(n - deviations * error, sure)), pa.array(n + deviations * error)], [f.name for f in out])

    return sketches.select(*keys, "sketch").mapInArrow(run, out)
