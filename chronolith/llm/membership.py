"""Has this key been seen before? (problem 4)

Keys are split over partitions by their hash.  A partition goes through its
records in order and asks a cuckoo table of short fingerprints; a key it does
not find is new and goes in.  So the memory is some bytes a key, whatever the
keys' length, and no earlier occurrence is ever missed; a key is wrongly called
seen at a known small rate, which ``audit`` measures.

A task first combines its own rows: of the records with one key only the
earliest needs the table, those after it are seen for certain.  A key that holds
most rows thus sends a row per task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series_keys import canonical_key
from ..session import parts_for

SLOTS = 4
#: Bits of a fingerprint: a lookup is wrong at a rate of at most 2 * SLOTS * generations / 2**bits.
FINGERPRINT_BITS = 32
FIRST_BUCKETS = 1 << 12
FULL = 0.9
#: Rounds of moving entries after which a table counts as saturated.
MOVES = 200
#: Rows a task combines at a time.
COMBINED = 200_000
#: Input bytes per partition.
PARTITION_BYTES = 8 << 20


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Generation:
    def __init__(self, buckets: int, bits: int):
        self.buckets, self.bits, self.used = buckets, bits, 0
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        self.slots = np.zeros((buckets, SLOTS), kind)
        self.turn = 0

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a bucket, the fingerprint) of each hash."""
        mark = (hashes >> np.uint64(64 - self.bits)).astype(self.slots.dtype)
        mark[mark == 0] = 1
        return (hashes & np.uint64(self.buckets - 1)).astype(np.int64), mark

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The other bucket of an entry, which its fingerprint and either bucket tell."""
        return bucket ^ (_spread(mark.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bucket, mark = self.place(hashes)
        there = (self.slots[bucket] == mark[:, None]).any(1)
        return there | (self.slots[self.other(bucket, mark)] == mark[:, None]).any(1)

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts entries into free slots; True where there was one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
        free = self.slots[b] == 0
        ok = rank < free.sum(1)
        slot = np.argmax((np.cumsum(free, 1) == (rank + 1)[:, None]) & free, 1)
        self.slots[b[ok], slot[ok]] = mark[order[ok]]
        self.used += int(ok.sum())
        done = np.zeros(len(b), bool)
        done[order[ok]] = True
        return done

    def add(self, hashes: np.ndarray) -> np.ndarray | None:
        """Adds all, or as many as fit; (bucket, mark) pairs that found no room come back."""
        bucket, mark = self.place(hashes)
        for turn in range(MOVES):
            if not len(bucket):
                return None
            left = ~self._settle(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if not len(bucket):
                return None
            bucket = self.other(bucket, mark)
            left = ~self._settle(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if len(bucket):
                # one entry of each full bucket makes room and moves on
                _, one = np.unique(bucket, return_index=True)
                slot = (self.turn + turn + one) % SLOTS
                out = self.slots[bucket[one], slot].copy()
                self.slots[bucket[one], slot] = mark[one]
                mark = mark.copy()
                mark[one] = out
                bucket[one] = self.other(bucket[one], out)
        self.turn += 1
        return np.stack([bucket, mark.astype(np.int64)])

    def drop(self, h: np.uint64) -> bool:
        bucket, mark = self.place(np.array([h], np.uint64))
        for b in (int(bucket[0]), int(self.other(bucket, mark)[0])):
            at = np.flatnonzero(self.slots[b] == mark[0])
            if len(at):
                self.slots[b, at[0]] = 0
                self.used -= 1
                return True
        return False


class CuckooTable:
    """A growing set of fingerprints of 64-bit hashes; supports deletion of what was added."""

    def __init__(self, bits: int = FINGERPRINT_BITS, buckets: int = FIRST_BUCKETS):
        self.bits = bits
        self.generations = [_Generation(buckets, bits)]
        # entries that moved out of a saturated generation: they belong to its buckets
        self.spilled: dict[int, Counter] = {}

    def __len__(self) -> int:
        return sum(g.used for g in self.generations) + sum(c.total() for c in self.spilled.values())

    @property
    def wrong_rate(self) -> float:
        """An upper bound of the share of new keys that are called seen."""
        return sum(2 * SLOTS * g.used / (g.buckets * SLOTS) for g in self.generations) / 2**self.bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for k, g in enumerate(self.generations):
            out |= g.has(hashes)
            if self.spilled.get(k):
                bucket, mark = g.place(hashes)
                for b in (bucket, g.other(bucket, mark)):
                    out |= np.fromiter((self.spilled[k][x, y] > 0 for x, y in zip(b.tolist(), mark.tolist())), bool, len(b))
        return out

    def add(self, hashes: np.ndarray) -> None:
        while len(hashes):
            g = self.generations[-1]
            room = int(FULL * g.buckets * SLOTS) - g.used
            if room <= 0:
                self.generations.append(_Generation(2 * g.buckets, self.bits))
                continue
            back = g.add(hashes[:room])
            if back is not None:
                self.spilled.setdefault(len(self.generations) - 1, Counter()).update(zip(back[0].tolist(), back[1].tolist()))
                self.generations.append(_Generation(2 * g.buckets, self.bits))
            hashes = hashes[room:]

    def see(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash, in order, was there before; all are there afterwards."""
        code, found = pd.factorize(hashes)
        first = np.full(len(found), len(hashes), np.int64)
        np.minimum.at(first, code, np.arange(len(hashes)))
        there = self.has(found)
        self.add(found[~there])
        seen = np.ones(len(hashes), bool)
        seen[first] = there
        return seen

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Takes out one entry of each hash; only keys that were added may be deleted."""
        out = np.zeros(len(hashes), bool)
        for i, h in enumerate(hashes):
            for k, g in enumerate(self.generations):
                if g.drop(h):
                    out[i] = True
                    break
                bucket, mark = g.place(np.array([h], np.uint64))
                spilled = self.spilled.get(k, Counter())
                pair = next((p for p in ((int(b[0]), int(mark[0])) for b in (bucket, g.other(bucket, mark))) if spilled[p]), None)
                if pair:
                    spilled[pair] -= 1
                    spilled += Counter()
                    out[i] = True
                    break
        return out


_SENT = "side int, id long, hash long, seen boolean"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key in some rows, the earliest record goes on with its hash, later ones as seen."""

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        side, ids, hashes = (table.column(c).combine_chunks() for c in ("side", "id", "hash"))
        null = hashes.is_null().to_numpy(zero_copy_only=False)
        side, ids, hashes = side.to_numpy(), ids.to_numpy(zero_copy_only=False), hashes.fill_null(0).to_numpy()
        order = np.lexsort((ids, side))
        order = order[~null[order]]
        code, found = pd.factorize(hashes[order])
        again = np.ones(len(order), bool)
        first = np.full(len(found), len(order), np.int64)
        np.minimum.at(first, code, np.arange(len(order)))
        again[first] = False
        keep, later = order[~again], order[again & (side[order] == 1)]
        blank = np.flatnonzero(null & (side == 1))
        rows = np.concatenate([keep, later, blank])
        n, m, k = len(keep), len(later), len(blank)
        known = np.concatenate([np.zeros(n, bool), np.ones(m, bool), np.zeros(k, bool)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(side[rows], pa.int32()), pa.array(ids[rows], pa.int64()),
                pa.array(hashes[rows], pa.int64(), mask=np.arange(len(rows)) >= n), pa.array(known, pa.bool_(), mask=~known),
            ],
            ["side", "id", "hash", "seen"],
        )

    parts, size = [], 0
    for b in batches:
        parts.append(b)
        size += b.num_rows
        if size >= COMBINED:
            yield made(parts)
            parts, size = [], 0
    if size:
        yield made(parts)


def _asker(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = CuckooTable(bits)
        for batch in batches:
            side = batch.column(0).to_numpy()
            hashes = batch.column(2)
            asked = ~hashes.is_null().to_numpy(zero_copy_only=False)
            seen = batch.column(3)
            answer = seen.fill_null(False).to_numpy(zero_copy_only=False).copy()
            answer[asked] = table.see(hashes.drop_null().to_numpy().view(np.uint64))
            known = asked | ~seen.is_null().to_numpy(zero_copy_only=False)
            log = side == 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).filter(pa.array(log)), pa.array(answer[log], pa.bool_(), mask=~known[log])], ["entry_id", "seen"]
            )

    return ask


def seen_before(segments: DataFrame, log: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(entry_id, seen) of every row of ``log``: did its key occur in ``segments`` or under a lower entry_id?

    Keys in different spellings are one key.  Never false for a key that
    occurred; true for one that did not at a rate of at most
    ``CuckooTable.wrong_rate`` (8 / 2**bits a generation of the table).  A null
    key has a null answer.  Of rows that repeat an entry_id and key, one counts
    as the first.  Other columns are not read.
    """
    both = segments.select(F.lit(0).alias("side"), F.lit(0).cast("long").alias("id"), F.col("series_key").cast("string").alias("key")).unionByName(
        log.select(F.lit(1).alias("side"), F.col("entry_id").cast("long").alias("id"), F.col("series_key").cast("string").alias("key"))
    )
    hashed = both.select("side", "id", F.when(F.col("key").isNotNull(), F.xxhash64(canonical_key("key"))).alias("hash"))
    parts = parts_for(both, PARTITION_BYTES)
    sent = hashed.mapInArrow(_combine, _SENT)
    # what is answered goes anywhere, evenly
    placed = sent.repartition(parts, F.coalesce("hash", F.xxhash64("id"))).sortWithinPartitions("side", "id")
    return placed.mapInArrow(_asker(bits), "entry_id long, seen boolean")


def audit(segments: DataFrame, log: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(fingerprint_bits, records, seen, wrongly_seen, missed, wrong_rate): the answers against an exact comparison of whole keys."""
    keys = log.where("series_key is not null").select(F.col("entry_id").cast("long").alias("entry_id"), canonical_key("series_key").alias("key"))
    old = segments.where("series_key is not null").select(F.lit(-(1 << 63)).cast("long").alias("entry_id"), canonical_key("series_key").alias("key"))
    first = keys.unionByName(old).groupBy("key").agg(F.min("entry_id").alias("first"))
    fresh = first.where(F.col("first") > -(1 << 63)).select(F.col("first").alias("entry_id"), F.lit(True).alias("fresh"))
    both = seen_before(segments, log, bits).where("seen is not null").join(fresh, "entry_id", "left").select("seen", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    return both.agg(
        F.lit(bits).alias("fingerprint_bits"), F.count("*").alias("records"), F.count_if("seen").alias("seen"), F.count_if(F.col("seen") & F.col("fresh")).alias("wrongly_seen"), F.count_if(~F.col("seen") & ~F.col("fresh")).alias("missed"),
        F.try_divide(F.count_if(F.col("seen") & F.col("fresh")), F.count_if("fresh")).alias("wrong_rate"),
    )
