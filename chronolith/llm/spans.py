"""Long exact spans that several texts hold verbatim (problem 9).

Windows are hashed only at the positions of a difference cover: a set of
residues in which every difference modulo the period occurs.  Two texts that
share ``min_length`` characters therefore share a window that starts at a cover
position in both, however their offsets differ.  Windows are
``min_length - period + 1`` characters long, so that one fits.

1. Each task packs the hashes of its texts into one array per hash shard; the
   shards tell which hashes occur in several texts.  Of a hash that several of a
   task's texts hold only one occurrence is sent, so a passage of very many texts
   does not gather in one shard.  The texts' digests go along; what this pass
   finds is kept in the shared folder.
2. Texts with such hashes send, for these windows alone, both hashes and the
   characters beside the window.
3. Windows that are equal join on their hash.  A pair of windows goes on only
   if it begins or ends a shared stretch, that is if the next common cover
   position before or after it is not shared too; the inside of a long copy
   costs nothing.  The characters beside give the exact ends.

How much of a text is shared needs no pairs: around the windows of 1, stretches
of the full length are hashed at every position, and found as in 1 where another
text holds one.

Equal texts are one class with one representative throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts_for, shared_folder
from .encoding import text_chunks

MIN_LENGTH = 200
#: The cover has ORDER + 1 residues modulo ORDER**2 + ORDER + 1; a prime power.
ORDER = 7
#: Input bytes per hash shard, as the planner estimates them (about a quarter of a text column's real size); sets how many shards there are, at any size.
SHARD_BYTES = 1 << 20
#: Shards that a task looks through; sets how many tasks there are, at any size.
TASK_SHARDS = 2

_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
_MIX = (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


@cache
def difference_cover(order: int) -> tuple[int, tuple[int, ...]]:
    """(period, residues): each nonzero difference modulo the period occurs exactly once."""
    period = order * order + order + 1
    chosen, seen = [0, 1], {1, period - 1}

    def grow(first: int) -> bool:
        if len(chosen) == order + 1:
            return True
        for x in range(first, period):
            new = {d for y in chosen for d in ((x - y) % period, (y - x) % period)}
            if len(new) == 2 * len(chosen) and not new & seen:
                chosen.append(x)
                seen.update(new)
                if grow(x + 1):
                    return True
                chosen.pop()
                seen.difference_update(new)
        return False

    if not grow(2):
        raise ValueError(f"no difference cover of order {order}")
    return period, tuple(chosen)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the step and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 21)
        made = []
        for base in (_STEP[which], pow(_STEP[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        have = _powers[which] = (made[0], made[1])
    return have


def _scramble(x: np.ndarray, mul: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(mul)
    return x ^ (x >> np.uint64(29))


class _Windows:
    """Hashes of stretches of several texts laid end to end."""

    def __init__(self, texts: list[str]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, starts: np.ndarray, size: int | np.ndarray, which: int = 0) -> np.ndarray:
        if which not in self._sums:
            up, _ = _power(which, len(self.points))
            values = _scramble(self.points.astype(np.uint64) + np.uint64(1), _MIX[which])
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * up[: len(values)], out=sums[1:])
            self._sums[which] = sums
        sums = self._sums[which]
        _, down = _power(which, len(self.points))
        return _scramble((sums[starts + size] - sums[starts]) * down[starts], _MIX[1 - which])

    def anchors(self, period: int, residues: tuple[int, ...], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the joined texts) of every window at a cover position."""
        owner, place = [], []
        for k, (a, n) in enumerate(zip(self.first.tolist(), self.sizes.tolist())):
            if n >= width:
                at = (np.arange(0, n - width + 1, period)[:, None] + np.array(residues)).ravel()
                at = at[at <= n - width]
                place.append(at + a)
                owner.append(np.full(len(at), k))
        if not place:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(owner), np.concatenate(place)


def _locally_shared(owner: np.ndarray, *hashes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(to send, known): which entries other tasks must hear of, and which several of these texts hold.

    Of a hash of several texts one entry is sent, of another hash one, or with
    ``places`` all.
    """
    order = np.lexsort((owner, *hashes[::-1]))
    new = np.ones(len(owner), bool)
    if len(owner) > 1:
        new[1:] = np.logical_or.reduce([h[order][1:] != h[order][:-1] for h in hashes])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(owner)))
    o = owner[order]
    several = np.repeat(o[begin] != o[begin + size - 1], size) if len(owner) else np.zeros(0, bool)
    send, known = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    send[order] = new | ~several if places else new
    known[order] = several
    return send, known


def _sharded(shard: np.ndarray, owner: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Entries packed by shard: how many texts, their ids, their numbers of entries, and each column's values."""
    order = np.lexsort((owner, shard))
    shard, owner, columns = shard[order], owner[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(shard)) + 1
    for at, s, o in zip(np.split(np.arange(len(shard)), cut), np.split(shard, cut), np.split(owner, cut)):
        if len(s):
            who, each = np.unique(o, return_counts=True)
            yield int(s[0]), np.int64(len(who)).tobytes() + ids[who].tobytes() + each.astype(np.uint32).tobytes() + b"".join(c[at].tobytes() for c in columns)


def _unsharded(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The owners and columns of all packed entries of a shard."""
    parts: list[list[np.ndarray]] = []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        each = np.frombuffer(blob, np.uint32, n, 8 + 8 * n)
        row, at, total = [np.repeat(np.frombuffer(blob, np.int64, n, 8), each)], 8 + 12 * n, int(each.sum())
        for k in kinds:
            row.append(np.frombuffer(blob, k, total, at))
            at += total * np.dtype(k).itemsize
        parts.append(row)
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64), *(np.empty(0, k) for k in kinds)]


def _by_owner(owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(owner, kind="stable")
    owner, columns = owner[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(owner)) + 1
    for at in np.split(np.arange(len(owner)), cut):
        if len(at):
            yield int(owner[at[0]]), [c[at] for c in columns]


#: shard: where the row is looked at; those from ``shards`` on only pass what tasks know already.
_PACKED = "shard int, doc_id long, packed binary, digest binary, n_chars long"
_SEEN = "doc_id long, hashes binary, digest binary, n_chars long"


def _near(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash and its low half, as one number."""
    return ((h >> np.uint64(32)) % np.uint64(shards) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _packed_rows(shards: list[int], ids: list[int | None], blobs: list[bytes | None], digests: list[bytes | None], sizes: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], ["shard", "doc_id", "packed", "digest", "n_chars"])


def _first_pass(own: DataFrame, period: int, residues: tuple[int, ...], width: int) -> tuple[DataFrame, int]:
    """(doc_id, hashes, digest, n_chars) and the number of shards: of each text the digest, and the hashes that other texts hold too, in several rows."""
    shards = parts_for(own, SHARD_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # copies within a batch are packed once, under their least id: a class's representative is never left out
            once: dict[str, int] = {}
            for i, t in zip(ids, texts):
                once[t] = min(i, once.get(t, i))
            digests = {t: blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in once}
            yield _packed_rows([shards + i % shards for i in ids], ids, [None] * len(ids), [digests[t] for t in texts], [len(t) for t in texts])
            texts, ids = list(once), np.array(list(once.values()), np.int64)
            for a, b in text_chunks(texts):
                w = _Windows(texts[a:b])
                owner, place = w.anchors(period, residues, width)
                near = _near(w.hashes(place, width), shards)
                send, known = _locally_shared(owner, near)
                rows = [(s, None, blob) for s, blob in _sharded((near[send] >> np.uint64(32)).astype(np.int64), owner[send], ids[a:b], near[send].astype(np.uint32))]
                rows += [(shards + int(ids[a + o]) % shards, int(ids[a + o]), np.unique(h).tobytes()) for o, (h,) in _by_owner(owner[known], near[known])]
                if rows:
                    numbers, owners, blobs = zip(*rows)
                    yield _packed_rows(list(numbers), list(owners), list(blobs), [None] * len(rows), [None] * len(rows))

    def look(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        if number >= shards:
            return pa.table({"doc_id": table["doc_id"], "hashes": table["packed"], "digest": table["digest"], "n_chars": table["n_chars"]})
        owner, low = _unsharded(table["packed"].to_pylist(), np.uint32)
        _, several = _locally_shared(owner, low)
        found = list(_by_owner(owner[several], low[several].astype(np.uint64) | np.uint64(number << 32)))
        return pa.table({"doc_id": pa.array([o for o, _ in found], pa.int64()), "hashes": pa.array([h.tobytes() for _, (h,) in found], pa.binary()), "digest": pa.nulls(len(found), pa.binary()), "n_chars": pa.nulls(len(found), pa.int64())})

    shared_folder(own.sparkSession)
    packed = own.mapInArrow(pack, _PACKED).repartition(max(1, -(-2 * shards // TASK_SHARDS)), "shard")
    return packed.groupBy("shard").applyInArrow(look, _SEEN).checkpoint(), shards


def _classes(seen: DataFrame) -> DataFrame:
    own = seen.where("digest is not null").select("doc_id", "n_chars", "digest")
    reps = own.groupBy("digest").agg(F.min("doc_id").alias("rep_id"))
    return own.join(reps, "digest").select("doc_id", "rep_id", "n_chars").distinct()


def _flagged(own: DataFrame, seen: DataFrame, shards: int) -> DataFrame:
    """(doc_id, text, flags) of the representatives that share windows; texts are spread by their id, as many parts as their size asks for."""
    parts = max(1, -(-shards // TASK_SHARDS))
    reps = _classes(seen).where("doc_id = rep_id").select("doc_id")
    flags = seen.where("hashes is not null").select("doc_id", "hashes").repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list("hashes").alias("flags"))
    return own.repartition(parts, "doc_id").join(flags.join(reps, "doc_id", "left_semi"), "doc_id").select("doc_id", "text", "flags")


def _wanted_windows(w: _Windows, flags: list[list[bytes]], period: int, residues: tuple[int, ...], width: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the windows that other texts hold."""
    owner, place = w.anchors(period, residues, width)
    h = w.hashes(place, width)
    near = _near(h, shards)
    bound = np.searchsorted(owner, np.arange(len(flags) + 1))
    keep = np.zeros(len(h), bool)
    for k, f in enumerate(flags):
        keep[bound[k] : bound[k + 1]] = np.isin(near[bound[k] : bound[k + 1]], np.concatenate([np.frombuffer(x, np.uint64) for x in f]))
    return owner[keep], place[keep], h[keep]


_OCCURRENCE = "key long, key2 long, doc_id long, pos int, residue int, before1 long, before2 long, after1 long, after2 long, left string, right string"


def _occurrences(flagged: DataFrame, period: int, residues: tuple[int, ...], width: int, shards: int) -> DataFrame:
    back = {r: (r - residues[k - 1]) % period or period for k, r in enumerate(residues)}
    ahead = {r: (residues[(k + 1) % len(residues)] - r) % period or period for k, r in enumerate(residues)}
    gap_back, gap_ahead = np.zeros(period, np.int64), np.zeros(period, np.int64)
    for r in residues:
        gap_back[r], gap_ahead[r] = back[r], ahead[r]

    def beside(w: _Windows, starts: np.ndarray, sizes: np.ndarray, ok: np.ndarray) -> pa.Array:
        out = np.zeros(len(starts), np.int64)
        out[ok] = w.hashes(starts[ok], sizes[ok]).view(np.int64)
        return pa.array(out, pa.int64(), mask=~ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, flags = (batch.column(i).to_pylist() for i in range(3))
            for a, b in text_chunks(texts):
                w = _Windows(texts[a:b])
                owner, place, h = _wanted_windows(w, flags[a:b], period, residues, width, shards)
                pos = place - w.first[owner]
                rest = w.sizes[owner] - pos - width
                residue = pos % period
                g, g2 = gap_back[residue], gap_ahead[residue]
                full = np.full(len(pos), period)
                end = place + width
                left = [texts[a + o][max(0, p - period) : p] for o, p in zip(owner.tolist(), pos.tolist())]
                right = [texts[a + o][p + width : p + width + period] for o, p in zip(owner.tolist(), pos.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), pa.array(w.hashes(place, width, 1).view(np.int64)), pa.array(np.array(ids[a:b], np.int64)[owner]), pa.array(pos, pa.int32()), pa.array(residue, pa.int32()),
                        beside(w, place - g, g, pos >= g), beside(w, place - full, full, pos >= period), beside(w, end, g2, rest >= g2), beside(w, end, full, rest >= period),
                        pa.array(left, pa.string()), pa.array(right, pa.string()),
                    ],
                    ["key", "key2", "doc_id", "pos", "residue", "before1", "before2", "after1", "after2", "left", "right"],
                )

    return flagged.mapInArrow(run, _OCCURRENCE)


def _common(a: list[str], b: list[str], back: bool) -> list[int]:
    """How many characters agree, from the end or the beginning."""
    out = []
    for x, y in zip(a, b):
        if back:
            x, y = x[::-1], y[::-1]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            out.append(n)
            continue
        low, high = 0, n  # x[:low] agrees, x[:high] doesn't
        while high - low > 1:
            mid = (low + high) // 2
            if x[:mid] == y[:mid]:
                low = mid
            else:
                high = mid
        out.append(low)
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        lefts = _common(x.column("left_a").to_pylist(), x.column("left_b").to_pylist(), True)
        rights = _common(x.column("right_a").to_pylist(), x.column("right_b").to_pylist(), False)
        yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("doc_a", "doc_b", "pos_a", "pos_b", "is_start", "is_end")), pa.array(lefts, pa.int32()), pa.array(rights, pa.int32())], ["doc_a", "doc_b", "pos_a", "pos_b", "is_start", "is_end", "left", "right"])


def _long_enough(documents: DataFrame, min_length: int) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.char_length("text") >= min_length))


def _cover(min_length: int, order: int) -> tuple[int, tuple[int, ...], int]:
    """(period, residues, window) for a length."""
    period, residues = difference_cover(order)
    width = min_length - period + 1
    if width < 1:
        raise ValueError("the period is longer than min_length")
    return period, residues, width


def shared_spans(documents: DataFrame, min_length: int = MIN_LENGTH, order: int = ORDER) -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, length): every maximal stretch of at least
    ``min_length`` characters that the texts of two classes hold verbatim.

    doc_a < doc_b are representatives, the least ids of equal texts; starts
    count Unicode characters from 0.  Null and shorter texts and null ids take no
    part.  Equal windows are recognised by two independent 64-bit hashes, equal
    texts by 128 bits.  ``doc_id`` must be integral and unique; other columns are
    not read.
    """
    cover = _cover(min_length, order)
    own = _long_enough(documents, min_length)
    return _spans(own, *_first_pass(own, *cover), cover, min_length)


def _spans(own: DataFrame, seen: DataFrame, shards: int, cover: tuple[int, tuple[int, ...], int], min_length: int) -> DataFrame:
    period, residues, width = cover
    o = _occurrences(_flagged(own, seen, shards), period, residues, width, shards)

    a, b = o.alias("a"), o.alias("b")
    near = F.col("a.residue") == F.col("b.residue")

    def differs(c: str) -> Column:
        return F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(True))

    start = F.when(near, differs("before1")).otherwise(differs("before2"))
    end = F.when(near, differs("after1")).otherwise(differs("after2"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.key2") == F.col("b.key2")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (start | end)).select(
        F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), start.alias("is_start"), end.alias("is_end"),
        F.col("a.left").alias("left_a"), F.col("b.left").alias("left_b"), F.col("a.right").alias("right_a"), F.col("b.right").alias("right_b"),
    )
    found = pairs.mapInArrow(_ends, "doc_a long, doc_b long, pos_a int, pos_b int, is_start boolean, is_end boolean, left int, right int")
    marks = found.select(
        "doc_a", "doc_b", (F.col("pos_a") - F.col("pos_b")).alias("shift"),
        F.explode(F.filter(F.array(
            F.when(F.col("is_start"), F.struct((F.col("pos_a") - F.col("left")).alias("at"), F.lit(True).alias("start"))),
            F.when(F.col("is_end"), F.struct((F.col("pos_a") + width + F.col("right")).alias("at"), F.lit(False).alias("start"))),
        ), lambda m: m.isNotNull())).alias("m"),
    ).select("doc_a", "doc_b", "shift", "m.at", "m.start").distinct()
    # On one shift stretches don't touch: after a start comes its end.
    line = Window.partitionBy("doc_a", "doc_b", "shift").orderBy("at")
    spans = marks.withColumn("end", F.lead("at").over(line)).where("start").withColumn("length", F.col("end") - F.col("at"))
    return spans.where(F.col("length") >= min_length).select("doc_a", "doc_b", F.col("at").alias("start_a"), (F.col("at") - F.col("shift")).alias("start_b"), "length")


def shared_pairs(documents: DataFrame, min_length: int = MIN_LENGTH, order: int = ORDER) -> DataFrame:
    """(doc_a, doc_b) with doc_a < doc_b: every pair of documents that share ``min_length`` characters, copies too."""
    cover = _cover(min_length, order)
    own = _long_enough(documents, min_length)
    seen, shards = _first_pass(own, *cover)
    links = _spans(own, seen, shards, cover, min_length).select("doc_a", "doc_b").distinct()
    member = _classes(seen).select("doc_id", "rep_id")
    # a class is linked to itself if it has several members
    alone = member.groupBy("rep_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep_id").alias("doc_a"), F.col("rep_id").alias("doc_b"))
    m1, m2 = member.select(F.col("rep_id").alias("doc_a"), F.col("doc_id").alias("x")), member.select(F.col("rep_id").alias("doc_b"), F.col("doc_id").alias("y"))
    across = links.join(m1, "doc_a").join(m2, "doc_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    within = alone.join(m1, "doc_a").join(m2, "doc_b").where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))
    return across.unionByName(within)


_RUNS = "doc_id long, runs binary"


def _covered(flagged: DataFrame, cover: tuple[int, tuple[int, ...], int], min_length: int, shards: int) -> DataFrame:
    """(doc_id, covered): how many characters of a text lie in stretches of ``min_length`` that another text holds.

    Every such stretch holds a window that was flagged, so only the positions
    that a flagged window is less than a period behind are looked at.
    """
    period, residues, width = cover

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, flags = (batch.column(i).to_pylist() for i in range(3))
            ids = np.array(ids, np.int64)
            for a, b in text_chunks(texts):
                w = _Windows(texts[a:b])
                owner, place, _ = _wanted_windows(w, flags[a:b], period, residues, width, shards)
                turn = np.zeros(len(w.points) + 1, np.int64)
                low, high = np.maximum(place - period + 1, w.first[owner]), np.minimum(place, w.first[owner + 1] - min_length)
                ok = low <= high
                np.add.at(turn, low[ok], 1)
                np.add.at(turn, high[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(turn) > 0)
                owner = np.searchsorted(w.first, at, "right") - 1
                h, h2 = w.hashes(at, min_length), w.hashes(at, min_length, 1).astype(np.uint32)
                send, known = _locally_shared(owner, h, h2, places=True)
                pos = (at - w.first[owner]).astype(np.int32)
                shard = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                rows = [(s, None, blob) for s, blob in _sharded(shard[send], owner[send], ids[a:b], h[send], h2[send], pos[send])]
                rows += [(shards + int(ids[a + o]) % shards, int(ids[a + o]), _runs(p, min_length)) for o, (p,) in _by_owner(owner[known], pos[known])]
                if rows:
                    numbers, owners, blobs = zip(*rows)
                    yield _packed_rows(list(numbers), list(owners), list(blobs), [None] * len(rows), [None] * len(rows))

    def look(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() >= shards:
            return pa.table({"doc_id": table["doc_id"], "runs": table["packed"]})
        owner, h, h2, pos = _unsharded(table["packed"].to_pylist(), np.uint64, np.uint32, np.int32)
        _, several = _locally_shared(owner, h, h2)
        found = list(_by_owner(owner[several], pos[several]))
        return pa.table({"doc_id": pa.array([o for o, _ in found], pa.int64()), "runs": pa.array([_runs(p, min_length) for _, (p,) in found], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for runs in batch.column(1).to_pylist():
                r = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in runs])
                r = r[np.argsort(r[:, 0], kind="stable")]
                reach = np.maximum.accumulate(r[:, 1])
                sums.append(int(np.maximum(r[:, 1] - np.maximum(r[:, 0], np.concatenate([[0], reach[:-1]])), 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["doc_id", "covered"])

    parts = max(1, -(-2 * shards // TASK_SHARDS))
    runs = flagged.mapInArrow(pack, _PACKED).repartition(parts, "shard").groupBy("shard").applyInArrow(look, _RUNS)
    # a text's runs are at most as many as its characters
    return runs.groupBy("doc_id").agg(F.collect_list("runs").alias("runs")).mapInArrow(total, "doc_id long, covered long")


def _runs(positions: np.ndarray, length: int) -> bytes:
    """The stretches that begin at some positions, those that overlap as one: (first, end) pairs."""
    p = np.unique(positions)
    cut = np.flatnonzero(np.diff(p) > length)
    return np.stack([p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)] + length], 1).astype(np.int32).tobytes()


def shared_parts(documents: DataFrame, min_length: int = MIN_LENGTH, order: int = ORDER, links: bool = True) -> DataFrame:
    """For every row of documents: (doc_id, rep_id, n_chars, n_copies, n_links, shared_chars, shared_part).

    ``n_links`` counts the other classes that share a span, ``n_copies`` the
    other rows with the same text.  ``shared_chars`` is how many characters lie
    in a span that another document holds; of a text with copies all do.  Null
    texts have null ``n_chars`` and 0 elsewhere; short texts share nothing.
    Without ``links`` there is no ``n_links`` and nothing goes through pairs: the
    work grows with the occurrences of shared passages, not with their square.
    """
    cover = _cover(min_length, order)
    own = _long_enough(documents, min_length)
    seen, shards = _first_pass(own, *cover)
    parts = _covered(_flagged(own, seen, shards), cover, min_length, shards).withColumnRenamed("doc_id", "rep_id")
    if links:
        spans = _spans(own, seen, shards, cover, min_length)
        both = spans.select(F.col("doc_a").alias("rep_id"), F.col("doc_b").alias("other")).unionByName(spans.select(F.col("doc_b").alias("rep_id"), F.col("doc_a").alias("other")))
        parts = parts.join(both.groupBy("rep_id").agg(F.count_distinct("other").alias("n_links")), "rep_id", "full")
    member = _classes(seen)
    counts = member.groupBy("rep_id").agg((F.count("*") - 1).alias("n_copies"))
    extra = ["n_links"] if links else []
    known = member.join(counts, "rep_id").join(parts, "rep_id", "left").select(F.col("doc_id").alias("k"), "rep_id", "n_copies", *extra, "covered")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.col("text").cast("string")).cast("long").alias("n_chars"))
    return base.join(known, base.doc_id == known.k, "left").select(
        "doc_id", F.coalesce("rep_id", "doc_id").alias("rep_id"), "n_chars", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), *[F.coalesce(c, F.lit(0)).alias(c) for c in extra],
        F.when(F.col("n_copies") > 0, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("shared_chars"),
    ).withColumn("shared_part", F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0)))
