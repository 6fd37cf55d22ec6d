"""Filling containers of fixed capacity with texts (problem 8).

Partitions are packed by best-fit decreasing, and lower bounds from
dual-feasible functions certify those that no packing of their own texts could
better.  A certified partition keeps its containers, but for the emptiest one,
which others may fill; one with more containers than its bound sends the
emptiest half on.  What is sent is dealt to as many new partitions as its count
asks for and packed again, until nothing is sent, one partition holds all of it,
the bound over a round certifies it as a whole, or a round gains nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .encoding import VOCABULARY, encode_texts

#: Texts that a partition packs; bounds a task's memory.
PART_ITEMS = 20_000
#: Share of an uncertified partition's unused space that goes on to the next round, in at most half of its containers.
EXCHANGED = 0.9
#: A round that saves a smaller share of its containers is the last.
LEAST_GAIN = 0.001
#: A table of capacities is a parameter; more rows than this are an error.
MOST_PACKS = 1000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes from 0 to capacity, taken from large to small, ties in the given order."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rests, count = 0, 0  # bit r: a container has room r
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fit = open_rests >> size
        if fit:
            rest = size + (fit & -fit).bit_length() - 1
            stack = by_rest[rest]
            number = stack.pop()
            if not stack:
                open_rests &= ~(1 << rest)
        else:
            number, rest = count, capacity
            count += 1
        bins[item] = number
        rest -= size
        by_rest[rest].append(number)
        open_rests |= 1 << rest
    return bins


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing of these sizes (each ``counts`` times) needs fewer containers.

    The largest bound that three families of dual-feasible functions give:
    thresholds that round large items up and small ones away, rounding down to
    multiples of 1/k, and the two-sided rounding with a step.
    """
    keep = (sizes > 0) & (counts > 0)
    sizes, counts = sizes[keep].astype(np.int64), counts[keep].astype(np.int64)
    if not len(sizes):
        return 0
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    best = -(-int((sizes * counts).sum()) // capacity)
    mass = np.concatenate([[0], np.cumsum(sizes * counts)])
    many = np.concatenate([[0], np.cumsum(counts)])
    cuts = np.unique(np.concatenate([sizes[2 * sizes <= capacity], [1]]))
    low = np.searchsorted(sizes, cuts, "left")
    high = np.searchsorted(sizes, capacity - cuts, "right")
    totals = (many[-1] - many[high]) * capacity + mass[high] - mass[low]
    best = max(best, int(-(-totals // capacity).max()))
    for k in range(1, 41):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # in units of capacity / (k * capacity)
        value = np.where(whole, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    for step in np.unique(np.linspace(1, capacity // 2, 64).astype(np.int64)):
        if step < 1:
            continue
        parts = capacity // int(step)
        up = 2 * (parts - (capacity - sizes) // step)
        down = 2 * (sizes // step)
        value = np.where(2 * sizes > capacity, up, np.where(2 * sizes == capacity, parts, down))
        best = max(best, -(-int((value * counts).sum()) // (2 * parts)))
    return best


_ITEM = "pack_id long, capacity long, part long, row_no long, doc_id long, piece long, token_from long, n_tokens long, container string"
_HELD = "pack_id long, capacity long, container string, doc_id long, piece long, token_from long, n_tokens long"


def _packer(round_no: int, last: bool, part_items: int):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("row_no", "ascending"), ("piece", "ascending")])
        capacity, part = table["capacity"][0].as_py(), key[1].as_py()
        sizes = table["n_tokens"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        before = table["container"].combine_chunks().cast(pa.string())
        if before.null_count == 0 and len(before.unique()) <= bins.max(initial=-1) + 1:
            # the exchange gained nothing here
            bins = before.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = int(bins.max(initial=-1)) + 1
        fill = np.bincount(bins, weights=sizes, minlength=count)
        goes = np.zeros(count, bool)
        values, times = np.unique(sizes, return_counts=True)
        least = min(count, max(1, lower_bound(values, times, capacity)))
        if not last and count:
            room = capacity - fill
            order = np.argsort(-room, kind="stable")
            upto = min(np.searchsorted(np.cumsum(room[order]), EXCHANGED * room.sum()) + 1, max(1, count // 2)) if count > least else 1
            goes[order[:upto]] = True
            # containers of very many tiny texts stay, so that what meets in a partition is bounded
            goes &= (room > 0) & (np.bincount(bins, minlength=count) <= max(1, part_items // 4))
        names = np.array([f"{round_no}.{part}.{b}" for b in range(count)], object)
        out = table.set_column(table.schema.get_field_index("container"), "container", pa.array(names[bins], pa.string()))
        return out.append_column("before", before).append_column("goes", pa.array(goes[bins], pa.bool_())).append_column("least", pa.array(np.full(len(bins), least), pa.int64()))

    return pack


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    return encode_texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary, counts_only=True)


def _capacities(packs: DataFrame) -> list[tuple[int, int]]:
    rows = packs.where("pack_id is not null and capacity_tokens > 0").select(F.col("pack_id").cast("long"), F.col("capacity_tokens").cast("long")).distinct().limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} capacities")
    return sorted((r[0], r[1]) for r in rows)


def pack_texts(sizes: DataFrame, packs: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(pack_id, capacity, container, doc_id, piece, token_from, n_tokens): what each container holds.

    ``sizes``: (doc_id, n_tokens), ``packs``: (pack_id, capacity_tokens); rows of
    packs with a null or a capacity under 1 are ignored.  Every row of sizes is
    packed once for each capacity.  A text of more tokens than the capacity
    gives full pieces, each alone in its container, and a rest that is packed as
    the others are; no other text is split.  Texts without tokens (null and
    empty ones too) take a place but no room.  Repeated rows are packed each.
    Within an exchange, containers are named round.partition.number, full pieces
    full.row.piece; names are unique for a pack_id.
    """
    capacities = _capacities(packs)
    if not capacities:
        return sizes.sparkSession.createDataFrame([], _HELD)
    out, rounds = _rounds(sizes, capacities, part_items)
    for packed in rounds:
        out = out.unionByName(packed.where("not goes").select(*out.columns))
    return out


def partition_bounds(sizes: DataFrame, packs: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(pack_id, capacity, round, part, containers, least, certified, sent): each partition of each round against its own bound.

    ``least`` comes from the dual-feasible functions over what the partition
    packs, ``certified`` tells that it has no more containers than that, ``sent``
    how many of them went on to the next round.
    """
    capacities = _capacities(packs)
    if not capacities:
        return sizes.sparkSession.createDataFrame([], "pack_id long, capacity long, round int, part long, containers long, least long, certified boolean, sent long")
    found = [
        packed.groupBy("pack_id", "capacity", F.lit(k).alias("round"), "part").agg(F.count_distinct("container").alias("containers"), F.max("least").alias("least"), F.count_distinct(F.when(F.col("goes"), F.col("container"))).alias("sent"))
        for k, packed in enumerate(_rounds(sizes, capacities, part_items)[1])
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("pack_id", "capacity", "round", "part", "containers", "least", (F.col("containers") <= F.col("least")).alias("certified"), "sent")


def _settled(packed: DataFrame, first: bool) -> tuple[list[int], int]:
    """The packs of a round that are done, and the most items that one of the others sends on.

    Done are those whose containers, taken over all partitions, are as few as
    any packing of their texts could have, that sent nothing, or that a round
    after the first saved too little for.
    """

    def bound(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        least = lower_bound(table["n_tokens"].to_numpy(), table["count"].to_numpy(), key[1].as_py())
        return pa.table({"pack_id": pa.array([key[0].as_py()], pa.int64()), "least": pa.array([max(1, least)], pa.int64())})

    # sizes are whole and at most the capacity, so a pack has no more of them than that
    bounds = packed.groupBy("pack_id", "capacity", "n_tokens").count().groupBy("pack_id", "capacity").applyInArrow(bound, "pack_id long, least long").groupBy("pack_id").agg(F.sum("least").alias("least"))
    have = packed.groupBy("pack_id").agg(F.count_distinct("container").alias("now"), F.count_distinct("before").alias("before"), F.sum(F.col("goes").cast("long")).alias("sent"))
    done, most = [], 0
    # packs are at most MOST_PACKS
    for r in have.join(bounds, "pack_id").collect():
        if r["now"] <= r["least"] or not r["sent"] or (not first and r["before"] - r["now"] < LEAST_GAIN * r["before"]):
            done.append(r["pack_id"])
        else:
            most = max(most, r["sent"])
    return done, most


def _rounds(sizes: DataFrame, capacities: list[tuple[int, int]], part_items: int) -> tuple[DataFrame, list[DataFrame]]:
    """The full pieces, and what the partitions of each round packed: items with ``goes`` to the next round and the partition's ``least``."""
    shared_folder(sizes.sparkSession)
    rows = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).withColumn("row_no", F.monotonically_increasing_id()).checkpoint()
    total = rows.count()
    choices = F.array(*[F.struct(F.lit(p).cast("long").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in capacities])
    each = rows.select("*", F.explode(choices).alias("c")).select("row_no", "doc_id", "n_tokens", "c.pack_id", "c.capacity")
    each = each.withColumn("whole", F.when(F.col("n_tokens") > F.col("capacity"), F.expr("n_tokens div capacity")).otherwise(F.lit(0)).cast("long"))
    full = each.where("whole > 0").select("pack_id", "capacity", "row_no", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"), F.col("capacity").alias("n_tokens"))
    full = full.select("pack_id", "capacity", F.concat_ws(".", F.lit("full"), "row_no", "piece").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_from"), "n_tokens")
    parts = max(1, -(-total // part_items))
    rest = each.withColumn("left", F.col("n_tokens") - F.col("whole") * F.col("capacity")).where("left > 0 or whole = 0").select(
        "pack_id", "capacity", F.pmod(F.xxhash64("row_no"), F.lit(parts)).alias("part"), "row_no", "doc_id", F.col("whole").alias("piece"), (F.col("whole") * F.col("capacity")).alias("token_from"), F.col("left").alias("n_tokens"), F.lit(None).cast("string").alias("container")
    )
    rounds: list[DataFrame] = []
    while True:
        last = parts == 1
        packed = rest.groupBy("pack_id", "part").applyInArrow(_packer(len(rounds), last, part_items), _ITEM + ", before string, goes boolean, least long")
        if last:
            return full, [*rounds, packed]
        packed = packed.checkpoint()
        done, sent = _settled(packed, not rounds)  # sent is 0 if all are done
        rounds.append(packed.withColumn("goes", F.col("goes") & ~F.col("pack_id").isin(done)))
        if not sent:
            return full, rounds
        # as many partitions as what is sent needs; containers stay whole, so a little more may meet in one
        parts = -(-sent // part_items)
        rest = rounds[-1].where("goes").drop("goes", "least", "before").withColumn("part", F.pmod(F.xxhash64("container", F.lit(len(rounds))), F.lit(parts)))


def packing_report(sizes: DataFrame, packs: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(pack_id, capacity, containers, least, tokens, unused, filled): each packing against the bound no packing can beat.

    ``least`` comes from the dual-feasible functions over the sizes of all texts
    together; only counts by size are collected, at most as many as the capacity.
    """
    spark = sizes.sparkSession
    packed = pack_texts(sizes, packs, part_items)
    total = packed.groupBy("pack_id", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    by_size = packed.groupBy("pack_id", "capacity", "n_tokens").count().collect()
    least = []
    for p, c in sorted({(r[0], r[1]) for r in by_size}):
        own = [(r[2], r[3]) for r in by_size if (r[0], r[1]) == (p, c)]
        least.append((p, c, max(1, lower_bound(np.array([x for x, _ in own]), np.array([x for _, x in own]), c))))
    bounds = spark.createDataFrame(least, "pack_id long, capacity long, least long")
    return total.join(F.broadcast(bounds), ["pack_id", "capacity"]).select(
        "pack_id", "capacity", "containers", "least", "tokens", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled")
    )
