"""Storage semantics: the last write wins, ranges are deleted, fields are aligned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import q
from .regular import micros


def last_write(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one written last by ``order``; ties by all other columns, so that it is the same row in every run.

    Nulls come before all values.  Writes of a key are compared within tasks
    before they are shuffled.  Predicates on the keys pass below it, those on
    other columns don't.  Columns without an order (maps) are not allowed.
    """
    rest = [c for c in points.columns if c not in keys and c not in order]
    whole = F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate([*order, *rest])])
    last = points.groupBy(*[q(k) for k in keys]).agg(F.max(whole).alias("__last"))
    own = {c: F.col("__last").getField(f"c{i}").alias(c) for i, c in enumerate([*order, *rest])}
    return last.select(*[own.get(c, q(c)) for c in points.columns])


def merge_files(files: list[DataFrame], keys: list[str], sequence: str = "file_seq") -> DataFrame:
    """Overlapping files as one: a later file's point replaces an earlier one's."""
    if not files:
        raise ValueError("no files")
    parts = [f.withColumn(sequence, F.lit(i)) for i, f in enumerate(files)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return last_write(out, keys, [sequence]).drop(sequence)


def include(points: DataFrame, low: Column, high: Column, time: str = "time") -> DataFrame:
    """Points from low to high, both included."""
    return points.where(q(time).between(low, high))


def exclude(points: DataFrame, low: Column, high: Column, time: str = "time") -> DataFrame:
    """Points outside low to high; points without a time stay."""
    return points.where(~F.coalesce(q(time).between(low, high), F.lit(False)))


def coalesce_ranges(tombstones: DataFrame, keys: list[str], low: str = "min_time", high: str = "max_time") -> DataFrame:
    """Overlapping tombstones of a key as one (bounds included)."""
    line = Window.partitionBy(*[q(k) for k in keys]).orderBy(low, high)
    reach = F.max(high).over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = tombstones.where(q(low) <= q(high)).withColumn("__new", (reach.isNull() | (reach < q(low))).cast("int"))
    island = F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__i", island).groupBy(*[q(k) for k in keys], "__i").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__i")


def apply_tombstones(points: DataFrame, tombstones: DataFrame, keys: list[str], time: str = "time", low: str = "min_time", high: str = "max_time", few: bool = False, stretch: int | None = None) -> DataFrame:
    """Points that no tombstone of their key covers, both ends included.

    Null keys match null keys; points without a time stay.  Points and beginnings
    of tombstones are put in order within stretches of time (``stretch`` in units
    of the time, an hour by default), with the farthest end of all tombstones that
    begin before a stretch carried into it: a point is covered if an end that is
    known there reaches it.  So neither many points nor many tombstones of one
    key meet in a task.  ``few`` says that the tombstones are few enough to be
    broadcast, merged.
    """
    if few:
        ranges = coalesce_ranges(tombstones, keys, low, high).select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], q(low).alias("__low"), q(high).alias("__high"))
        on = q(time).between(F.col("__low"), F.col("__high"))
        for i, k in enumerate(keys):
            on = on & q(k).eqNullSafe(F.col(f"__k{i}"))
        return points.join(F.broadcast(ranges), on, "left_anti")
    long = isinstance(points.schema[time].dataType, (T.LongType, T.IntegerType))
    ticks = (lambda c: c.cast("long")) if long else micros
    size = stretch or (3_600 * 10**9 if long else 3_600 * 10**6)
    names = [f"__k{i}" for i in range(len(keys))]
    kinds = [points.schema[k].dataType for k in keys]
    whole = F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(points.columns)])
    at = F.expr(f"__t div {size} - if(__t % {size} < 0, 1, 0)")
    begins = tombstones.where(q(low) <= q(high)).select(*[q(k).cast(t).alias(n) for k, t, n in zip(keys, kinds, names)], ticks(q(low)).alias("__t"), ticks(q(high)).alias("__end")).withColumn("__at", at)
    places = points.select(*[q(k).alias(n) for k, n in zip(keys, names)], ticks(q(time)).alias("__t"), whole.alias("__row")).withColumn("__at", at)
    # a row for each key and stretch, with the farthest end that begins in it
    ends = begins.groupBy(*names, "__at").agg(F.max("__end").alias("__end")).unionByName(places.select(*names, "__at").distinct().withColumn("__end", F.lit(None).cast("long"))).groupBy(*names, "__at").agg(F.max("__end").alias("__end"))
    carried = ends.withColumn("__end", F.max("__end").over(Window.partitionBy(*names).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))).where("__end is not null and __at is not null")
    none = F.lit(None).cast(places.schema["__row"].dataType)
    rows = (
        places.withColumns({"__end": F.lit(None).cast("long"), "__order": F.lit(1)})
        .unionByName(begins.withColumns({"__row": none, "__order": F.lit(0)}))
        .unionByName(carried.withColumns({"__t": F.lit(None).cast("long"), "__row": none, "__order": F.lit(0)}))
    )
    line = Window.partitionBy(*names, "__at").orderBy(F.col("__t").asc_nulls_first(), "__order").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("__reach", F.max("__end").over(line)).where(F.col("__row").isNotNull() & ~F.coalesce(F.col("__reach") >= F.col("__t"), F.lit(False)))
    return kept.select(*[F.col("__row").getField(f"c{i}").alias(c) for i, c in enumerate(points.columns)])


def delete_keys(points: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Points of keys that are not in ``gone``; null keys match null keys."""
    other = gone.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & q(k).eqNullSafe(F.col(f"__k{i}"))
    return points.join(other, on, "left_anti")


def to_wide(points: DataFrame, keys: list[str], field: str, value: str, fields: list[str], order: str | None = None) -> DataFrame:
    """A column for each field: the last written value of each key and field, null where there is none."""
    pick = (lambda f: F.max_by(F.when(q(field) == f, q(value)), F.when((q(field) == f) & q(value).isNotNull(), F.struct(q(order), q(value))))) if order else (lambda f: F.max(F.when(q(field) == f, q(value))))
    return points.where(q(field).isin(fields)).groupBy(*[q(k) for k in keys]).agg(*[pick(f).alias(f) for f in fields])


def to_long(points: DataFrame, keys: list[str], fields: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """A row for each field that has a value."""
    pairs = F.array(*[F.struct(F.lit(f).alias(field), q(f).alias(value)) for f in fields])
    return points.select(*[q(k) for k in keys], F.explode(pairs).alias("__p")).select(*[q(k) for k in keys], f"__p.{field}", f"__p.{value}").where(q(value).isNotNull())


def align_fields(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames of one field each as rows with all of them: every key of any frame, null where a frame has none."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out


def series(points: DataFrame, tags: list[str]) -> DataFrame:
    """The different tag sets."""
    return points.select(*[q(t) for t in tags]).distinct()


def known_series(candidates: DataFrame, existing: DataFrame, tags: list[str], missing: bool = False) -> DataFrame:
    """Candidates that exist, or those that don't."""
    other = series(existing, tags).select(*[q(t).alias(f"__k{i}") for i, t in enumerate(tags)])
    on = F.lit(True)
    for i, t in enumerate(tags):
        on = on & q(t).eqNullSafe(F.col(f"__k{i}"))
    return candidates.join(other, on, "left_anti" if missing else "left_semi")


def time_range(points: DataFrame, time: str = "time") -> DataFrame:
    """(min_time, max_time)."""
    return points.agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def seek(points: DataFrame, at: Column, descending: bool = False, time: str = "time") -> DataFrame:
    """Points from a time on, or back from it, in that order."""
    return points.where(q(time) <= at).orderBy(q(time).desc()) if descending else points.where(q(time) >= at).orderBy(q(time).asc())


def overlapping(stats: DataFrame, low: Column, high: Column, min_time: str = "min_time", max_time: str = "max_time") -> DataFrame:
    """Files or blocks whose time range meets low to high."""
    return stats.where((q(min_time) <= high) & (q(max_time) >= low))


def overlapping_keys(stats: DataFrame, low: Column, high: Column, min_key: str = "min_key", max_key: str = "max_key") -> DataFrame:
    """Files whose range of keys meets low to high, by their bytes."""
    return stats.where((q(min_key) <= high) & (q(max_key) >= low))


def write_sorted(points: DataFrame, path: str, tags: list[str], partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet that scans can skip in: rows of a series together, by time."""
    by = [q(t) for t in tags]
    spread = points.repartition(partitions, *by) if partitions else points.repartition(*by)
    spread.sortWithinPartitions(*by, "time").write.mode(mode).parquet(path)


def rewrite(spark, points: DataFrame, path: str, tags: list[str]) -> None:
    """Replaces a measurement's directory by new contents: written beside it, then swapped.

    The old directory is only removed after the new one is complete; a reader
    that started before must be finished.
    """
    hadoop = spark._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path
    new, old = p(path + ".__new"), p(path + ".__old")
    fs = new.getFileSystem(hadoop)
    write_sorted(points, path + ".__new", tags, mode="overwrite")
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(p(path)) and not fs.rename(p(path), old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, p(path)):
        raise OSError(f"can't move {path}.__new")
    fs.delete(old, True)


#: Partitions of series ids; an id tells its partition.
SERIES_PARTITIONS = 8
#: Ranges of hashes that number their new series apart from each other.
_RANGES = 1 << 14
# The flags of entries in series segments.
INSERTED, DELETED = 1, 2


def create_series(existing: DataFrame, candidates: DataFrame, key: str = "series_key", flag: str | None = None) -> DataFrame:
    """(key, series_id, partition_id, is_new) of every different candidate: its live id in ``existing``, or a new one.

    ``existing`` is (key, series_id) and perhaps a ``flag``, without which all
    ids are live.  With it those are live that an entry of flag 1 has and none
    of flag 2: a deleted series that comes back gets a new id.  Of a key with
    several live ids the least counts.  Ids of partition p are p + 1, p + 9,
    p + 17, …; new ones follow the greatest, deleted ones included.  They are
    numbered within ranges of the key's hash, whose sizes are added up first, so
    no task sees all new series.  Null keys are left out.
    """
    live = existing
    if flag:
        live = existing.where(q(flag) == INSERTED).join(existing.where(q(flag) == DELETED).select("series_id"), "series_id", "left_anti")
    known = live.where(q(key).isNotNull()).groupBy(q(key).alias("key")).agg(F.min("series_id").alias("series_id"))
    wanted = candidates.select(q(key).alias("key")).where("key is not null").distinct()
    met = wanted.join(known, "key", "left")
    hashed = F.xxhash64("key")
    new = met.where("series_id is null").select("key", F.pmod(hashed, F.lit(SERIES_PARTITIONS)).cast("int").alias("p"), F.pmod(F.shiftright(hashed, 8), F.lit(_RANGES)).alias("r"))
    sizes = new.groupBy("p", "r").agg(F.count("*").alias("n"))
    before = sizes.select("p", "r", F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    top = existing.groupBy(F.pmod(F.col("series_id") - 1, F.lit(SERIES_PARTITIONS)).cast("int").alias("p")).agg(F.max("series_id").alias("top"))
    numbered = new.withColumn("k", F.row_number().over(Window.partitionBy("p", "r").orderBy("key"))).join(before, ["p", "r"]).join(top, "p", "left")
    first = F.coalesce("top", F.col("p") + 1 - SERIES_PARTITIONS)
    made = numbered.select(F.col("key"), (first + SERIES_PARTITIONS * (F.col("before") + F.col("k"))).cast("long").alias("series_id"), F.lit(True).alias("is_new"))
    old = met.where("series_id is not null").select("key", "series_id", F.lit(False).alias("is_new"))
    out = old.unionByName(made)
    return out.select(F.col("key").alias(key), "series_id", F.pmod(F.col("series_id") - 1, F.lit(SERIES_PARTITIONS)).cast("int").alias("partition_id"), "is_new")


#: Relative standard error of the estimated number of series.
CARDINALITY_ERROR = 0.02


def series_cardinality(points: DataFrame, tags: list[str], by: list[str] | None = None, error: float = CARDINALITY_ERROR) -> DataFrame:
    """(by…, series, error): the estimated number of different tag sets, and its relative standard error.

    A null tag is the empty text.  Rows are sketched where they lie; only
    sketches are shuffled.
    """
    series = F.struct(*[F.coalesce(q(t).cast("string"), F.lit("")).alias(f"t{i}") for i, t in enumerate(tags)])
    return points.groupBy(*[q(b) for b in by or []]).agg(F.approx_count_distinct(series, error).alias("series"), F.lit(error).alias("error"))


def series_sketches(points: DataFrame, tags: list[str], by: list[str], bits: int = 12) -> DataFrame:
    """(by…, sketch): mergeable sketches of the tag sets, to be stored and united later; a null tag is the empty text."""
    key = F.to_json(F.array(*[F.coalesce(q(t).cast("string"), F.lit("")) for t in tags]))
    return points.groupBy(*[q(b) for b in by]).agg(F.hll_sketch_agg(key, bits).alias("sketch"))


def merge_series_sketches(sketches: list[DataFrame], by: list[str]) -> DataFrame:
    """(by…, sketch): the sketches of several tables as one for each group."""
    rows = sketches[0]
    for s in sketches[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*[q(b) for b in by]).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_series(sketches: DataFrame) -> DataFrame:
    """The sketches' estimates, in place of them."""
    return sketches.withColumn("series", F.hll_sketch_estimate("sketch")).drop("sketch")
