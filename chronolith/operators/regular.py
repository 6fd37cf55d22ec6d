"""Irregular readings onto a regular grid (problem 5).

Readings become the mean of each bucket.  For every series a regression on a
trend and harmonics of the day is fitted: tasks add up the products of its
normal equations, and a vectorised solve runs over series.  An empty bucket's
model value is the prediction plus the residuals of the observed buckets around
it, bridged in a straight line; its value is what the statement's fill asks for.

Only observed buckets are put in order, in stretches; empty ones are made from
the gap between two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

# Microseconds of the units of a duration.
UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
DAY = UNITS["d"]
HARMONICS = 2
#: Ridge of the normal equations relative to their diagonal, for series with few or equal times.
RIDGE = 1e-9
#: Empty buckets that one row stands for before they are spelled out.
STRETCH = 10_000


def duration_us(text: Column | str) -> Column:
    """Microseconds of a duration as people type it, such as 1h30m; null if it is none.

    Pieces of an integer and a unit (ms, s, m, h, d; any case, blanks allowed) are added up.
    """
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    whole = c.rlike(r"^\s*(\d+\s*(ms|s|m|h|d)\s*)+$")
    pieces = F.regexp_extract_all(c, F.lit(r"(\d+)\s*(ms|s|m|h|d)"), F.lit(0))
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    each = F.transform(pieces, lambda p: F.regexp_extract(p, r"\d+", 0).cast("long") * F.element_at(factor, F.regexp_extract(p, r"[a-z]+", 0)))
    return F.when(whole, F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def grids(statements: DataFrame) -> DataFrame:
    """(stmt_id, measurement, interval, offset, fill, low, high) of the usable statements, times in microseconds.

    A null offset is 0, a null fill 'null'; fill is in lower case, without the
    word and the brackets.  Statements with a null measurement, without a valid
    interval of at least 1 ms or with an invalid offset are left out.
    """
    offset = F.when(F.col("time_offset").isNull(), F.lit(0).cast("long")).otherwise(duration_us("time_offset"))
    fill = F.coalesce(F.regexp_extract(F.lower("fill"), r"^\s*(?:fill\s*\(\s*)?([^()\s]*)\s*\)?\s*$", 1), F.lit("null"))
    return statements.select(
        "stmt_id", "measurement", duration_us("time_interval").alias("interval"), offset.alias("offset"), F.when(fill == "", "null").otherwise(fill).alias("fill"), micros(F.col("time_from")).alias("low"), micros(F.col("time_to")).alias("high")
    ).where("measurement is not null and interval > 0 and offset is not null")


def _bucket(t: Column) -> Column:
    return t - F.pmod(t - F.col("offset"), F.col("interval"))


def counted_readings(readings: DataFrame, statements: DataFrame) -> DataFrame:
    """The readings that count for each statement, with their bucket and the statement's columns."""
    g = grids(statements)
    own = readings.select("measurement", "host", micros(F.col("time")).alias("t"), F.col("usage").cast("double").alias("usage"), *[F.col(c) for c in ("file_seq", "ingested_at")])
    own = own.where(F.col("host").isNotNull() & F.col("t").isNotNull() & F.col("usage").isNotNull() & ~F.isnan("usage"))
    met = own.join(g, "measurement")
    return met.where((F.col("low").isNull() | (F.col("t") >= F.col("low"))) & (F.col("high").isNull() | (F.col("t") < F.col("high")))).withColumn("bucket", _bucket(F.col("t")))


_SERIES = ["stmt_id", "measurement", "host"]
_GRID = ["interval", "offset", "fill", "low", "high"]


def _observed(counted: DataFrame) -> DataFrame:
    """(series, grid, bucket, n, mean): each observed bucket; of a time written more than once the last write counts."""
    latest = counted.groupBy(*_SERIES, *_GRID, "bucket", "t").agg(F.max(F.struct("file_seq", "ingested_at", "usage")).getField("usage").alias("usage"))
    return latest.groupBy(*_SERIES, *_GRID, "bucket").agg(F.count("*").alias("n"), F.avg("usage").alias("mean"))


def _holes(observed: DataFrame, carried: list[str]) -> DataFrame:
    """A row for each empty bucket, with the bucket and ``carried`` columns of the observed ones before (b_) and after (a_) it.

    A series is put in order in stretches of buckets; each ends with a copy of
    the first bucket after it, so only a row a stretch is sorted by series.
    """
    step = F.col("interval")
    sides = ["bucket", *carried]
    rows = observed.withColumn("stretch", F.expr(f"bucket div (interval * {STRETCH})"))
    series = Window.partitionBy(*_SERIES).orderBy("stretch")
    heads = rows.groupBy(*_SERIES, "stretch").agg(F.min(F.struct(*sides)).alias("head"))
    heads = heads.select(*_SERIES, "stretch", F.lead("head").over(series).alias("head"), F.lag("stretch").over(series).isNull().alias("earliest"))
    ends = heads.select(*_SERIES, "stretch", *[F.col(f"head.{c}").alias(c) for c in sides], "earliest")
    rows = rows.withColumn("earliest", F.lit(None).cast("boolean")).unionByName(ends, allowMissingColumns=True)
    line = Window.partitionBy(*_SERIES, "stretch").orderBy("earliest", "bucket")  # copies, which have it, come last
    whole = Window.partitionBy(*_SERIES, "stretch")
    met = rows.withColumns({f"next_{c}": F.lead(c).over(line) for c in sides} | {"first": F.lag("bucket").over(line).isNull() & F.max("earliest").over(whole)}).where("earliest is null")
    lowest, highest = F.when(F.col("low").isNotNull(), _bucket(F.col("low"))), F.when(F.col("high").isNotNull(), _bucket(F.col("high") - 1))

    def hole(start: Column, stop: Column, ahead: bool) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(ahead).alias("ahead"))

    holes = F.array(
        hole(F.col("bucket") + step, F.coalesce(F.col("next_bucket") - step, highest, F.col("bucket")), False),
        F.when(F.col("first"), hole(F.coalesce(lowest, F.col("bucket")), F.col("bucket") - step, True)),
    )
    rows = met.select(*_SERIES, *_GRID, *sides, *[f"next_{c}" for c in sides], F.explode(F.filter(holes, lambda h: h.isNotNull() & (h["start"] <= h["stop"]))).alias("h"))
    rows = rows.select(
        *_SERIES, *_GRID, F.col("h.start").alias("start"), F.col("h.stop").alias("stop"),
        *[F.when(~F.col("h.ahead"), F.col(c)).alias(f"b_{c}") for c in sides], *[F.when(F.col("h.ahead"), F.col(c)).otherwise(F.col(f"next_{c}")).alias(f"a_{c}") for c in sides],
    )
    far = step * STRETCH
    rows = rows.select("*", F.explode(F.sequence("start", "stop", far)).alias("piece"))
    return rows.select("*", F.explode(F.sequence("piece", F.least(F.col("stop"), F.col("piece") + far - step), step)).alias("bucket")).drop("piece", "start", "stop")


def _features(t: Column, middle: Column, width: Column) -> list[Column]:
    """1, the trend from -1 to 1 and the waves of the day."""
    angle = F.pmod(t, F.lit(DAY)) * (2 * pi / DAY)
    return [F.lit(1.0), (t - middle) / width, *[f(angle * k) for k in range(1, HARMONICS + 1) for f in (F.sin, F.cos)]]


def fit(observed: DataFrame) -> DataFrame:
    """(series, middle, width, weights): the least-squares weights of each series' regression."""
    span = observed.groupBy(*_SERIES).agg(F.min("bucket").alias("least"), F.max("bucket").alias("most"))
    span = span.select(*_SERIES, ((F.col("least") + F.col("most")) / 2).alias("middle"), F.greatest((F.col("most") - F.col("least")) / 2, F.lit(1.0)).alias("width"))
    x = _features(F.col("bucket"), F.col("middle"), F.col("width"))
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = observed.join(span, _SERIES).withColumns({f"x{i}": c for i, c in enumerate(x)}).groupBy(*_SERIES, "middle", "width").agg(
        F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("products"), F.array(*[F.sum(F.col(f"x{i}") * F.col("mean")) for i in range(p)]).alias("moments")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column(5).flatten().to_numpy().reshape(n, len(pairs))
            right = batch.column(6).flatten().to_numpy().reshape(n, p)
            left = np.zeros((n, p, p))
            for k, (i, j) in enumerate(pairs):
                left[:, i, j] = left[:, j, i] = flat[:, k]
            left[:, range(p), range(p)] += RIDGE * (1 + left[:, 0, 0])[:, None]
            w = np.linalg.solve(left, right[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(np.arange(0, n * p + 1, p), pa.int32()), pa.array(w.ravel()))], [*batch.schema.names[:5], "weights"])

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    out = ", ".join(f"{c} {kinds[c]}" for c in (*_SERIES, "middle", "width"))
    return sums.select(*_SERIES, "middle", "width", "products", "moments").mapInArrow(solve, out + ", weights array<double>")


def _modelled(readings: DataFrame, statements: DataFrame) -> DataFrame:
    """Every bucket of each series' grid, as ``regular_series`` describes them, with the statement's fill; buckets to fill with none too."""
    shared_folder(readings.sparkSession)
    # every part below needs the observed buckets
    seen = _observed(counted_readings(readings, statements)).checkpoint()
    model = fit(seen)
    met = seen.join(model, _SERIES)
    x = _features(F.col("bucket"), F.col("middle"), F.col("width"))
    predict = reduce(lambda a, b: a + b, [F.col("weights")[i] * c for i, c in enumerate(x)])
    met = met.withColumn("rest", F.col("mean") - predict)
    full = met.select(*_SERIES, "fill", F.col("bucket").alias("bucket_us"), "n", F.lit(True).alias("observed"), F.col("mean").alias("value"), predict.alias("model"))
    holes = _holes(met, ["mean", "rest", "middle", "width", "weights"])
    part = (F.col("bucket") - F.col("b_bucket")) / (F.col("a_bucket") - F.col("b_bucket"))
    rest = F.coalesce(F.col("b_rest") + (F.col("a_rest") - F.col("b_rest")) * part, "b_rest", "a_rest")
    holes = holes.withColumns({c: F.coalesce(f"b_{c}", f"a_{c}") for c in ("middle", "width", "weights")})
    linear = F.col("b_mean") + (F.col("a_mean") - F.col("b_mean")) * part
    value = F.when(F.col("fill") == "previous", F.col("b_mean")).when(F.col("fill") == "linear", linear).otherwise(F.col("fill").try_cast("double"))
    holes = holes.select(*_SERIES, "fill", F.col("bucket").alias("bucket_us"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("observed"), value.alias("value"), (predict + rest).alias("model"))
    return full.unionByName(holes)


def modelled_gaps(readings: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt_id, measurement, host, bucket_us, model): the buckets of each series' grid without a counted reading, with the regression's value.

    A grid runs from the bucket of time_from to that of the last microsecond
    before time_to, or from or to the series' own first or last counted bucket
    where a bound is null.  A series without a counted reading has no grid.  The
    fill plays no role.  An empty bucket without a model value is an error.
    """
    return _modelled(readings, statements).where("not observed").select(*_SERIES, "bucket_us", F.coalesce("model", F.raise_error(F.lit("an empty bucket has no model value")).cast("double")).alias("model"))


def empty_buckets(readings: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt_id, measurement, host, bucket_us): the buckets of ``modelled_gaps``, each of which the regression was evaluated for."""
    return modelled_gaps(readings, statements).where("model is not null").drop("model")


def regular_series(readings: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt_id, measurement, host, bucket_us, n, observed, value, model): each series on its statement's grid.

    ``observed`` buckets have the mean of their readings; of readings of one
    series and time, the one with the greatest file_seq (then ingested_at, then
    usage) counts.  An empty bucket's ``value`` follows the fill: null, a number,
    previous (the observed value before), linear (between its neighbours; null
    at the ends); with none it has no row; an unknown fill gives null.  ``model``
    is the regression's value, with residuals bridged in empty buckets and held
    constant beyond the ends.
    """
    return _modelled(readings, statements).where("observed or fill <> 'none'").drop("fill")
