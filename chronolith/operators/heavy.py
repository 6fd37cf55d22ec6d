"""A few keys holding most records (problem 6).

Every statistic is algebraic: tasks fold their rows into one small state a key
before the shuffle (spilling when there are too many keys), and only these
states meet.  A key that holds most rows sends a state per task like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_statistics(rows: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """(keys..., n, n_values, total, mean, deviation, least, most, first_time, last_time, first_value, last_value) of each key.

    Null keys are keys.  A null or NaN value counts in n only.  first and last
    value are those at the least and greatest time that have both, the least
    and greatest value on a tie.  An empty table gives no row.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    both = F.when(v.isNotNull() & F.col(time).isNotNull(), F.struct(F.col(time), v.alias("v")))
    own = rows.select(*keys, v.alias("__v"), F.col(time).alias("__t"), both.alias("__b"))
    return own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("__v").alias("n_values"), F.sum("__v").alias("total"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("deviation"), F.min("__v").alias("least"), F.max("__v").alias("most"),
        F.min("__t").alias("first_time"), F.max("__t").alias("last_time"), F.min("__b").getField("v").alias("first_value"), F.max("__b").getField("v").alias("last_value"),
    )


def heavy_keys(rows: DataFrame, keys: list[str], percent: int = 3) -> DataFrame:
    """(keys..., n): keys that hold at least ``percent`` % of all rows; rows with a null key count among all."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total")).scalar()
    return counts.where(F.col("n") * 100 >= total * percent)
