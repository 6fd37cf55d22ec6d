"""The engine's windows over streams.

A stream's time is declared with a watermark; windows are given out once it has
passed them, so each comes once and late points are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import q


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The stream with a zoned ``time`` column and points up to ``late`` behind accepted."""
    out = stream.withColumn("time", q(time).cast("timestamp"))
    return (out if time == "time" else out.drop(time)).withWatermark("time", late)


def windowed(stream: DataFrame, interval: str, tags: list[str], *aggregates: Column, offset: str = "0 seconds") -> DataFrame:
    """(time, tags..., aggregates...) of each window; ``stream`` as from ``timed``.  Windows start at 1970 plus the offset."""
    w = F.window("time", interval, interval, offset)
    out = stream.groupBy(w.alias("w"), *[q(t) for t in tags]).agg(*aggregates)
    return out.select(F.col("w.start").alias("time"), *[c for c in out.columns if c != "w"])


def first_writes(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Points without repeats of their keys; state is kept as long as the watermark says."""
    return stream.dropDuplicatesWithinWatermark(keys)


def to_folders(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Starts writing each batch to its own Parquet folder.  A batch that runs again replaces its folder, so each row is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
