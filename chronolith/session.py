"""A session with the settings this engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("chronolith")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in more.items()}
    for k, v in conf.items():
        build = build.config(k, v)
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; on one machine, as in tests, one under the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def parts_for(df, bytes_each: int, least: int = 12) -> int:
    """How many partitions of about ``bytes_each`` a table's input makes, by the planner's estimate.

    A table whose size nobody knows gets as many as a shuffle has.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // bytes_each))
