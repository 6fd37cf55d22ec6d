"""Queries over the driver's tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series_keys import canonical_key
from ..plans.data_queries import KEY_SQL
from .distinct import distinct_counts, sketch
from .encoding import encode_texts
from .membership import audit, seen_before
from .packing import pack_texts, packing_report, partition_bounds, token_counts
from .spans import shared_pairs, shared_parts, shared_spans


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_sketches(spark: SparkSession, folder: str) -> DataFrame:
    log = _table(spark, folder, "series_log").select("series_key", F.to_date("logged_at").alias("day"), "db", "measurement", "region")
    return sketch(log, canonical_key("series_key"), ["day", "db", "measurement", "region"])


def p1_series_counts(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_counts(p1_sketches(spark, folder))


def p1_measurement_counts(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_counts(sketch(_table(spark, folder, "measurement_fields"), F.col("measurement"), ["field_type"]))


def p1_measurement_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Exact counts of measurement names beside the sketches': whether they lie within five standard errors."""
    f = _table(spark, folder, "measurement_fields")
    found = distinct_counts(sketch(f, F.col("measurement"), ["field_type"]), deviations=5.0)
    exact = f.groupBy("field_type").agg(F.count_distinct("measurement").alias("exact")).withColumn("t", F.lit(0)).unionByName(f.agg(F.count_distinct("measurement").alias("exact")).select(F.lit(None).cast("int").alias("field_type"), "exact", F.lit(1).alias("t")))
    exact = exact.withColumnRenamed("field_type", "k")
    return found.join(exact, (found.totals == exact.t) & found.field_type.eqNullSafe(exact.k)).select("totals", "field_type", "exact", F.col("exact").between(F.floor("low"), F.ceil("high")).alias("within"))


def p4_seen(spark: SparkSession, folder: str) -> DataFrame:
    return seen_before(_table(spark, folder, "series_segments"), _table(spark, folder, "series_log"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_seen(spark, folder).where("seen").select("entry_id")


def p4_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(_table(spark, folder, "series_segments"), _table(spark, folder, "series_log"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(_table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(token_counts(_table(spark, folder, "documents")), _table(spark, folder, "pack_sizes"))


def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(token_counts(_table(spark, folder, "documents")), _table(spark, folder, "pack_sizes"))


def p8_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return partition_bounds(token_counts(_table(spark, folder, "documents")), _table(spark, folder, "pack_sizes"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_pairs(_table(spark, folder, "documents"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(_table(spark, folder, "documents"))


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_parts(_table(spark, folder, "documents"), links=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_series_counts, p1_sketches, p1_measurement_counts, p1_measurement_audit, p4_found, p4_seen, p4_audit, p7_ids, p8_containers, p8_bounds, p8_partitions, p9_found, p9_spans, p9_shared)}


_SEEN = f"""WITH keys AS (
  SELECT entry_id, {KEY_SQL} AS key FROM series_log UNION ALL SELECT -1, {KEY_SQL} FROM series_segments
), firsts AS (
  SELECT key, min(entry_id) AS first FROM keys WHERE key IS NOT NULL GROUP BY key
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_measurement_audit": "SELECT 0 AS totals, field_type, count(DISTINCT measurement) AS exact, true AS within FROM measurement_fields GROUP BY field_type UNION ALL SELECT 1, NULL, count(DISTINCT measurement), true FROM measurement_fields",
        "p4_found": f"{_SEEN} SELECT entry_id FROM keys JOIN firsts USING (key) WHERE entry_id > first",
        "p4_seen": f"{_SEEN} SELECT entry_id, entry_id > first AS seen FROM keys LEFT JOIN firsts USING (key) WHERE entry_id >= 0",
    }
