"""Queries of the general data problems, with SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series_keys import canonical_key
from ..operators.drift import consistent_points, field_changes, field_lifespans
from ..operators.heavy import heavy_keys, key_statistics
from ..operators.intervals import periods_and_gaps
from ..operators.regular import empty_buckets, regular_series


#: Keeps means of hundredths off the ties of rounding, where engines differ.
OFF_TIES = 3e-8


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _covered(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _table(spark, folder, "index_entries").select(F.lit("block").alias("scope"), F.col("series_key").alias("entity"), "min_time", "max_time")
    files = _table(spark, folder, "file_stats").select(F.lit("file").alias("scope"), F.concat("db", F.lit("."), "rp").alias("entity"), F.col("time_range.min_time").alias("min_time"), F.col("time_range.max_time").alias("max_time"))
    return periods_and_gaps(blocks.unionByName(files), ["scope", "entity"], "min_time", "max_time")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _covered(spark, folder).where("is_gap").select("scope", "entity", F.col("first").alias("gap_start"), F.col("last").alias("gap_end"))


def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    return _covered(spark, folder).where("not is_gap").select("scope", "entity", F.col("first").alias("period_start"), F.col("last").alias("period_end"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return field_changes(_table(spark, folder, "measurement_fields"))


def p3_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    return field_lifespans(_table(spark, folder, "measurement_fields")).select("measurement", "field_id", "first_file", "last_file", "files")


def p3_points(spark: SparkSession, folder: str) -> DataFrame:
    return consistent_points(_table(spark, folder, "raw_points"), _table(spark, folder, "measurement_fields"), read_cut=True)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return empty_buckets(_table(spark, folder, "readings"), _table(spark, folder, "select_statements")).select("measurement", "host", "bucket_us")


def p5_grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_series(_table(spark, folder, "readings"), _table(spark, folder, "select_statements"))


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    return p5_grid(spark, folder).select("stmt_id", "measurement", "host", "bucket_us", "n", "observed", F.round(F.col("value") + OFF_TIES, 6).alias("value"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(_table(spark, folder, "readings"), ["measurement", "host"]).where("host is not null").select("measurement", "host")


def p6_series(spark: SparkSession, folder: str) -> DataFrame:
    s = key_statistics(_table(spark, folder, "readings"), ["measurement", "host"], "usage", "time")
    return s.select("measurement", "host", "n", "n_values", F.round("total", 4).alias("total"), F.round(F.col("mean") + OFF_TIES, 6).alias("mean"), F.round("deviation", 4).alias("deviation"), "least", "most", "first_time", "last_time", "first_value", "last_value")


def p6_log_keys(spark: SparkSession, folder: str) -> DataFrame:
    log = _table(spark, folder, "series_log").select(canonical_key("series_key").alias("key"), "entry_id", "logged_at")
    return key_statistics(log, ["key"], "entry_id", "logged_at").select("key", "n", "first_time", "last_time")


def queries():
    return {f.__name__: f for f in (p2_found, p2_periods, p3_found, p3_lifespans, p3_points, p5_found, p5_grid, p5_fill, p6_found, p6_series, p6_log_keys)}


_RANGES = """ranges AS (
  SELECT 'block' AS scope, series_key AS entity, min_time AS lo, max_time AS hi FROM index_entries
  UNION ALL SELECT 'file', db || '.' || rp, time_range.min_time, time_range.max_time FROM file_stats
), counted AS (
  SELECT * FROM ranges WHERE entity IS NOT NULL AND lo <= hi AND lo <> -9223372036854775808 AND hi <> -9223372036854775808
), reached AS (
  SELECT *, max(hi) OVER (PARTITION BY scope, entity ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM counted
)"""

#: The canonical text of a series key, as ``canonical_key`` gives it.
KEY_SQL = r"""CASE WHEN series_key IS NOT NULL THEN (
  WITH a AS (SELECT string_split(replace(replace(replace(replace(series_key, chr(1), chr(1) || chr(1)), '\,', chr(1) || 'c'), '\=', chr(1) || 'e'), '\ ', ' '), ',') AS parts)
  SELECT array_to_string([replace(parts[1], '=', chr(1) || 'e')] || list_sort(list_distinct(list_transform(
    list_filter(parts[2:], lambda p: strpos(p, '=') > 0 AND strpos(p, '=') < length(p)),
    lambda p: left(p, strpos(p, '=')) || replace(substr(p, strpos(p, '=') + 1), '=', chr(1) || 'e')))), ',') FROM a
) END"""

_GRIDS = """pieces AS (
  SELECT stmt_id, measurement, fill, time_from, time_to,
    list_sum(list_transform(regexp_extract_all(lower(time_interval), '\\d+(?:ms|s|m|h|d)'), lambda x: regexp_extract(x, '\\d+')::BIGINT * map {'ms': 1000, 's': 1000000, 'm': 60000000, 'h': 3600000000, 'd': 86400000000}[regexp_extract(x, '[a-z]+')]))::BIGINT AS i,
    coalesce(list_sum(list_transform(regexp_extract_all(lower(time_offset), '\\d+(?:ms|s|m|h|d)'), lambda x: regexp_extract(x, '\\d+')::BIGINT * map {'ms': 1000, 's': 1000000, 'm': 60000000, 'h': 3600000000, 'd': 86400000000}[regexp_extract(x, '[a-z]+')]))::BIGINT, 0) AS o
  FROM select_statements
), kept AS (
  SELECT p.*, host, epoch_us(time) AS t, usage, file_seq, ingested_at FROM readings JOIN pieces p USING (measurement)
  WHERE host IS NOT NULL AND time IS NOT NULL AND usage IS NOT NULL AND NOT isnan(usage) AND (time_from IS NULL OR time >= time_from) AND (time_to IS NULL OR time < time_to)
), placed AS (
  SELECT *, t - ((t - o) % i + i) % i AS bucket FROM kept
), last_write AS (
  SELECT stmt_id, measurement, host, i, o, fill, time_from, time_to, bucket, t, arg_max(usage, (file_seq, ingested_at, usage)) AS usage FROM placed GROUP BY ALL
), seen AS (
  SELECT stmt_id, measurement, host, i, o, fill, time_from, time_to, bucket, count(*) AS n, avg(usage) AS mean FROM last_write GROUP BY ALL
), spans AS (
  SELECT stmt_id, measurement, host, i, fill,
    CASE WHEN time_from IS NULL THEN min(bucket) ELSE epoch_us(time_from) - ((epoch_us(time_from) - o) % i + i) % i END AS a,
    CASE WHEN time_to IS NULL THEN max(bucket) ELSE epoch_us(time_to) - 1 - ((epoch_us(time_to) - 1 - o) % i + i) % i END AS b
  FROM seen GROUP BY stmt_id, measurement, host, i, o, fill, time_from, time_to
), grid AS (
  SELECT stmt_id, measurement, host, fill, unnest(range(a, b + 1, i)) AS bucket FROM spans
), laid AS (
  SELECT g.*, n, mean FROM grid g LEFT JOIN seen USING (stmt_id, measurement, host, bucket)
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_RANGES} SELECT scope, entity, reach + 1 AS gap_start, lo - 1 AS gap_end FROM reached WHERE lo > reach + 1",
        "p2_periods": f"""WITH {_RANGES}, numbered AS (
            SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scope, entity ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM reached
        ) SELECT scope, entity, min(lo) AS period_start, max(hi) AS period_end FROM numbered GROUP BY scope, entity, island""",
        "p3_found": """WITH own AS (
            SELECT DISTINCT measurement, file_seq, field_id, field_name, CASE WHEN field_type IN (1, 2, 3, 4, 9) THEN field_type END AS type FROM measurement_fields WHERE measurement IS NOT NULL
        ), files AS (
            SELECT measurement, file_seq, lag(file_seq) OVER w AS before, lead(file_seq) OVER w AS after FROM (SELECT DISTINCT measurement, file_seq FROM own) WINDOW w AS (PARTITION BY measurement ORDER BY file_seq)
        ), placed AS (
            SELECT o.*, f.before, f.after, p.field_id IS NULL AS added, n.field_id IS NULL AND f.after IS NOT NULL AS gone, p.field_name AS old_name
            FROM own o JOIN files f USING (measurement, file_seq)
            LEFT JOIN own p ON p.measurement = o.measurement AND p.file_seq = f.before AND p.field_id = o.field_id
            LEFT JOIN own n ON n.measurement = o.measurement AND n.file_seq = f.after AND n.field_id = o.field_id
        ), stays AS (
            SELECT *, sum(added::INT) OVER (PARTITION BY measurement, field_id ORDER BY file_seq) AS stay FROM placed
        ), typed AS (
            SELECT *, last_value(type IGNORE NULLS) OVER (PARTITION BY measurement, field_id, stay ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_type FROM stays
        )
        SELECT measurement, file_seq, field_id, 'added' AS change FROM typed WHERE added AND before IS NOT NULL
        UNION ALL SELECT measurement, after, field_id, 'removed' FROM typed WHERE gone
        UNION ALL SELECT measurement, file_seq, field_id, 'renamed' FROM typed WHERE NOT added AND field_name <> old_name
        UNION ALL SELECT measurement, file_seq, field_id, 'retyped' FROM typed WHERE NOT added AND type <> old_type""",
        "p3_lifespans": """WITH own AS (
            SELECT DISTINCT measurement, file_seq, field_id FROM measurement_fields WHERE measurement IS NOT NULL
        ), files AS (
            SELECT measurement, file_seq, row_number() OVER (PARTITION BY measurement ORDER BY file_seq) AS k FROM (SELECT DISTINCT measurement, file_seq FROM own)
        ), runs AS (
            SELECT o.*, k - row_number() OVER (PARTITION BY measurement, field_id ORDER BY file_seq) AS run FROM own o JOIN files USING (measurement, file_seq)
        ) SELECT measurement, field_id, min(file_seq) AS first_file, max(file_seq) AS last_file, count(*) AS files FROM runs GROUP BY measurement, field_id, run""",
        "p5_found": f"WITH {_GRIDS} SELECT measurement, host, bucket AS bucket_us FROM laid WHERE n IS NULL",
        "p5_fill": f"""WITH {_GRIDS}, around AS (
            SELECT *, last_value(mean IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN n IS NOT NULL THEN bucket END IGNORE NULLS) OVER w AS b0,
              first_value(mean IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN n IS NOT NULL THEN bucket END IGNORE NULLS) OVER f AS b1, coalesce(regexp_extract(lower(fill), 'fill\\(([^)]*)\\)', 1), 'null') AS how
            FROM laid WINDOW w AS (PARTITION BY stmt_id, host ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY stmt_id, host ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ) SELECT stmt_id, measurement, host, bucket AS bucket_us, coalesce(n, 0) AS n, n IS NOT NULL AS observed,
            round(CASE WHEN n IS NOT NULL THEN mean WHEN how = 'previous' THEN v0 WHEN how = 'linear' THEN v0 + (v1 - v0) * ((bucket - b0) / (b1 - b0)) ELSE try_cast(how AS DOUBLE) END + {OFF_TIES}, 6) AS value
        FROM around WHERE n IS NOT NULL OR how <> 'none'""",
        "p6_found": "SELECT measurement, host FROM readings WHERE host IS NOT NULL GROUP BY measurement, host HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM readings)",
        "p6_log_keys": f"SELECT key, count(*) AS n, min(logged_at) AS first_time, max(logged_at) AS last_time FROM (SELECT {KEY_SQL} AS key, logged_at FROM series_log) GROUP BY key",
        "p6_series": f"""SELECT measurement, host, count(*) AS n, count(v) AS n_values, round(sum(v), 4) AS total, round(avg(v) + {OFF_TIES}, 6) AS mean, round(stddev_samp(v), 4) AS deviation, min(v) AS least, max(v) AS most,
            min(time) AS first_time, max(time) AS last_time, (min(CASE WHEN v IS NOT NULL AND time IS NOT NULL THEN {{'t': time, 'v': v}} END)).v AS first_value, (max(CASE WHEN v IS NOT NULL AND time IS NOT NULL THEN {{'t': time, 'v': v}} END)).v AS last_value
            FROM (SELECT *, CASE WHEN NOT isnan(usage) THEN usage END AS v FROM readings) GROUP BY measurement, host""",
    }
