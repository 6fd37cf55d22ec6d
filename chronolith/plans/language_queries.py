"""Queries in the language over the driver's tables, with SQL for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.series_keys import canonical_key
from ..operators import storage

#: The current time of these queries: 2024-01-31.
NOW_NS = 1_706_659_200 * 10**9
#: Keeps means of hundredths off the ties of rounding, where engines differ.
OFF_TIES = 3e-8


def engine(spark: SparkSession, folder: str) -> Engine:
    """An engine with the star schema's measurements."""
    e = Engine(spark, now_ns=NOW_NS)

    def bind(name: str, time: str, tags: list[str], **more) -> None:
        e.catalog.add_later(name, lambda: spark.read.parquet(f"{folder}/{name}.parquet"), time, tags, **more)

    bind("events", "ts", ["event_type", "user_id"], finite=True)
    bind("lineitem", "l_shipdate", ["l_returnflag", "l_linestatus"], finite=True)
    bind("orders", "o_orderdate", ["o_orderstatus", "o_orderpriority"], finite=True)
    bind("readings", "time", ["measurement", "host", "region"], fields=["usage", "n", "ok", "note", "u"])
    return e


@dataclass
class Query:
    text: str
    sql: str
    #: columns rounded to 6 places in both
    rounded: list[str] = field(default_factory=list)
    params: dict | None = None


_DAY = "time >= '2024-01-05' AND time < '2024-01-08'"
_SQL_DAY = "ts >= '2024-01-05' AND ts < '2024-01-08'"


def _bucket(i: str, origin: str = "1970-01-01") -> str:
    return f"time_bucket(INTERVAL '{i}', ts, TIMESTAMP '{origin}')"


def _filled(how: str) -> str:
    return f"""WITH b AS (
        SELECT {_bucket("10 minutes")} AS time, event_type, avg(value) AS v FROM events WHERE {_SQL_DAY} GROUP BY ALL
    ), spine AS (
        SELECT event_type, t AS time FROM (SELECT DISTINCT event_type FROM b), generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-07 23:50:00', INTERVAL '10 minutes') g(t)
    ), laid AS (
        SELECT s.time, s.event_type, v FROM spine s LEFT JOIN b USING (time, event_type)
    ), around AS (
        SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER n AS t1
        FROM laid WINDOW p AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ) SELECT time, event_type, {how} AS mean FROM around"""


def _filled_whole(how: str) -> str:
    """As ``_filled`` without bounds of time: each series from its own first to its own last bucket."""
    return f"""WITH b AS (
        SELECT {_bucket("10 minutes")} AS time, event_type, avg(value) AS v FROM events GROUP BY ALL
    ), spine AS (
        SELECT event_type, unnest(generate_series(min(time), max(time), INTERVAL '10 minutes')) AS time FROM b GROUP BY event_type
    ), laid AS (
        SELECT s.time, s.event_type, v FROM spine s LEFT JOIN b USING (time, event_type)
    ), around AS (
        SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER n AS t1
        FROM laid WINDOW p AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ) SELECT time, event_type, {how} AS mean FROM around"""


_LINE = "WINDOW w AS (PARTITION BY event_type ORDER BY ts)"

QUERIES: dict[str, Query] = {
    "where_tag_time": Query(
        f"SELECT event_id, user_id, value FROM events WHERE {_DAY} AND event_type = 'click' AND (value > 10 OR value <= 2)",
        f"SELECT ts AS time, event_id, user_id::VARCHAR AS user_id, value FROM events WHERE {_SQL_DAY} AND event_type = 'click' AND (value > 10 OR value <= 2)",
    ),
    "where_now": Query("SELECT value FROM events WHERE time > now() - 3d AND time <= now()", "SELECT ts AS time, value FROM events WHERE ts > TIMESTAMP '2024-01-28' AND ts <= TIMESTAMP '2024-01-31'"),
    "where_nanoseconds": Query("SELECT value FROM events WHERE time >= 1704412800000000001 AND time < 1704499200s", "SELECT ts AS time, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00.000001' AND ts < TIMESTAMP '2024-01-06'"),
    "where_regex": Query("SELECT value FROM events WHERE event_type =~ /^(click|view)$/", "SELECT ts AS time, value FROM events WHERE regexp_matches(event_type, '^(click|view)$')"),
    "where_not_regex": Query("SELECT value, event_type FROM events WHERE event_type !~ /^c/", "SELECT ts AS time, value, event_type FROM events WHERE NOT regexp_matches(event_type, '^c')"),
    "where_not_equal": Query("SELECT value FROM events WHERE event_type <> 'click' AND value != 0", "SELECT ts AS time, value FROM events WHERE event_type <> 'click' AND value <> 0"),
    "where_typed": Query("SELECT value FROM events WHERE event_id::integer = 5 OR value::string = 'x' OR event_type::tag = 'error'", "SELECT ts AS time, value FROM events WHERE event_id = 5 OR event_type = 'error'"),
    "where_null_tag": Query("SELECT usage FROM readings WHERE region = ''", "SELECT time, CASE WHEN NOT isnan(usage) THEN usage END AS usage FROM readings WHERE coalesce(region, '') = '' AND usage IS NOT NULL AND NOT isnan(usage)"),
    "bind_parameters": Query("SELECT value FROM events WHERE event_type = $kind AND value > $\"least value\"", "SELECT ts AS time, value FROM events WHERE event_type = 'view' AND value > 30.5", params={"kind": "view", "least value": 30.5}),
    "arith_div_zero": Query("SELECT value / (event_id % 2) AS x, (value + 1) * 2 - event_id AS y, -value AS z, 10 / 4 * 1.0 AS c FROM events", "SELECT ts AS time, CASE WHEN event_id % 2 = 0 THEN 0 ELSE value END AS x, (value + 1) * 2 - event_id AS y, -value AS z, 2.0::DOUBLE AS c FROM events", ["x", "y"]),
    "bitwise": Query("SELECT event_id & 7 AS a, event_id | 8 AS o, event_id ^ 5 AS x FROM events", "SELECT ts AS time, event_id & 7 AS a, event_id | 8 AS o, xor(event_id, 5) AS x FROM events"),
    "cast_field": Query("SELECT value::integer AS i, event_id::float AS f, value::string AS s FROM events", "SELECT ts AS time, trunc(value)::BIGINT AS i, event_id::DOUBLE AS f, NULL::VARCHAR AS s FROM events"),
    "math_functions": Query("SELECT abs(value - 50) AS a, ceil(value) AS c, floor(value) AS f, sqrt(value) AS s, pow(value, 2) AS p, ln(value + 1) AS l, log10(value + 1) AS t, atan2(value, 2) AS n FROM events", "SELECT ts AS time, abs(value - 50) AS a, ceil(value)::DOUBLE AS c, floor(value)::DOUBLE AS f, sqrt(value) AS s, pow(value, 2) AS p, ln(value + 1) AS l, log10(value + 1) AS t, atan2(value, 2) AS n FROM events", ["a", "s", "p", "l", "t", "n"]),
    "wildcard_all": Query("SELECT * FROM events", "SELECT ts AS time, event_id, props, value, event_type, user_id::VARCHAR AS user_id FROM events"),
    "wildcard_fields": Query("SELECT *::field FROM events", "SELECT ts AS time, event_id, props, value FROM events"),
    "wildcard_tags": Query("SELECT value, *::tag FROM events", "SELECT ts AS time, value, event_type, user_id::VARCHAR AS user_id FROM events"),
    "regex_fields": Query("SELECT /^(v|e)/ FROM events", "SELECT ts AS time, event_id, value, event_type FROM events"),
    "agg_count_star": Query("SELECT count(*) FROM events GROUP BY event_type", "SELECT event_type, count(event_id) AS count_event_id, count(props) AS count_props, count(value) AS count_value FROM events GROUP BY event_type"),
    "agg_regex": Query("SELECT sum(/l_q|l_tax/) FROM lineitem GROUP BY /l_ret/", "SELECT l_returnflag, sum(l_quantity) AS sum_l_quantity, sum(l_tax) AS sum_l_tax FROM lineitem GROUP BY l_returnflag", ["sum_l_quantity", "sum_l_tax"]),
    "agg_plain": Query("SELECT count(value) AS n, sum(value) / count(value) AS m, min(value), max(value), mean(value), spread(value) FROM events", "SELECT count(value) AS n, sum(value) / count(value) AS m, min(value) AS min, max(value) AS max, avg(value) AS mean, max(value) - min(value) AS spread FROM events", ["m", "mean", "spread"]),
    "agg_count_distinct": Query("SELECT count(DISTINCT value) AS a, count(distinct(event_id)) AS b FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT value) AS a, count(DISTINCT event_id) AS b FROM events GROUP BY event_type"),
    "agg_statistics": Query("SELECT median(value), stddev(value), mode(event_id), percentile(value, 90) AS p90 FROM events GROUP BY event_type", "SELECT event_type, median(value) AS median, stddev_samp(value) AS stddev, min(event_id) AS mode, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type", ["median", "stddev"]),
    "select_distinct": Query("SELECT DISTINCT value FROM events GROUP BY event_type", "SELECT DISTINCT event_type, value AS \"distinct\" FROM events"),
    "group_by_all_tags": Query("SELECT sum(l_quantity) FROM lineitem GROUP BY *", "SELECT l_linestatus, l_returnflag, sum(l_quantity) AS sum FROM lineitem GROUP BY ALL", ["sum"]),
    "sum_by_time": Query(f"SELECT sum(value) FROM events WHERE {_DAY} GROUP BY TIME(1h) FILL(none)", f"SELECT {_bucket('1 hour')} AS time, sum(value) AS sum FROM events WHERE {_SQL_DAY} GROUP BY ALL", ["sum"]),
    "sum_by_time_tag": Query("SELECT sum(value), count(value) FROM events GROUP BY TIME(6h * 2), event_type FILL(none)", f"SELECT {_bucket('12 hours')} AS time, event_type, sum(value) AS sum, count(value) AS count FROM events GROUP BY ALL", ["sum"]),
    "window_offset": Query("SELECT count(value) FROM events GROUP BY TIME(1h, 15m) FILL(none)", f"SELECT {_bucket('1 hour', '1970-01-01 00:15:00')} AS time, count(value) AS count FROM events GROUP BY ALL"),
    "window_offset_text": Query("SELECT count(value) FROM events GROUP BY TIME(7d, '2024-01-01') FILL(none)", f"SELECT {_bucket('7 days', '2024-01-01')} AS time, count(value) AS count FROM events GROUP BY ALL"),
    "window_tz": Query(
        "SELECT count(l_quantity) FROM lineitem GROUP BY TIME(1d) FILL(none) TZ('Australia/Hobart')",
        "SELECT timezone('UTC', timezone('Australia/Hobart', date_trunc('day', timezone('Australia/Hobart', timezone('UTC', l_shipdate))))) AS time, count(l_quantity) AS count FROM lineitem GROUP BY ALL",
    ),
    "fill_null": Query(f"SELECT mean(value) FROM events WHERE {_DAY} GROUP BY TIME(10m), event_type", _filled("v"), ["mean"]),
    "fill_none": Query(f"SELECT mean(value) FROM events WHERE {_DAY} GROUP BY TIME(10m), event_type FILL(none)", f"SELECT {_bucket('10 minutes')} AS time, event_type, avg(value) AS mean FROM events WHERE {_SQL_DAY} GROUP BY ALL", ["mean"]),
    "fill_value": Query(f"SELECT mean(value) FROM events WHERE {_DAY} GROUP BY TIME(10m), event_type FILL(-1.5)", _filled("coalesce(v, -1.5)"), ["mean"]),
    "fill_previous": Query(f"SELECT mean(value) FROM events WHERE {_DAY} GROUP BY TIME(10m), event_type FILL(previous)", _filled("v0"), ["mean"]),
    "fill_linear": Query(f"SELECT mean(value) FROM events WHERE {_DAY} GROUP BY TIME(10m), event_type FILL(linear)", _filled("coalesce(v, v0 + (v1 - v0) * ((epoch_us(time) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))))"), ["mean"]),
    "sum_by_time_whole": Query("SELECT sum(value) FROM events GROUP BY TIME(1h) FILL(none)", f"SELECT {_bucket('1 hour')} AS time, sum(value) AS sum FROM events GROUP BY ALL", ["sum"]),
    "fill_null_whole": Query("SELECT mean(value) FROM events GROUP BY TIME(10m), event_type", _filled_whole("v"), ["mean"]),
    "fill_none_whole": Query("SELECT mean(value) FROM events GROUP BY TIME(10m), event_type FILL(none)", f"SELECT {_bucket('10 minutes')} AS time, event_type, avg(value) AS mean FROM events GROUP BY ALL", ["mean"]),
    "fill_value_whole": Query("SELECT mean(value) FROM events GROUP BY TIME(10m), event_type FILL(-1.5)", _filled_whole("coalesce(v, -1.5)"), ["mean"]),
    "fill_previous_whole": Query("SELECT mean(value) FROM events GROUP BY TIME(10m), event_type FILL(previous)", _filled_whole("v0"), ["mean"]),
    "fill_linear_whole": Query("SELECT mean(value) FROM events GROUP BY TIME(10m), event_type FILL(linear)", _filled_whole("coalesce(v, v0 + (v1 - v0) * ((epoch_us(time) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))))"), ["mean"]),
    "first_last": Query("SELECT first(value), last(value) FROM events GROUP BY event_type", "SELECT event_type, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY event_type"),
    "selector_with_fields": Query("SELECT max(value), event_id, user_id FROM events GROUP BY event_type", "SELECT ts AS time, event_type, value AS max, event_id, user_id::VARCHAR AS user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts) = 1"),
    "top_bottom": Query("SELECT top(value, 5), event_id FROM events GROUP BY event_type", "SELECT ts AS time, event_type, value AS top, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts) <= 5"),
    "bottom": Query("SELECT bottom(value, event_type, 4) FROM events", "SELECT ts AS time, value AS bottom, event_type FROM events ORDER BY value, ts LIMIT 4"),
    "difference": Query("SELECT difference(value) AS d, non_negative_difference(value) AS n, elapsed(value, 1s) AS e FROM events GROUP BY event_type", f"SELECT * FROM (SELECT ts AS time, event_type, value - lag(value) OVER w AS d, CASE WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w END AS n, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS e FROM events {_LINE}) WHERE d IS NOT NULL", ["d", "n"]),
    "derivative": Query("SELECT derivative(value, 1h) AS d FROM events GROUP BY event_type", f"SELECT * FROM (SELECT ts AS time, event_type, (value - lag(value) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000) AS d FROM events {_LINE}) WHERE d IS NOT NULL", ["d"]),
    "transforms_of_one_series": Query(
        "SELECT difference(value) AS d, derivative(value, 1m) AS r, elapsed(value, 1s) AS e, cumulative_sum(event_id) AS c FROM events",
        "SELECT ts AS time, value - lag(value) OVER w AS d, (value - lag(value) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000) AS r, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS e, sum(event_id) OVER w::BIGINT AS c FROM events WINDOW w AS (ORDER BY ts)",
        ["d", "r"],
    ),
    "derivative_of_mean": Query("SELECT derivative(mean(value), 1d) AS d FROM events GROUP BY TIME(1d) FILL(none)", f"SELECT * FROM (SELECT time, m - lag(m) OVER (ORDER BY time) AS d FROM (SELECT {_bucket('1 day')} AS time, avg(value) AS m FROM events GROUP BY ALL)) WHERE d IS NOT NULL", ["d"]),
    "moving_average": Query("SELECT moving_average(value, 5) AS m, cumulative_sum(event_id) AS c FROM events GROUP BY event_type", "SELECT ts AS time, event_type, CASE WHEN count(*) OVER f = 5 THEN avg(value) OVER f END AS m, sum(event_id) OVER (PARTITION BY event_type ORDER BY ts)::BIGINT AS c FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts ROWS 4 PRECEDING)", ["m"]),
    "integral": Query("SELECT integral(value, 1h) FROM events GROUP BY event_type", f"SELECT event_type, sum(coalesce(a, 0)) AS integral FROM (SELECT event_type, (value + lag(value) OVER w) / 2 * ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000) AS a FROM events {_LINE}) GROUP BY event_type", ["integral"]),
    "order_limit_offset": Query("SELECT value FROM events GROUP BY event_type ORDER BY time DESC LIMIT 7 OFFSET 3", "SELECT ts AS time, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) BETWEEN 4 AND 10"),
    "limit_all": Query("SELECT value FROM events ORDER BY time LIMIT 10 OFFSET 5", "SELECT ts AS time, value FROM events ORDER BY ts LIMIT 10 OFFSET 5"),
    "slimit_soffset": Query("SELECT sum(value) FROM events GROUP BY user_id SLIMIT 20 SOFFSET 5", "SELECT user_id::VARCHAR AS user_id, sum(value) AS sum FROM events GROUP BY user_id ORDER BY user_id::VARCHAR LIMIT 20 OFFSET 5", ["sum"]),
    "soffset": Query("SELECT sum(value) FROM events GROUP BY user_id SOFFSET 25", "SELECT user_id::VARCHAR AS user_id, sum(value) AS sum FROM events GROUP BY user_id ORDER BY user_id::VARCHAR OFFSET 25", ["sum"]),
    "multi_source": Query("SELECT value, o_totalprice FROM events, orders", "SELECT 'events' AS name, ts AS time, value, NULL::DOUBLE AS o_totalprice FROM events UNION ALL SELECT 'orders', o_orderdate, NULL, o_totalprice FROM orders"),
    "regex_source": Query("SELECT count(value) AS a, count(o_totalprice) AS b FROM /^(events|orders)$/ GROUP BY TIME(30d) FILL(none)", f"SELECT 'events' AS name, {_bucket('30 days')} AS time, count(value) AS a, 0::BIGINT AS b FROM events GROUP BY ALL UNION ALL SELECT 'orders', time_bucket(INTERVAL '30 days', o_orderdate, TIMESTAMP '1970-01-01'), 0, count(o_totalprice) FROM orders GROUP BY ALL"),
    "qualified_source": Query("SELECT count(value) FROM main.autogen.events, main..orders", "SELECT 'events' AS name, count(value) AS count FROM events UNION ALL SELECT 'orders', 0"),
    "subquery": Query("SELECT max(m) - min(m) AS d FROM (SELECT mean(value) AS m FROM events GROUP BY TIME(1d), event_type FILL(none)) WHERE m > 10 GROUP BY event_type", f"SELECT event_type, max(m) - min(m) AS d FROM (SELECT {_bucket('1 day')} AS t, event_type, avg(value) AS m FROM events GROUP BY ALL) WHERE m > 10 GROUP BY event_type", ["d"]),
    "show_measurements": Query("SHOW MEASUREMENTS WITH MEASUREMENT =~ /e.*s/", "SELECT * FROM (VALUES ('events'), ('orders'), ('readings')) v(name)"),
    "show_measurements_where": Query("SHOW MEASUREMENTS WHERE event_type = 'click'", "SELECT 'events' AS name"),
    "show_tag_keys": Query("SHOW TAG KEYS FROM events, lineitem LIMIT 3", "SELECT * FROM (VALUES ('events', 'event_type'), ('events', 'user_id'), ('lineitem', 'l_linestatus')) v(name, \"tagKey\")"),
    "show_tag_keys_where": Query("SHOW TAG KEYS FROM /./ WHERE l_returnflag = 'R'", "SELECT * FROM (VALUES ('lineitem', 'l_linestatus'), ('lineitem', 'l_returnflag')) v(name, \"tagKey\")"),
    "show_tag_values": Query("SHOW TAG VALUES FROM events WITH KEY IN (event_type, user_id) WHERE value > 20", "SELECT DISTINCT 'events' AS name, 'event_type' AS key, event_type AS value FROM events WHERE value > 20 UNION SELECT DISTINCT 'events', 'user_id', user_id::VARCHAR FROM events WHERE value > 20"),
    "show_tag_values_regex": Query("SHOW TAG VALUES WITH KEY !~ /user|host|region|measurement/", "SELECT DISTINCT 'events' AS name, 'event_type' AS key, event_type AS value FROM events UNION SELECT DISTINCT 'lineitem', 'l_returnflag', l_returnflag FROM lineitem UNION SELECT DISTINCT 'lineitem', 'l_linestatus', l_linestatus FROM lineitem UNION SELECT DISTINCT 'orders', 'o_orderstatus', o_orderstatus FROM orders UNION SELECT DISTINCT 'orders', 'o_orderpriority', o_orderpriority FROM orders"),
    "show_field_keys": Query("SHOW FIELD KEYS FROM events", "SELECT * FROM (VALUES ('events', 'event_id', 'integer'), ('events', 'props', 'string'), ('events', 'value', 'float')) v(name, \"fieldKey\", \"fieldType\")"),
    "show_databases": Query("SHOW DATABASES", "SELECT 'main' AS name"),
    "show_retention_policies": Query("SHOW RETENTION POLICIES ON main", "SELECT 'main' AS database, 'autogen' AS name, '0s' AS duration, '0s' AS \"shardDuration\", 1::BIGINT AS replication, true AS \"isDefault\""),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = QUERIES[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = engine(spark, folder).sql(q.text, q.params)
        return df.withColumns({c: F.round(F.col(c) + OFF_TIES, 6) for c in q.rounded}) if q.rounded else df

    return run


def delete_range(spark: SparkSession, folder: str) -> DataFrame:
    """What is left after DELETE, twice."""
    e = engine(spark, folder)
    e.query(f"DELETE FROM events WHERE {_DAY} AND event_type = 'click'; DELETE FROM /^ev/ WHERE user_id = '7'")
    return e.sql("SELECT event_id, value FROM events")


def drop_and_create(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    e.query("DROP MEASUREMENT orders; CREATE DATABASE other WITH DURATION 7d REPLICATION 2 SHARD DURATION 1h NAME week")
    return e.sql("SHOW RETENTION POLICIES ON other").withColumn("measurements", e.sql("SHOW MEASUREMENTS").agg(F.count("*")).scalar())


def dedupe_last_write(spark: SparkSession, folder: str) -> DataFrame:
    """One reading of each series and time: the one of the last file."""
    r = spark.read.parquet(f"{folder}/readings.parquet").select("measurement", "host", "time", "usage", "n", "file_seq", "ingested_at")
    return storage.last_write(r, ["measurement", "host", "time"], ["file_seq", "ingested_at"]).select("measurement", "host", "time", "file_seq", "ingested_at")


def merge_files(spark: SparkSession, folder: str) -> DataFrame:
    """Two overlapping files: the second one's points win."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    first, second = e.where("event_id % 3 < 2"), e.where("event_id % 3 > 0").withColumn("value", F.col("value") + 1000)
    return storage.merge_files([first, second], ["event_type", "user_id", "ts"]).select("event_id", "value")


def pivot_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Long points as wide rows."""
    e = spark.read.parquet(f"{folder}/lineitem.parquet")
    long = storage.to_long(e, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])
    return storage.to_wide(long, ["l_orderkey", "l_linenumber"], "field", "value", ["l_quantity", "l_discount", "l_tax"])


def align_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Two fields of different points, aligned on key and time."""
    e = spark.read.parquet(f"{folder}/events.parquet").select("event_type", "user_id", "ts", "value", "event_id")
    a = e.where("value > 20").select("event_type", "user_id", "ts", "value")
    b = e.where("event_id % 2 = 0").select("event_type", "user_id", "ts", "event_id")
    return storage.align_fields([a, b], ["event_type", "user_id", "ts"])


def tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """Points outside the deleted ranges of their key: an hour around each value over 150."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    gone = e.where("value > 150").select("event_type", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("min_time"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("max_time"))
    return storage.apply_tombstones(e, gone, ["event_type"], "ts").select("event_id", "event_type")


def delete_keys(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet")
    return storage.delete_keys(e, e.where("value > 100").select("event_type", "user_id"), ["event_type", "user_id"]).select("event_id")


def series_listing(spark: SparkSession, folder: str) -> DataFrame:
    return storage.series(spark.read.parquet(f"{folder}/readings.parquet"), ["measurement", "host", "region"])


def known_series(spark: SparkSession, folder: str) -> DataFrame:
    """Series of events that also clicked."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    return storage.known_series(storage.series(e.where("event_type = 'view'"), ["user_id"]), e.where("event_type = 'click'"), ["user_id"], missing=True)


def create_series(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the log's series: the live ones they have, or new ones."""
    key = canonical_key("series_key").alias("series_key")
    old = spark.read.parquet(f"{folder}/series_segments.parquet").select(key, "series_id", "flag")
    return storage.create_series(old, spark.read.parquet(f"{folder}/series_log.parquet").select(key), flag="flag")


def block_pruning(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks whose range meets a range of time."""
    b = spark.read.parquet(f"{folder}/index_entries.parquet")
    return storage.overlapping(b, F.lit(1737500000000000000), F.lit(1737700000000000000)).select("file_seq", "block_offset")


def time_range(spark: SparkSession, folder: str) -> DataFrame:
    return storage.time_range(spark.read.parquet(f"{folder}/readings.parquet"))


def seek(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts")
    return storage.seek(storage.exclude(e, F.lit("2024-01-22").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"), "ts"), F.lit("2024-01-20").cast("timestamp_ntz"), time="ts")


def approx_series_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """About how many series (measurement and all tags) the readings of each measurement are."""
    return storage.series_cardinality(spark.read.parquet(f"{folder}/readings.parquet"), ["measurement", "host", "region"], ["measurement"])


def sample(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).sql("SELECT sample(value, 10), event_id FROM events GROUP BY event_type")


def explain(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).sql("EXPLAIN VERBOSE SELECT mean(value) FROM events GROUP BY TIME(1d)")


_DIRECT = (delete_range, drop_and_create, dedupe_last_write, merge_files, pivot_fields, align_fields, tombstones, delete_keys, series_listing, known_series, create_series, block_pruning, time_range, seek, approx_series_cardinality, sample, explain)

_DIRECT_SQL = {
    "delete_range": f"SELECT ts AS time, event_id, value FROM events WHERE NOT ({_SQL_DAY} AND event_type = 'click') AND user_id <> 7",
    "drop_and_create": "SELECT 'other' AS database, 'week' AS name, '1w' AS duration, '1h' AS \"shardDuration\", 2::BIGINT AS replication, true AS \"isDefault\", 3::BIGINT AS measurements",
    "dedupe_last_write": "SELECT measurement, host, time, file_seq, ingested_at FROM readings QUALIFY row_number() OVER (PARTITION BY measurement, host, time ORDER BY file_seq DESC, ingested_at DESC) = 1",
    "merge_files": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE value + 1000 END AS value FROM events",
    "pivot_fields": "SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY ALL",
    "align_fields": "SELECT event_type, user_id, ts, CASE WHEN value > 20 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN event_id END AS event_id FROM events WHERE value > 20 OR event_id % 2 = 0",
    "tombstones": "SELECT event_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events g WHERE g.value > 150 AND g.event_type = e.event_type AND e.ts BETWEEN g.ts - INTERVAL 1 HOUR AND g.ts + INTERVAL 1 HOUR)",
    "delete_keys": "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events g WHERE g.value > 100 AND g.event_type = e.event_type AND g.user_id = e.user_id)",
    "series_listing": "SELECT DISTINCT measurement, host, region FROM readings",
    "known_series": "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')",
    "block_pruning": "SELECT file_seq, block_offset FROM index_entries WHERE min_time <= 1737700000000000000 AND max_time >= 1737500000000000000",
    "time_range": "SELECT min(time) AS min_time, max(time) AS max_time FROM readings",
    "seek": "SELECT event_id, ts FROM events WHERE ts >= '2024-01-20' AND NOT ts BETWEEN '2024-01-22' AND '2024-01-25'",
}


def queries():
    return {n: _run(n) for n in QUERIES} | {f.__name__: f for f in _DIRECT}


def oracle_sql() -> dict[str, str]:
    def rounded(q: Query) -> str:
        if not q.rounded:
            return q.sql
        return f"SELECT * REPLACE ({', '.join(f'round({c} + {OFF_TIES}, 6) AS {c}' for c in q.rounded)}) FROM ({q.sql})"

    return {n: rounded(q) for n, q in QUERIES.items()} | _DIRECT_SQL
