"""Queries through block files, series segments, logs of deletions and the syntax tree, with SQL for them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.series_keys import key_measurement, key_of_parts, key_tags
from ..lang import ast as A
from ..lang.parser import parse_condition, parse_expression, parse_statement, parse_statements
from ..lang.visit import Rewriter, Visitor, replace, walk
from ..operators import storage
from ..operators.regular import micros
from ..operators.tombstones import TombstoneLog
from ..session import parts_for, shared_folder
from ..sources import segments
from ..sources.blockfile import block_measurement, read_block_files, read_block_index, write_block_files
from ..sources.codecs import count_packed_between, pack
from .data_queries import KEY_SQL, _table
from .language_queries import NOW_NS, engine

#: Bytes of the points' table for each block file.
FILE_BYTES = 64 << 20


def _own_folder(spark: SparkSession, name: str) -> str:
    """An empty folder of this application on the storage all executors share."""
    at = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return at


# -- block files -------------------------------------------------------------------------


def _typed_points(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as points of one field each, in a column of the field's type."""
    r = _table(spark, folder, "readings").where("measurement is not null and host is not null and time is not null")
    fields = {"usage": "as_float", "n": "as_integer", "ok": "as_boolean", "note": "as_string", "u": "as_unsigned"}
    kinds = {"as_float": "double", "as_integer": "bigint", "as_boolean": "boolean", "as_string": "string", "as_unsigned": "decimal(20,0)"}

    def point(name: str, own: str) -> Column:
        value = F.when(~F.isnan(name), F.col(name)) if name == "usage" else F.col(name)
        return F.struct(F.lit(name).alias("field"), *[(value if c == own else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    rows = r.select(F.concat("measurement", F.lit(",host="), "host").alias("series_key"), (micros(F.col("time")) * 1000).alias("time_ns"), F.explode(F.array(*[point(f, c) for f, c in fields.items()])).alias("p"))
    return rows.select("series_key", "p.field", "time_ns", *[f"p.{c}" for c in kinds])


def _block_files(spark: SparkSession, folder: str, name: str) -> str:
    points = _typed_points(spark, folder)
    at = _own_folder(spark, name)
    write_block_files(points, at, parts_for(_table(spark, folder, "readings"), FILE_BYTES, 3))
    return at


def block_file_points(spark: SparkSession, folder: str) -> DataFrame:
    """Readings written as block files, values of all types in one call, and read back."""
    return read_block_files(spark, _block_files(spark, folder, "points")).drop("file_seq")


def block_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Two fields of a measurement's series in a range of time; the options choose the blocks that are read."""
    at = _block_files(spark, folder, "scan")
    points = read_block_files(spark, at, keyprefix="cpu,", fields=["usage", "n"], mintime=1_740_787_200 * 10**9, maxtime=1_740_873_600 * 10**9 - 1)
    return points.select("series_key", "field", "time_ns", "as_float", "as_integer")


def block_file_select(spark: SparkSession, folder: str) -> DataFrame:
    """Block files as a measurement of the language; its WHERE chooses the blocks."""
    e = Engine(spark, now_ns=NOW_NS)
    block_measurement(e.catalog, "cpu", _block_files(spark, folder, "select"), ["host"], {"usage": "float", "n": "integer", "ok": "boolean", "note": "string", "u": "unsigned"})
    return e.sql("SELECT count(n), max(usage) AS most, last(ok) AS latest FROM cpu WHERE time >= '2025-03-01' AND time < '2025-03-02' AND n > 100 GROUP BY host, TIME(6h) FILL(none)")


def block_file_index(spark: SparkSession, folder: str) -> DataFrame:
    """What the indexes say of each key: type, time range, points (counted without decoding)."""
    index = read_block_index(spark, _block_files(spark, folder, "index"))
    return index.groupBy("key", "type").agg(F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.sum("points").alias("points"))


def block_file_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys, series and points the files of a folder hold."""
    index = read_block_index(spark, _block_files(spark, folder, "counts"))
    return index.agg(F.count_distinct("key").alias("keys"), F.count_distinct(F.substring_index("key", "#!~#", 1)).alias("series"), F.sum("points").alias("points"))


def block_file_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two generations of overlapping files: of a key and time the later file's value counts."""
    points = _typed_points(spark, folder).where("field = 'n'").select("series_key", "field", "time_ns", F.col("as_integer").alias("value"))
    at = _own_folder(spark, "merge")
    files = parts_for(_table(spark, folder, "readings"), FILE_BYTES, 3)
    write_block_files(points, at, files)
    write_block_files(points.where("value % 5 = 0").withColumn("value", -F.col("value")), at, files, generation=1)
    return storage.last_write(read_block_files(spark, at), ["series_key", "field", "time_ns"], ["file_seq"]).select("series_key", "time_ns", "as_integer")


def packed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Values from 2 to 5 in packed words, counted word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(0).dictionary_encode()
            codes, values = flags.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            found = [count_packed_between(pack(values[codes == k]), 2, 5) for k in range(len(flags.dictionary))]
            yield pa.RecordBatch.from_arrays([flags.dictionary, pa.array(found, pa.int64())], ["l_returnflag", "n"])

    rows = _table(spark, folder, "lineitem").where("l_returnflag is not null and l_linenumber is not null").select("l_returnflag", F.col("l_linenumber").cast("long").alias("v"))
    return rows.mapInArrow(run, "l_returnflag string, n bigint").groupBy("l_returnflag").agg(F.sum("n").alias("n"))


# -- series segments -----------------------------------------------------------------------


def _segments(spark: SparkSession, folder: str, name: str) -> tuple[str, DataFrame]:
    rows = _table(spark, folder, "series_segments").where("series_key is not null and series_id is not null")
    at = _own_folder(spark, name)
    segments.write_segments(rows.select("partition_id", "flag", "series_id", key_measurement("series_key").alias("measurement"), key_tags("series_key").alias("tags")), at)
    return at, segments.read_segments(spark, at)


def segment_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The log of series written as segments and scanned."""
    _, log = _segments(spark, folder, "log")
    return log.select("partition_id", "flag", "series_id", key_of_parts(F.col("measurement"), F.col("tags")).alias("key"))


def segment_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Live series and the greatest id of each partition."""
    _, log = _segments(spark, folder, "partitions")
    live = segments.series_offsets(log).groupBy("partition_id").agg(F.count("*").alias("series"))
    return log.groupBy("partition_id").agg(F.max("series_id").alias("max_series_id")).join(live, "partition_id", "left").select("partition_id", "max_series_id", F.coalesce("series", F.lit(0)).alias("series"))


def segment_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """The key that stands at the offset of each live id."""
    _, log = _segments(spark, folder, "offsets")
    at = segments.series_offsets(log)
    found = log.select("partition_id", "offset", key_of_parts(F.col("measurement"), F.col("tags")).alias("key"))
    return at.join(found, ["partition_id", "offset"]).select("series_id", "key")


def segment_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """Live series after one measurement's were deleted and the log was written again."""
    _, log = _segments(spark, folder, "before")
    at = _own_folder(spark, "after")
    segments.write_segments(segments.delete_series(log, log.where("measurement = 'cpu'")), at)
    return segments.series_offsets(segments.read_segments(spark, at)).select("series_id")


def create_series_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each series of the log: whether it gets a new id, and the id it has if not."""
    from .language_queries import create_series

    made = create_series(spark, folder)
    return made.select(F.col("series_key").alias("key"), "is_new", F.when(~F.col("is_new"), F.col("series_id")).alias("series_id"))


# -- deletions, sketches, lookups ------------------------------------------------------------


def tombstone_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A log of deletions, committed twice and once rolled back, read as merged ranges."""
    log = TombstoneLog(spark, _own_folder(spark, "tombstones"))
    e = _table(spark, folder, "events").select(F.col("event_type").alias("key"), (micros(F.col("ts")) * 1000).alias("t"), "value")
    hour = 3_600 * 10**9
    log.add_rows(e.where("value > 150").select("key", (F.col("t") - hour).alias("min_time"), (F.col("t") + hour).alias("max_time")))
    log.commit()
    log.add(["never"])
    log.rollback()
    log.add_range(["click", "view"], 0, 10)
    log.commit()
    return log.ranges()


def series_sketch_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of two halves of the readings, merged: whether the estimate is within four standard errors of the exact count."""
    r = _table(spark, folder, "readings")
    tags = ["host", "region"]
    halves = [storage.series_sketches(r.where(c), tags, ["measurement"]) for c in ("coalesce(n, 0) % 2 = 0", "coalesce(n, 0) % 2 <> 0")]
    estimate = storage.sketched_series(storage.merge_series_sketches(halves, ["measurement"]))
    exact = r.groupBy("measurement").agg(F.count_distinct(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in tags])).alias("exact")).select(F.col("measurement").alias("m"), "exact")
    met = estimate.join(exact, F.col("measurement").eqNullSafe(F.col("m")))
    return met.select("measurement", "exact", (F.abs(F.col("series") - F.col("exact")) <= 4 * 1.04 / 64 * F.col("exact")).alias("within"))


def key_pruning(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose range of keys meets a range."""
    f = _table(spark, folder, "file_stats").select("file_seq", "key_range.min_key", "key_range.max_key")
    return storage.overlapping_keys(f, F.lit("disk"), F.lit("disk~")).select("file_seq")


def include_range(spark: SparkSession, folder: str) -> DataFrame:
    e = _table(spark, folder, "events").select("event_id", "ts")
    return storage.include(e, F.lit("2024-01-22").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"), "ts")


def seek_back(spark: SparkSession, folder: str) -> DataFrame:
    return storage.seek(_table(spark, folder, "events").select("event_id", "ts"), F.lit("2024-01-20").cast("timestamp_ntz"), descending=True, time="ts")


# -- statements ---------------------------------------------------------------------------------


class _Names(Visitor):
    def __init__(self):
        self.found: list[str] = []

    def pre_VarRef(self, node: A.VarRef) -> None:
        self.found.append(node.name)

    def pre_Where(self, node: A.Where) -> bool:
        return False


class _Limited(Rewriter):
    def post_Select(self, node: A.Select) -> A.Select:
        node.limit = node.limit or A.Count("LIMIT", 3)
        return node


def statement_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What parsing, printing, walking and rewriting give for some statements."""
    names = _Names()
    names.visit(parse_statement("SELECT mean(load) / peak FROM disk WHERE other > 1"))
    renamed = replace(parse_statement("SELECT load FROM disk WHERE load > 1"), lambda n: A.VarRef("burden") if isinstance(n, A.VarRef) and n.name == "load" else None)
    found = [
        ("script", "; ".join(map(str, parse_statements("show databases ; /* two */ drop measurement \"my disk\" -- done")))),
        ("condition", str(parse_condition("load>=+5 and (host =~ /^w\\/e/ or ok=true)"))),
        ("expression", str(parse_expression("a..b+-c*(2 - 1.50)"))),
        ("quoting", str(parse_statement("select \"load\", \"select\", \"a b\", 'it\\'s \"so\"' from \"disk\""))),
        ("names", " ".join(names.found)),
        ("rewritten", str(_Limited().rewrite(parse_statement("SELECT load FROM (SELECT load FROM disk)")))),
        ("renamed", str(renamed)),
        ("walked", " ".join(type(n).__name__ for n in walk(parse_expression("f(a, 1)")))),
    ]
    return spark.createDataFrame(found, "what string, text string")


def where_in(spark: SparkSession, folder: str) -> DataFrame:
    """A list of values, which only the tree can say."""

    def listed(node: A.Node) -> A.Node | None:
        return A.Condition(node.left, "IN", [A.Literal("string", t) for t in ("click", "view")]) if isinstance(node, A.Condition) else None

    return engine(spark, folder).run(replace(parse_statement("SELECT value FROM events WHERE event_type = ''"), listed))


def where_true(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).sql("SELECT +value AS value FROM events WHERE true AND 1=1")


def dotted_names(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    o = _table(spark, folder, "orders")
    e.catalog.add("dotted", o.select("o_orderdate", "o_orderstatus", F.col("o_totalprice").alias("price.total"), F.col("o_orderkey").alias("a.b.c")), "o_orderdate", ["o_orderstatus"], finite=True)
    return e.sql("SELECT price.total AS total, a.b.c AS k FROM dotted WHERE price.total > 1000 AND o_orderstatus = 'O'")


def delete_where(spark: SparkSession, folder: str) -> DataFrame:
    """DELETE without FROM, over all measurements."""
    e = engine(spark, folder)
    e.query("DELETE WHERE time < '2024-01-10'")
    return e.sql("SELECT event_id, o_orderkey FROM events, orders")


def show_everywhere(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements of all databases and policies."""
    e = engine(spark, folder)
    e.query("CREATE DATABASE other WITH DURATION 7d NAME week")
    e.catalog.add("clicks", _table(spark, folder, "events"), "ts", ["event_type"], database="other", policy="week")
    return e.sql("SHOW MEASUREMENTS ON *.* OFFSET 1").unionByName(e.sql("SHOW MEASUREMENTS ON other.week WITH MEASUREMENT = clicks").select(F.lit("other").alias("database"), F.lit("week").alias("policy"), "name"))


def show_keys(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    parts = [("=", "SHOW TAG VALUES ON main FROM events WITH KEY = event_type"), ("!=", "SHOW TAG VALUES FROM events WITH KEY != user_id LIMIT 2 OFFSET 1"), ("=~", "SHOW TAG VALUES FROM orders WITH KEY =~ /status/")]
    out = None
    for op, text in parts:
        df = e.sql(text).select(F.lit(op).alias("op"), "name", "key", "value")
        out = df if out is None else out.unionByName(df)
    return out


def explain_analyze(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the plan shown is the one that ran, to its end, and what it was pruned to."""
    plan = engine(spark, folder).sql("EXPLAIN ANALYZE SELECT sum(value) FROM events WHERE time >= '2024-01-20' GROUP BY event_type")
    has = lambda text: F.max(F.instr("plan", text) > 0)
    return plan.agg(has("isFinalPlan=true").alias("final"), has("GreaterThanOrEqual(ts,2024-01-20").alias("pushed"), (~has("user_id")).alias("pruned"))


_QUERIES = (
    block_file_points, block_file_scan, block_file_select, block_file_index, block_file_counts, block_file_merge, packed_counts, segment_entries, segment_partitions, segment_offsets, segment_deletes, create_series_ids, tombstone_ranges,
    series_sketch_bounds, key_pruning, include_range, seek_back, statement_texts, where_in, where_true, dotted_names, delete_where, show_everywhere, show_keys, explain_analyze,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


_KINDS = {"as_float": "DOUBLE", "as_integer": "BIGINT", "as_boolean": "BOOLEAN", "as_string": "VARCHAR", "as_unsigned": "VARCHAR"}


def _points_sql() -> str:
    parts = []
    for field, kind, column, where in (("usage", "float", "as_float", "NOT isnan(usage)"), ("n", "integer", "as_integer", "true"), ("ok", "boolean", "as_boolean", "true"), ("note", "string", "as_string", "true"), ("u", "unsigned", "as_unsigned", "true")):
        value = f"max({field})::{_KINDS[column]}" if field != "u" else "max(u)::DECIMAL(20,0)::VARCHAR"
        columns = ", ".join(f"{value if c == column else f'NULL::{k}'} AS {c}" for c, k in _KINDS.items())
        parts.append(f"SELECT measurement || ',host=' || host AS series_key, '{field}' AS field, '{kind}' AS type, epoch_us(time) * 1000 AS time_ns, {columns} FROM readings WHERE measurement IS NOT NULL AND host IS NOT NULL AND time IS NOT NULL AND {field} IS NOT NULL AND {where} GROUP BY measurement, host, time")
    return " UNION ALL ".join(parts)


_LIVE = "flag = 1 AND series_key IS NOT NULL AND series_id NOT IN (SELECT series_id FROM series_segments WHERE flag = 2 AND series_key IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    points = _points_sql()
    return {
        "block_file_points": points,
        "block_file_scan": f"SELECT series_key, field, time_ns, as_float, as_integer FROM ({points}) WHERE series_key LIKE 'cpu,%' AND field IN ('usage', 'n') AND time_ns >= 1740787200000000000 AND time_ns < 1740873600000000000",
        "block_file_select": f"""WITH p AS (SELECT series_key, time_ns, max(as_integer) AS n, max(as_float) AS usage, max(as_boolean) AS ok FROM ({points}) WHERE series_key LIKE 'cpu,%' AND time_ns >= 1740787200000000000 AND time_ns < 1740873600000000000 GROUP BY ALL)
            SELECT time_ns - time_ns % 21600000000000 AS time, substr(series_key, 10) AS host, count(n) AS count, max(usage) AS most, arg_max(ok, time_ns) AS latest FROM p WHERE n > 100 GROUP BY ALL""",
        "block_file_index": f"SELECT series_key || '#!~#' || field AS key, type, min(time_ns) AS min_time, max(time_ns) AS max_time, count(*) AS points FROM ({points}) GROUP BY ALL",
        "block_file_counts": f"SELECT count(DISTINCT series_key || '#!~#' || field) AS keys, count(DISTINCT series_key) AS series, count(*) AS points FROM ({points})",
        "block_file_merge": """WITH p AS (SELECT measurement || ',host=' || host AS series_key, epoch_us(time) * 1000 AS time_ns, n FROM readings WHERE measurement IS NOT NULL AND host IS NOT NULL AND time IS NOT NULL AND n IS NOT NULL)
            SELECT series_key, time_ns, coalesce(max(CASE WHEN n % 5 = 0 THEN -n END), max(n)) AS as_integer FROM p GROUP BY ALL""",
        "packed_counts": "SELECT l_returnflag, sum((l_linenumber BETWEEN 2 AND 5)::INT)::BIGINT AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag",
        "segment_entries": f"SELECT partition_id, flag, series_id, CASE WHEN flag = 1 THEN {KEY_SQL} END AS key FROM series_segments WHERE series_key IS NOT NULL AND series_id IS NOT NULL",
        "segment_partitions": f"SELECT partition_id, max(series_id) AS max_series_id, count(*) FILTER (WHERE {_LIVE}) AS series FROM series_segments WHERE series_key IS NOT NULL GROUP BY partition_id",
        "segment_offsets": f"SELECT series_id, {KEY_SQL} AS key FROM series_segments WHERE {_LIVE}",
        "segment_deletes": f"SELECT series_id FROM series_segments WHERE {_LIVE} AND string_split({KEY_SQL}, ',')[1] <> 'cpu'",
        "create_series_ids": f"""WITH live AS (SELECT {KEY_SQL} AS key, min(series_id) AS series_id FROM series_segments WHERE flag = 1 AND series_id NOT IN (SELECT series_id FROM series_segments WHERE flag = 2) GROUP BY 1),
            wanted AS (SELECT DISTINCT {KEY_SQL} AS key FROM series_log WHERE series_key IS NOT NULL) SELECT key, l.series_id IS NULL AS is_new, l.series_id FROM wanted LEFT JOIN live l USING (key)""",
        "tombstone_ranges": """WITH r AS (SELECT event_type AS key, epoch_us(ts) * 1000 - 3600000000000 AS lo, epoch_us(ts) * 1000 + 3600000000000 AS hi FROM events WHERE value > 150 UNION ALL VALUES ('click', 0, 10), ('view', 0, 10)),
            m AS (SELECT *, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), i AS (SELECT *, sum((reach IS NULL OR reach < lo)::INT) OVER (PARTITION BY key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
            SELECT key, min(lo) AS min_time, max(hi) AS max_time FROM i GROUP BY key, island""",
        "series_sketch_bounds": "SELECT measurement, count(DISTINCT coalesce(host, '') || chr(1) || coalesce(region, '')) AS exact, true AS within FROM readings GROUP BY measurement",
        "key_pruning": "SELECT file_seq FROM file_stats WHERE key_range.min_key <= 'disk~' AND key_range.max_key >= 'disk'",
        "include_range": "SELECT event_id, ts FROM events WHERE ts BETWEEN '2024-01-22' AND '2024-01-25'",
        "seek_back": "SELECT event_id, ts FROM events WHERE ts <= '2024-01-20'",
        "statement_texts": r"""SELECT * FROM (VALUES ('script', 'SHOW DATABASES; DROP MEASUREMENT "my disk"'), ('condition', 'load >= 5 AND (host =~ /^w\/e/ OR ok = true)'), ('expression', '"a..b" + -1 * c * (2 - 1.5)'),
            ('quoting', 'SELECT load, "select", "a b", ''it\''s "so"'' FROM disk'), ('names', 'load peak'), ('rewritten', 'SELECT load FROM (SELECT load FROM disk LIMIT 3) LIMIT 3'), ('renamed', 'SELECT burden FROM disk WHERE burden > 1'),
            ('walked', 'VarRef Literal Call')) v(what, text)""",
        "where_in": "SELECT ts AS time, value FROM events WHERE event_type IN ('click', 'view')",
        "where_true": "SELECT ts AS time, value FROM events",
        "dotted_names": "SELECT o_orderdate AS time, o_totalprice AS total, o_orderkey AS k FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'",
        "delete_where": "SELECT 'events' AS name, ts AS time, event_id, NULL::BIGINT AS o_orderkey FROM events WHERE ts >= '2024-01-10' UNION ALL SELECT 'orders', o_orderdate, NULL, o_orderkey FROM orders WHERE o_orderdate >= '2024-01-10'",
        "show_everywhere": "SELECT * FROM (VALUES ('main', 'autogen', 'events'), ('main', 'autogen', 'lineitem'), ('main', 'autogen', 'orders'), ('main', 'autogen', 'readings'), ('other', 'week', 'clicks')) v(database, policy, name)",
        "show_keys": """SELECT '=' AS op, 'events' AS name, 'event_type' AS key, event_type AS value FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT '!=', 'events', 'event_type', event_type FROM (SELECT DISTINCT event_type FROM events ORDER BY event_type LIMIT 2 OFFSET 1)
            UNION ALL SELECT '=~', 'orders', 'o_orderstatus', o_orderstatus FROM (SELECT DISTINCT o_orderstatus FROM orders)""",
        "explain_analyze": "SELECT true AS final, true AS pushed, true AS pruned",
    }
