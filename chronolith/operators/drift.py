"""Schemas that drift between files (problem 3).

The catalogue of fields that files state is turned into lifespans: a field is
followed through the files of its measurement with ``lag``, runs of files are
islands, and each beginning, end, new name and new type is a logged change.  The
newest name and type of a lifespan are the alias and the cast for its points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ids of field types.
FLOAT, INTEGER, STRING, BOOLEAN, UNSIGNED = 1, 2, 3, 4, 9
STATED = (FLOAT, INTEGER, STRING, BOOLEAN, UNSIGNED)


def _lives(fields: DataFrame) -> DataFrame:
    """A row for each measurement, file and field, with its neighbours in the files' order."""
    own = fields.where("measurement is not null and file_seq is not null").select("measurement", F.col("file_seq").cast("long").alias("file_seq"), F.col("field_id").cast("int").alias("field_id"), "field_name", F.when(F.col("field_type").isin(*STATED), F.col("field_type").cast("int")).alias("type"))
    rows = own.where("field_id is not null").groupBy("measurement", "file_seq", "field_id").agg(F.max("field_name").alias("field_name"), F.max("type").alias("type"))
    order = Window.partitionBy("measurement").orderBy("file_seq")
    files = own.select("measurement", "file_seq").distinct().select("*", F.lag("file_seq").over(order).alias("file_before"), F.lead("file_seq").over(order).alias("file_after"))
    field = Window.partitionBy("measurement", "field_id").orderBy("file_seq")
    met = rows.join(files, ["measurement", "file_seq"]).select(
        "*", (~F.lag("file_seq").over(field).eqNullSafe(F.col("file_before")) | F.lag("file_seq").over(field).isNull()).alias("added"),
        (~F.lead("file_seq").over(field).eqNullSafe(F.col("file_after"))).alias("ends"), F.lag("field_name").over(field).alias("name_before"),
    ).withColumn("life", F.sum(F.col("added").cast("int")).over(field.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy("measurement", "field_id", "life").orderBy("file_seq")
    return met.withColumn("type_before", F.last("type", ignorenulls=True).over(life.rowsBetween(Window.unboundedPreceding, -1)))


def field_changes(fields: DataFrame) -> DataFrame:
    """(measurement, file_seq, field_id, change) of every 'added', 'removed', 'renamed' and 'retyped' field.

    ``fields``: (file_seq, measurement, field_id, field_name, field_type).  The
    files of a measurement are those with a row for it, by file_seq; each is
    compared with the one before, the first with none, so that it makes no case.
    A type of 0, null or an unknown id states
    nothing; a type is compared with the last one stated since the field was
    added.  Names are compared exactly, a null name as a name of its own.  Rows
    with a null measurement or file_seq are ignored; one with a null field_id
    only shows that the file has the measurement.  Of rows that repeat a field
    in a file with different contents, the largest name and type count.
    """
    lives = _lives(fields)
    found = F.array(
        F.when(F.col("added") & F.col("file_before").isNotNull(), F.struct("file_seq", F.lit("added").alias("change"))),
        F.when(F.col("ends") & F.col("file_after").isNotNull(), F.struct(F.col("file_after").alias("file_seq"), F.lit("removed").alias("change"))),
        F.when(~F.col("added") & ~F.col("field_name").eqNullSafe(F.col("name_before")), F.struct("file_seq", F.lit("renamed").alias("change"))),
        F.when(~F.col("added") & (F.col("type") != F.col("type_before")), F.struct("file_seq", F.lit("retyped").alias("change"))),
    )
    return lives.select("measurement", "field_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("measurement", "c.file_seq", "field_id", "c.change")


def field_lifespans(fields: DataFrame) -> DataFrame:
    """(measurement, field_id, life, first_file, last_file, files, names, types, name, type): each stay of a field.

    ``life`` numbers the stays of a field id; name and type are the newest ones
    stated in it, names and types all of them.
    """
    newest = F.struct("file_seq")
    return _lives(fields).groupBy("measurement", "field_id", "life").agg(
        F.min("file_seq").alias("first_file"), F.max("file_seq").alias("last_file"), F.count("*").alias("files"),
        F.array_sort(F.collect_set("field_name")).alias("names"), F.array_sort(F.collect_set("type")).alias("types"),
        F.max_by("field_name", newest).alias("name"), F.max_by("type", F.when(F.col("type").isNotNull(), newest)).alias("type"),
    )


def _before_the_cut(text: Column) -> Column:
    """A JSON object of the complete name and value pairs that a cut-off object begins with; null if it has none.

    A pair is complete if a comma follows it or its value ends by itself (a
    text, an object or a list).
    """
    pieces = F.split(text, ",")
    whole = F.concat(F.rtrim(text), F.lit("}"))
    parse = lambda c: F.from_json(c, "map<string,string>")
    upto = F.transform(F.sequence(F.size(pieces) - 1, F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(pieces, 1, n), ","), F.lit("}")))
    ended = F.when(F.rtrim(text).rlike(r'["}\]]$'), F.array(whole)).otherwise(F.array().cast("array<string>"))
    tries = F.concat(ended, F.when(F.size(pieces) > 1, upto).otherwise(F.array().cast("array<string>")))
    return F.get(F.filter(tries, lambda c: F.size(parse(c)) > 0), F.lit(0))


def consistent_points(points: DataFrame, fields: DataFrame, read_cut: bool = False) -> DataFrame:
    """(file_seq, measurement, time, host, field_id, field, type, as_float, as_integer, as_unsigned, as_boolean, as_string, state): all points in one table.

    ``points``: (file_seq, measurement, time, host, fields) with a JSON object.
    A row for each field of a point under the newest name of its lifespan and
    in the column of its newest type (string if none was stated).  state:
    'kept', 'cast' (another type was stated in the file), 'unfit' (the value
    doesn't fit; as_string holds it), 'null', 'unknown' (the file doesn't state
    the field; its own name, as_string) or 'no fields' (null, empty or cut-off
    JSON; one row, so that no point is lost).  With ``read_cut``, the complete
    pairs of a cut-off text are rows as any others, and its one row has the state
    'cut off' and the raw text in as_string.  Repeated rows are one point.
    """
    lives = _lives(fields).select("measurement", "file_seq", "field_id", "life", F.col("field_name").alias("name_here"), F.coalesce("type", "type_before").alias("type_here"))
    spans = field_lifespans(fields).select("measurement", "field_id", "life", "name", "type")
    stated = lives.join(spans, ["measurement", "field_id", "life"])
    # two fields of a file may have one name; the lower id has it
    stated = stated.groupBy("measurement", "file_seq", "name_here").agg(F.min_by(F.struct("field_id", "name", "type", "type_here"), "field_id").alias("f"))
    stated = stated.select(F.col("measurement").alias("m"), F.col("file_seq").alias("s"), F.col("name_here").alias("n"), "f.*")
    own = points.select(F.col("file_seq").cast("long").alias("file_seq"), "measurement", "time", "host", F.col("fields").cast("string").alias("fields")).distinct()
    parsed = own.withColumn("found", F.from_json("fields", "map<string,string>"))
    if read_cut:
        # an object that was begun and doesn't parse
        cut = F.col("found").isNull() & F.col("fields").rlike(r"^\s*\{")
        parsed = parsed.withColumn("cut", F.coalesce(cut, F.lit(False)))
        pairs = F.map_entries(F.from_json(F.when(F.col("cut"), _before_the_cut(F.col("fields"))), "map<string,string>"))
        raw = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("fields").alias("value")))
        entries = F.when(F.col("cut"), F.concat(raw, F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")))).otherwise(F.map_entries("found"))
        values = parsed.select("file_seq", "measurement", "time", "host", F.explode_outer(entries).alias("e")).select("file_seq", "measurement", "time", "host", F.col("e.key").alias("key"), F.col("e.value").alias("text"))
    else:
        values = parsed.select("file_seq", "measurement", "time", "host", F.explode_outer("found").alias("key", "text"))
    met = values.join(stated, (values.measurement == stated.m) & (values.file_seq == stated.s) & (values.key == stated.n), "left")
    kind = F.when(F.col("field_id").isNull(), F.lit(STRING)).otherwise(F.coalesce("type", F.lit(STRING)))
    t = F.col("text")
    number = t.try_cast("double")
    cast = {
        "as_float": F.when(kind == FLOAT, number),
        "as_integer": F.when(kind == INTEGER, F.coalesce(t.try_cast("long"), F.when(number == F.floor(number), number.try_cast("long")))),
        "as_unsigned": F.when((kind == UNSIGNED) & (number >= 0), F.coalesce(t.try_cast("decimal(20,0)"), number.try_cast("decimal(20,0)"))),
        "as_boolean": F.when(kind == BOOLEAN, F.when(F.lower(t).isin("true", "t", "1"), True).when(F.lower(t).isin("false", "f", "0"), False)),
    }
    fits = (kind == STRING) | F.coalesce(*[c.cast("string") for c in cast.values()]).isNotNull()
    state = F.when(F.col("key").isNull() & t.isNotNull(), "cut off").when(F.col("key").isNull(), "no fields").when(F.col("field_id").isNull(), "unknown").when(t.isNull(), "null").when(~fits, "unfit").when(F.col("type_here") != F.col("type"), "cast").otherwise("kept")
    return met.select(
        "file_seq", "measurement", "time", "host", "field_id", F.coalesce("name", "key").alias("field"), F.when(F.col("field_id").isNotNull(), F.coalesce("type", F.lit(STRING))).alias("type"),
        *[c.alias(k) for k, c in cast.items()], F.when((kind == STRING) | ~fits, t).alias("as_string"), state.alias("state"),
    )
