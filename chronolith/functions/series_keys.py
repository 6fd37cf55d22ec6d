"""Series keys: one spelling for all spellings of a key.

A key is a measurement name and tag=value pieces, separated by commas.  A
backslash before a comma, an equals sign or a blank makes it part of the name or
value and is dropped.  Pieces without a value are ignored, order and repetition
don't count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark, and what it stands for with a letter after it.
_MARK, _COMMA, _EQUALS = "\x01", "\x01c", "\x01e"


def _literal(c: Column) -> Column:
    """Marks escaped characters, so that the remaining commas and equals signs separate."""
    c = F.replace(c, F.lit(_MARK), F.lit(_MARK * 2))
    for what, mark in (("\\,", _COMMA), ("\\=", _EQUALS), ("\\ ", " ")):
        c = F.replace(c, F.lit(what), F.lit(mark))
    return c


def canonical_key(key: Column | str) -> Column:
    """A text that is the same for the same series, and for no other; null for null.

    It is meant for comparing and hashing; ``key_measurement`` and ``key_tags``
    give readable parts.  A piece without an equals sign has no value.
    """
    c = F.col(key) if isinstance(key, str) else key
    parts = F.split(F.when(F.instr(c, "\\") + F.instr(c, _MARK) > 0, _literal(c)).otherwise(c), ",")

    def value_marked(p: Column) -> Column:
        tag = F.substring_index(p, "=", 1)
        value = F.substr(p, F.length(tag) + 2)
        return F.when(F.instr(value, "=") > 0, F.concat(tag, F.lit("="), F.replace(value, F.lit("="), F.lit(_EQUALS)))).otherwise(p)

    tags = F.filter(parts, lambda p, i: (i > 0) & (F.instr(p, "=") > 0) & (F.instr(p, "=") < F.length(p)))
    tags = F.array_sort(F.array_distinct(F.transform(tags, value_marked)))
    return F.when(c.isNotNull(), F.concat_ws(",", F.array(F.replace(parts[0], F.lit("="), F.lit(_EQUALS))), tags))


def key_of_parts(measurement: Column, tags: Column) -> Column:
    """The canonical text of a measurement and an array of (tag, value), as ``canonical_key`` gives it."""

    def marked(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit(_MARK), F.lit(_MARK * 2)), F.lit(","), F.lit(_COMMA)), F.lit("="), F.lit(_EQUALS))

    each = F.transform(tags, lambda t: F.concat(marked(t["tag"]), F.lit("="), marked(t["value"])))
    return F.when(measurement.isNotNull(), F.concat_ws(",", F.array(marked(measurement)), F.array_sort(F.array_distinct(each))))


def _plain(c: Column) -> Column:
    """What the marks stand for; a doubled mark is a mark."""
    parts = F.transform(F.split(c, _MARK * 2), lambda p: F.replace(F.replace(p, F.lit(_COMMA), F.lit(",")), F.lit(_EQUALS), F.lit("=")))
    return F.array_join(parts, _MARK)


def key_measurement(key: Column | str) -> Column:
    """The measurement name of a key."""
    return _plain(F.substring_index(canonical_key(key), ",", 1))


def key_tags(key: Column | str) -> Column:
    """The tags of a key: an array of (tag, value), sorted."""
    c = canonical_key(key)
    parts = F.filter(F.split(c, ","), lambda p: F.instr(p, "=") > 0)
    return F.when(
        c.isNotNull(),
        F.transform(parts, lambda p: F.struct(_plain(F.substring_index(p, "=", 1)).alias("tag"), _plain(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).alias("value"))),
    )
