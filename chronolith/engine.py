"""The entry point: text in, DataFrames out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .lang import ast as A
from .lang.errors import ParseError
from .lang.parser import parse_statements
from .plans.bind import bind
from .plans.meta import MetaPlanner
from .plans.select import SelectPlanner


class Engine:
    """Runs statements over a catalogue.

    Planning is plain Python on the driver; a SELECT's DataFrame is lazy.
    ``now_ns`` fixes the current time, which is otherwise taken once a script.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, now_ns: int | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.now_ns = now_ns

    def run(self, statement: A.Node, params: dict[str, object] | None = None, now_ns: int | None = None) -> DataFrame:
        """The result of a parsed (perhaps rewritten) statement."""
        now = now_ns or self.now_ns or time.time_ns()
        bound = bind(statement, params)
        if isinstance(bound, A.Select):
            return SelectPlanner(self.catalog, now).plan(bound).df
        return MetaPlanner(self.catalog, now).plan(bound)

    def query(self, text: str, params: dict[str, object] | None = None) -> list[DataFrame]:
        """The result of each statement of a script."""
        now = self.now_ns or time.time_ns()
        return [self.run(s, params, now) for s in parse_statements(text)]

    def sql(self, text: str, params: dict[str, object] | None = None) -> DataFrame:
        """The result of the only statement of a text."""
        found = parse_statements(text)
        if len(found) != 1:
            raise ParseError("expected one statement", 0)
        return self.run(found[0], params)
