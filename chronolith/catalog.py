"""Databases, retention policies and measurements."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang.errors import AnalysisError

DEFAULT_POLICY = "autogen"


def field_type(kind: T.DataType) -> str | None:
    """The language's type of a column; None if it has none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(kind, T.DecimalType):
        return "unsigned" if kind.scale == 0 else "float"
    if isinstance(kind, T.StringType):
        return "string"
    return "boolean" if isinstance(kind, T.BooleanType) else None


# Spark's types of the language's types
SPARK_TYPES = {"float": "double", "integer": "bigint", "unsigned": "decimal(20,0)", "string": "string", "boolean": "boolean", "tag": "string"}


def q(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Measurement:
    """A measurement: a DataFrame of points with ``time`` (without zone), tags (strings) and typed fields.

    With ``nanos``, ``time`` is a long of UNIX nanoseconds.
    """

    name: str
    frame: DataFrame
    tags: list[str]
    fields: dict[str, str]
    database: str
    policy: str
    nanos: bool = False
    #: makes the frame from what a statement needs: its bounds of time (nanoseconds, included), the values that tags must have one of, the fields it names (None: all)
    scan: Callable[[int | None, int | None, dict[str, set[str]], set[str] | None], DataFrame] | None = None

    @property
    def schema(self) -> T.StructType:
        return self.frame.schema


@dataclass
class Policy:
    name: str
    duration_ns: int = 0
    replication: int = 1
    shard_duration_ns: int = 0
    is_default: bool = True


@dataclass
class Catalog:
    """What statements are resolved against; held on the driver."""

    spark: SparkSession
    database: str = "main"
    databases: dict[str, list[Policy]] = field(default_factory=dict)
    measurements: dict[tuple[str, str, str], Measurement | Callable[[], Measurement]] = field(default_factory=dict)

    def __post_init__(self):
        self.databases.setdefault(self.database, [Policy(DEFAULT_POLICY)])

    # -- databases --------------------------------------------------------------
    def create_database(self, name: str, policy: Policy | None = None) -> None:
        """Creates it, or adds the policy to one that exists."""
        policies = self.databases.setdefault(name, [])
        if policy is None:
            if not policies:
                policies.append(Policy(DEFAULT_POLICY))
            return
        for p in policies:
            p.is_default = False
        policies[:] = [p for p in policies if p.name != policy.name] + [policy]

    def default_policy(self, database: str) -> str:
        if database not in self.databases:
            raise AnalysisError(f"database not found: {database}")
        return next(p.name for p in self.databases[database] if p.is_default)

    # -- measurements ------------------------------------------------------------
    def add(self, name: str, frame: DataFrame, time: str, tags: list[str], fields: list[str] | None = None, database: str | None = None, policy: str | None = None, nanos: bool = False, finite: bool = False) -> Measurement:
        """Binds a DataFrame: columns are renamed and cast by their role, which is kept in their metadata.

        Without ``fields``, every other column with a type of the language is one.
        A NaN in a float field is no value and becomes null; ``finite`` says that
        there is none, so that conditions on fields reach the scan.
        """
        database = database or self.database
        self.create_database(database)
        policy = policy or self.default_policy(database)
        kinds = {f.name: f.dataType for f in frame.schema}
        if fields is None:
            fields = [c for c in frame.columns if c != time and c not in tags and field_type(kinds[c])]
        typed = {}
        t = q(time)
        out = [(t.cast("bigint") if nanos else t.cast("timestamp_ntz")).alias("time", metadata={"role": "time"})]
        out += [q(c).cast("string").alias(c, metadata={"role": "tag"}) for c in tags]
        for c in fields:
            typed[c] = field_type(kinds[c])
            if typed[c] is None:
                raise AnalysisError(f"field {c} has no type of the language")
            v = q(c).cast(SPARK_TYPES[typed[c]])
            if typed[c] == "float" and not finite:
                v = F.when(~F.isnan(v), v)
            out.append(v.alias(c, metadata={"role": "field"}))
        made = Measurement(name, frame.select(*out), list(tags), typed, database, policy, nanos)
        self.measurements[database, policy, name] = made
        return made

    def add_later(self, name: str, load: Callable[[], DataFrame], time: str, tags: list[str], database: str | None = None, policy: str | None = None, **more) -> None:
        """As ``add``, but the DataFrame is only made when a statement first needs the measurement."""
        database = database or self.database
        self.create_database(database)
        policy = policy or self.default_policy(database)
        self.measurements[database, policy, name] = lambda: self.add(name, load(), time, tags, database=database, policy=policy, **more)

    def replace_frame(self, m: Measurement, frame: DataFrame) -> None:
        self.measurements[m.database, m.policy, m.name] = replace(m, frame=frame, scan=None)

    def drop(self, name: str, database: str | None = None) -> None:
        for key in [k for k in self.measurements if k[0] == (database or self.database) and k[2] == name]:
            del self.measurements[key]

    def find(self, database: str | None, policy: str | None, name: str | None = None, regex: str | None = None) -> list[Measurement]:
        """Measurements by name or regex, sorted by name; of any policy if ``policy`` is '*', of any database if that is."""
        database = database or self.database
        if database != "*" and database not in self.databases:
            raise AnalysisError(f"database not found: {database}")
        out = []
        for (db, rp, n), m in list(self.measurements.items()):
            if database not in ("*", db) or (policy != "*" and rp != (policy or self.default_policy(db))):
                continue
            if (name is None and regex is None) or n == name or (regex is not None and re.search(regex, n)):
                out.append(m if isinstance(m, Measurement) else m())
        return sorted(out, key=lambda m: (m.name, m.database, m.policy))
