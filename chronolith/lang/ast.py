"""The syntax tree.  ``str`` of a node is its canonical text."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from decimal import Decimal

# The reserved words.
KEYWORDS = frozenset(
    """ALL ALTER ANALYZE AND ANY AS ASC BEGIN BY CARDINALITY CREATE CONTINUOUS DATABASE DATABASES DEFAULT DELETE DESC DESTINATIONS
    DIAGNOSTICS DISTINCT DROP DURATION END EVERY EXACT EXPLAIN FIELD FOR FROM GRANT GRANTS GROUP GROUPS IN INF INSERT INTO KEY KEYS KILL
    LIMIT MEASUREMENT MEASUREMENTS NAME OFFSET OR ON ORDER PASSWORD POLICY POLICIES PRIVILEGES QUERIES QUERY READ REPLICATION RESAMPLE
    RETENTION REVOKE SELECT SERIES SET SHOW SHARD SHARDS SLIMIT SOFFSET STATS SUBSCRIPTION SUBSCRIPTIONS TAG TO USER USERS VALUES WHERE
    WITH WRITE""".split()
)
# Nanoseconds of the units of a duration.
UNITS = {"w": 604_800_000_000_000, "d": 86_400_000_000_000, "h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
#: Types a reference can be cast to, in the order of their precedence.
CASTS = ("float", "integer", "unsigned", "string", "boolean", "field", "tag")


def is_field_type(cast: str) -> bool:
    return CASTS.index(cast) < CASTS.index("tag")


def is_numeric_type(cast: str) -> bool:
    return CASTS.index(cast) <= CASTS.index("unsigned")


def requires_quotes(name: str) -> bool:
    return not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or name.upper() in KEYWORDS


def _escaped(text: str, table: dict[str, str]) -> str:
    return "".join(table.get(c, c) for c in text)


def quoted(name: str) -> str:
    """An identifier's text, in quotes if it needs them."""
    return '"' + _escaped(name, {"\n": "\\n", "\\": "\\\\", '"': '\\"'}) + '"' if requires_quotes(name) else name


def duration_text(nanos: int) -> str:
    """The shortest text of a duration, largest unit first."""
    if nanos == 0:
        return "0s"
    out, rest = "-" if nanos < 0 else "", abs(nanos)
    for unit, size in UNITS.items():
        n, rest = divmod(rest, size)
        if n:
            out += f"{n}{unit}"
    return out


class Node:
    """Base of all nodes.  Children are visited in the order of the fields."""

    def children(self):
        for f in fields(self):
            v = getattr(self, f.name)
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, Node):
                    yield x


# -- expressions -------------------------------------------------------------


@dataclass
class VarRef(Node):
    name: str
    cast: str | None = None

    def __str__(self):
        # in an expression a bare true is a value
        name = f'"{self.name}"' if self.name.upper() in ("TRUE", "FALSE") else quoted(self.name)
        return name + (f"::{self.cast}" if self.cast else "")


@dataclass
class Param(Node):
    name: str

    def __str__(self):
        plain = re.fullmatch(r"[A-Za-z0-9_]+", self.name)
        return "$" + (self.name if plain else '"' + _escaped(self.name, {"\n": "\\n", "\\": "\\\\", '"': '\\"'}) + '"')


@dataclass
class Literal(Node):
    """kind: integer, unsigned, float, string, boolean, duration (nanoseconds) or regex."""

    kind: str
    value: object

    def __str__(self):
        v = self.value
        if self.kind == "string":
            return "'" + _escaped(v, {"\n": "\\n", "\\": "\\\\", "'": "\\'"}) + "'"
        if self.kind == "regex":
            return "/" + v.replace("/", "\\/") + "/"
        if self.kind == "boolean":
            return "true" if v else "false"
        if self.kind == "duration":
            return duration_text(v)
        if self.kind == "float":
            text = format(Decimal(repr(v)), "f")
            return text[:-2] if text.endswith(".0") else text
        return str(v)


@dataclass
class Distinct(Node):
    name: str

    def __str__(self):
        return f"DISTINCT {quoted(self.name)}"


@dataclass
class Wildcard(Node):
    cast: str | None = None

    def __str__(self):
        return "*" + (f"::{self.cast}" if self.cast else "")


@dataclass
class Call(Node):
    name: str
    args: list[Node]

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass
class Binary(Node):
    left: Node
    op: str
    right: Node

    def __str__(self):
        return f"{self.left} {self.op} {self.right}"


@dataclass
class Nested(Node):
    expr: Node

    def __str__(self):
        return f"({self.expr})"


# -- conditions ----------------------------------------------------------------


@dataclass
class Operand(Node):
    """An expression as a condition or a side of a comparison."""

    expr: Node

    def __str__(self):
        return str(self.expr)


@dataclass
class Condition(Node):
    """op: = != < <= > >= =~ !~ IN AND OR."""

    left: Node
    op: str
    right: Node

    def __str__(self):
        return f"{self.left} {self.op} {self.right}"


@dataclass
class Group(Node):
    condition: Node

    def __str__(self):
        return f"({self.condition})"


# -- clauses ---------------------------------------------------------------------


@dataclass
class Name(Node):
    """A measurement's name."""

    text: str

    def __str__(self):
        return quoted(self.text)


@dataclass
class Regex(Node):
    text: str

    def __str__(self):
        return str(Literal("regex", self.text))


@dataclass
class Source(Node):
    """A measurement or a regex of measurements, perhaps of a database and retention policy."""

    database: str | None
    policy: str | None
    name: Node

    def __str__(self):
        if self.database is not None:
            return f"{quoted(self.database)}.{quoted(self.policy) if self.policy is not None else ''}.{self.name}"
        return (f"{quoted(self.policy)}." if self.policy is not None else "") + str(self.name)


@dataclass
class Subquery(Node):
    select: Select

    def __str__(self):
        return f"({self.select})"


@dataclass
class Field(Node):
    expr: Node
    alias: str | None = None

    def __str__(self):
        return str(self.expr) + (f" AS {quoted(self.alias)}" if self.alias is not None else "")


@dataclass
class Tag(Node):
    """A tag to group by."""

    name: str

    def __str__(self):
        return quoted(self.name)


@dataclass
class AllTags(Node):
    def __str__(self):
        return "*"


@dataclass
class Time(Node):
    """Grouping by time; of the dimensions only this one has children."""

    interval: Node
    offset: Node | None = None

    def __str__(self):
        return f"TIME({self.interval}{f', {self.offset}' if self.offset is not None else ''})"


@dataclass
class Fill(Node):
    """kind: null, none, previous, linear or value."""

    kind: str
    value: int | float | None = None

    def __str__(self):
        if self.kind != "value":
            return f"FILL({self.kind.upper()})"
        return f"FILL({Literal('float' if isinstance(self.value, float) else 'integer', self.value)})"


@dataclass
class OrderBy(Node):
    descending: bool = False

    def __str__(self):
        return f"ORDER BY TIME {'DESC' if self.descending else 'ASC'}"


@dataclass
class Where(Node):
    condition: Node

    def __str__(self):
        return f"WHERE {self.condition}"


@dataclass
class Count(Node):
    """LIMIT, OFFSET, SLIMIT or SOFFSET."""

    word: str
    n: int

    def __str__(self):
        return f"{self.word} {self.n}"


@dataclass
class Zone(Node):
    name: str

    def __str__(self):
        return f"TZ('{self.name}')"


@dataclass
class Sources(Node):
    items: list[Node]

    def __str__(self):
        return "FROM " + ", ".join(map(str, self.items))


@dataclass
class Fields(Node):
    items: list[Field]

    def __str__(self):
        return ", ".join(map(str, self.items))


@dataclass
class GroupBy(Node):
    items: list[Node]

    def __str__(self):
        return "GROUP BY " + ", ".join(map(str, self.items))

    @property
    def time(self) -> Time | None:
        return next((d for d in self.items if isinstance(d, Time)), None)

    @property
    def tags(self) -> list[str]:
        return [d.name for d in self.items if isinstance(d, Tag)]


def _joined(*parts) -> str:
    return " ".join(str(p) for p in parts if p is not None and p != "")


# -- statements --------------------------------------------------------------------


@dataclass
class Select(Node):
    fields: Fields
    sources: Sources
    where: Where | None = None
    group_by: GroupBy | None = None
    fill_clause: Fill | None = None
    order_by: OrderBy | None = None
    limit: Count | None = None
    offset: Count | None = None
    slimit: Count | None = None
    soffset: Count | None = None
    zone: Zone | None = None

    def __str__(self):
        return _joined("SELECT", self.fields, self.sources, self.where, self.group_by, self.fill_clause, self.order_by, self.limit, self.offset, self.slimit, self.soffset, self.zone)

    @property
    def fill(self) -> Fill:
        """The fill in force: null if there is no clause."""
        return self.fill_clause or Fill("null")


@dataclass
class Explain(Node):
    """options: None, VERBOSE, ANALYZE or ANALYZE VERBOSE."""

    options: str | None
    select: Select

    def __str__(self):
        return _joined("EXPLAIN", self.options, self.select)


@dataclass
class CreateDatabase(Node):
    name: str
    duration: Literal | None = None
    replication: int | None = None
    shard_duration: Literal | None = None
    policy: str | None = None

    def __str__(self):
        parts = [("DURATION", self.duration), ("REPLICATION", self.replication), ("SHARD DURATION", self.shard_duration), ("NAME", None if self.policy is None else quoted(self.policy))]
        given = " ".join(f"{w} {v}" for w, v in parts if v is not None)
        return f"CREATE DATABASE {quoted(self.name)}" + (f" WITH {given}" if given else "")


@dataclass
class DropMeasurement(Node):
    name: str

    def __str__(self):
        return f"DROP MEASUREMENT {quoted(self.name)}"


@dataclass
class Delete(Node):
    sources: Sources | None
    where: Where | None = None

    def __str__(self):
        return _joined("DELETE", self.sources, self.where)


@dataclass
class On(Node):
    """database and policy; '*' stands for all of them."""

    database: str
    policy: str | None = None

    def __str__(self):
        text = [n if n == "*" else quoted(n) for n in (self.database, self.policy) if n is not None]
        return "ON " + ".".join(text)


@dataclass
class WithMeasurement(Node):
    op: str
    source: Source

    def __str__(self):
        return f"WITH MEASUREMENT {self.op} {self.source}"


@dataclass
class WithKey(Node):
    """op: = != =~ !~ IN; names or one regex."""

    op: str
    names: list[str]
    regex: Regex | None = None

    def __str__(self):
        if self.op == "IN":
            return f"WITH KEY IN ({', '.join(map(quoted, self.names))})"
        return f"WITH KEY {self.op} {self.regex if self.regex is not None else quoted(self.names[0])}"


@dataclass
class ShowDatabases(Node):
    def __str__(self):
        return "SHOW DATABASES"


@dataclass
class ShowMeasurements(Node):
    on: On | None = None
    with_measurement: WithMeasurement | None = None
    where: Where | None = None
    limit: Count | None = None
    offset: Count | None = None

    def __str__(self):
        return _joined("SHOW MEASUREMENTS", self.on, self.with_measurement, self.where, self.limit, self.offset)


@dataclass
class ShowRetentionPolicies(Node):
    on: On | None = None

    def __str__(self):
        return _joined("SHOW RETENTION POLICIES", self.on)


@dataclass
class ShowTagKeys(Node):
    on: On | None = None
    sources: Sources | None = None
    where: Where | None = None
    limit: Count | None = None
    offset: Count | None = None

    def __str__(self):
        return _joined("SHOW TAG KEYS", self.on, self.sources, self.where, self.limit, self.offset)


@dataclass
class ShowTagValues(Node):
    on: On | None
    sources: Sources | None
    with_key: WithKey
    where: Where | None = None
    limit: Count | None = None
    offset: Count | None = None

    def __str__(self):
        return _joined("SHOW TAG VALUES", self.on, self.sources, self.with_key, self.where, self.limit, self.offset)


@dataclass
class ShowFieldKeys(Node):
    on: On | None = None
    sources: Sources | None = None
    limit: Count | None = None
    offset: Count | None = None

    def __str__(self):
        return _joined("SHOW FIELD KEYS", self.on, self.sources, self.limit, self.offset)
