"""SELECT as DataFrames.

Two stages.  The first gives each group (time bucket and tags) its aggregates
and fills empty buckets; the second computes what remains of the fields from
these columns, series by series in time order.  Without aggregates the first
stage is the filtered points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import SPARK_TYPES, Catalog, Measurement, q
from ..functions.registry import REGISTRY, lookup
from ..lang import ast as A
from ..lang.errors import AnalysisError
from ..lang.visit import walk
from .bind import constant_ns, fold_numbers, reduce

NUMERIC = ("float", "integer", "unsigned")
#: Time of a series that a task works on at once: an hour.
STRETCH_NS = 3_600 * 10**9
#: Empty buckets that one row stands for before they are spelled out.
FILL_STRETCH = 10_000
#: Points of a series that a task works on at once where a function needs a number of points before each.
BLOCK_POINTS = 1 << 16
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}


@dataclass
class Frame:
    """Points (or a result) with the roles of their columns; ``time`` is None if there is no time column."""

    df: DataFrame
    tags: list[str]
    fields: dict[str, str | None]
    time: bool = True
    nanos: bool = False
    named: bool = False
    #: what a series of it is told apart by
    series: list[str] = field(default_factory=list)


@dataclass
class Bounds:
    """Inclusive nanosecond bounds of the time that a condition leaves."""

    low: int | None = None
    high: int | None = None


class Typed:
    """A column and its type in the language; ``tag`` for tags, ``time`` for times."""

    def __init__(self, column: Column, kind: str | None, constant=None):
        self.column, self.kind, self.constant = column, kind, constant


def _null(kind: str | None) -> Column:
    return F.lit(None).cast(SPARK_TYPES.get(kind or "", "double"))


class Expressions:
    """Columns of expressions over a frame."""

    def __init__(self, frame: Frame, now_ns: int, zone: str | None):
        self.frame, self.now_ns, self.zone = frame, now_ns, zone

    def reference(self, node: A.VarRef) -> Typed:
        f, name, cast = self.frame, node.name, node.cast
        if name == "time" and f.time and cast is None:
            return Typed(F.col("time"), "time")
        if name in f.tags and cast not in ("field",) and (name not in f.fields or cast in (None, "tag")):
            return Typed(q(name), "tag") if cast in (None, "tag", "string") else Typed(_null(cast), cast)
        if name not in f.fields or cast == "tag":
            # an unknown name is a field without values
            return Typed(_null(cast), cast if cast in SPARK_TYPES else None)
        kind, c = f.fields[name], q(name)
        if cast in (None, "field", kind):
            return Typed(c, kind)
        if cast in NUMERIC and kind in NUMERIC:
            if cast == "unsigned":
                c = F.when(c >= 0, c)
            return Typed(c.try_cast(SPARK_TYPES[cast]), cast)
        return Typed(_null(cast), cast)

    def literal(self, node: A.Literal) -> Typed:
        v = node.value
        if node.kind == "regex":
            return Typed(F.lit(v), "string", v)
        if node.kind == "unsigned":
            return Typed(F.lit(str(v)).cast("decimal(20,0)"), "unsigned", v)
        if node.kind in ("integer", "duration"):
            return Typed(F.lit(v).cast("bigint"), "integer", v)
        return Typed(F.lit(v), node.kind, v)

    def value(self, node: A.Node) -> Typed:
        if isinstance(node, (A.Nested, A.Operand)):
            return self.value(node.expr)
        if isinstance(node, A.Literal):
            return self.literal(node)
        if isinstance(node, A.VarRef):
            return self.reference(node)
        if isinstance(node, A.Call):
            if node.name == "now" and not node.args:
                return Typed(F.lit(self.now_ns).cast("bigint"), "integer", self.now_ns)
            f = lookup(node.name, len(node.args))
            if f.kind != "math":
                raise AnalysisError(f"{node.name}() can't be used here")
            args = [self.value(a) for a in node.args]
            if any(a.kind not in (*NUMERIC, None) for a in args):
                return Typed(_null("float"), "float")
            return Typed(f.build([a.column for a in args]), f.result(args[0].kind))
        if isinstance(node, A.Binary):
            return self.arithmetic(node.op, self.value(node.left), self.value(node.right))
        raise AnalysisError(f"{node} can't be used here")

    def arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        if a.constant is not None and b.constant is not None and not isinstance(a.constant, str) and not isinstance(b.constant, str):
            v = fold_numbers(op, a.constant, b.constant)
            kind = "float" if isinstance(v, float) else "integer"
            return Typed(F.lit(v).cast(SPARK_TYPES[kind]), kind, v)
        if op in "&|^":
            if {a.kind, b.kind} - {"integer", None}:
                raise AnalysisError(f"bits of {a.kind} and {b.kind} values are not defined")
            x, y = a.column.cast("bigint"), b.column.cast("bigint")
            return Typed(x.bitwiseAND(y) if op == "&" else x.bitwiseOR(y) if op == "|" else x.bitwiseXOR(y), "integer")
        if a.kind not in (*NUMERIC, None) or b.kind not in (*NUMERIC, None):
            raise AnalysisError(f"{a.kind} {op} {b.kind} is not defined")
        if op == "/":
            x, y = a.column.cast("double"), b.column.cast("double")
            return Typed(F.when((y == 0) & x.isNotNull(), F.lit(0.0)).otherwise(F.try_divide(x, y)), "float")
        kind = "float" if "float" in (a.kind, b.kind) else "unsigned" if a.kind == b.kind == "unsigned" else "integer"
        x, y = a.column.cast(SPARK_TYPES[kind]), b.column.cast(SPARK_TYPES[kind])
        if op == "%":
            return Typed(F.try_mod(x, y), kind)
        return Typed(x + y if op == "+" else x - y if op == "-" else x * y, kind)

    # -- conditions ----------------------------------------------------------------
    def condition(self, node: A.Node) -> Column:
        """A condition; null means false, as in a filter (the language has no NOT).

        Plain comparisons are left bare, so that they reach the scan.
        """
        if isinstance(node, A.Group):
            return self.condition(node.condition)
        if isinstance(node, A.Operand):
            v = self.value(node)
            return v.column if v.kind == "boolean" else F.lit(False)
        if node.op in ("AND", "OR"):
            a, b = self.condition(node.left), self.condition(node.right)
            return a & b if node.op == "AND" else a | b
        return self.comparison(node)

    def comparison(self, node: A.Condition) -> Column:
        if self._is_time(node.left) or self._is_time(node.right):
            return self.time_comparison(node)
        left = self.value(node.left)
        x = F.coalesce(left.column, F.lit("")) if left.kind == "tag" else left.column
        if node.op in ("=~", "!~"):
            if left.kind not in ("tag", "string"):
                return F.lit(False)
            pattern = node.right.expr.value
            return x.rlike(pattern) if node.op == "=~" else ~x.rlike(pattern)
        if node.op == "IN":
            return x.isin([v.value for v in node.right])
        right = self.value(node.right)
        y = F.coalesce(right.column, F.lit("")) if right.kind == "tag" else right.column
        texts = ("tag", "string")
        fits = (left.kind in texts and right.kind in texts) or (left.kind in NUMERIC and right.kind in NUMERIC) or left.kind == right.kind == "boolean"
        if not fits:
            return F.lit(False)
        if left.kind == "tag" and isinstance(right.constant, str) and node.op in ("=", "!="):
            # a null tag is ''
            bare = left.column == right.column if node.op == "=" else left.column != right.column
            return bare | left.column.isNull() if (right.constant == "") == (node.op == "=") else bare
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[node.op]

    @staticmethod
    def _is_time(node: A.Node) -> bool:
        while isinstance(node, (A.Operand, A.Nested)):
            node = node.expr
        return isinstance(node, A.VarRef) and node.name == "time" and node.cast is None

    def time_bound(self, node: A.Condition) -> tuple[str, int]:
        """(operator, nanoseconds) with time on the left."""
        op, other = (node.op, node.right) if self._is_time(node.left) else (_FLIP.get(node.op, node.op), node.left)
        at = constant_ns(other, self.now_ns, self.zone)
        if at is None or op not in _FLIP:
            raise AnalysisError(f"invalid comparison with time: {node}")
        return op, at

    def time_comparison(self, node: A.Condition) -> Column:
        op, at = self.time_bound(node)
        t = F.col("time")
        if not self.frame.time:
            return F.lit(False)
        if self.frame.nanos:
            y = F.lit(at).cast("bigint")
        else:
            # a time between two microseconds: the comparison that means the same
            whole, rest = divmod(at, 1000)
            if rest and op in ("=", "!="):
                return F.lit(op == "!=")
            if rest and op in ("<", ">="):
                whole += 1
            y = micros_literal(whole)
        return {"=": t == y, "!=": t != y, "<": t < y, "<=": t <= y, ">": t > y, ">=": t >= y}[op]

    def bounds(self, node: A.Node | None) -> Bounds:
        """What a condition says of time, as far as all of it must hold."""
        if node is None:
            return Bounds()
        if isinstance(node, A.Group):
            return self.bounds(node.condition)
        if isinstance(node, A.Condition):
            if node.op == "AND":
                a, b = self.bounds(node.left), self.bounds(node.right)
                lows, highs = [x for x in (a.low, b.low) if x is not None], [x for x in (a.high, b.high) if x is not None]
                return Bounds(max(lows, default=None), min(highs, default=None))
            if node.op in _FLIP and (self._is_time(node.left) or self._is_time(node.right)):
                op, at = self.time_bound(node)
                return {"=": Bounds(at, at), ">": Bounds(at + 1), ">=": Bounds(at), "<": Bounds(None, at - 1), "<=": Bounds(None, at), "!=": Bounds()}[op]
        return Bounds()


    def tag_values(self, node: A.Node | None) -> dict[str, set[str]]:
        """The values of which a condition demands one of a tag, as far as all of it must hold."""
        if isinstance(node, A.Group):
            return self.tag_values(node.condition)
        if not isinstance(node, A.Condition):
            return {}
        if node.op == "AND":
            a, b = self.tag_values(node.left), self.tag_values(node.right)
            return {t: a[t] & b[t] if t in a and t in b else a.get(t, b.get(t)) for t in {*a, *b}}
        if node.op == "=" and not self._is_time(node.left) and not self._is_time(node.right):
            sides = [n.expr if isinstance(n, A.Operand) else n for n in (node.left, node.right)]
            for x, y in (sides, sides[::-1]):
                if isinstance(x, A.VarRef) and self.reference(x).kind == "tag" and isinstance(y, A.Literal) and y.kind == "string":
                    return {x.name: {y.value}}
        return {}


def micros_literal(us: int) -> Column:
    """A timestamp without zone as a literal, so that it reaches the scan."""
    from datetime import datetime, timedelta

    try:
        at = datetime(1970, 1, 1) + timedelta(microseconds=us)
    except OverflowError as e:
        raise AnalysisError("time out of range") from e
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def ticks_of(c: Column, nanos: bool) -> Column:
    """Time as a long: nanoseconds, or microseconds since 1970."""
    return c if nanos else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def time_of(ticks: Column, nanos: bool) -> Column:
    return ticks if nanos else F.timestamp_add("MICROSECOND", ticks, F.lit("1970-01-01").cast("timestamp_ntz"))


class Buckets:
    """The time buckets of a TIME dimension."""

    def __init__(self, time: A.Time, now_ns: int, zone: str | None, nanos: bool):
        per = 1 if nanos else 1000
        size = constant_ns(reduce(time.interval), now_ns, zone)
        if not size or size <= 0 or size % per:
            raise AnalysisError("the interval of TIME must be a positive number of " + ("nanoseconds" if nanos else "microseconds"))
        shift = constant_ns(reduce(time.offset), now_ns, zone) if time.offset is not None else 0
        self.size, self.nanos, self.zone = size // per, nanos, zone
        self.shift = (shift % size) // per
        hour = 3_600_000_000_000 // per
        #: buckets that don't fit into an hour follow the clock of the zone
        self.local = zone is not None and (self.size > hour or hour % self.size != 0)
        if zone is not None and nanos:
            raise AnalysisError("TZ needs times in microseconds")

    def _floor(self, t: Column) -> Column:
        return t - F.pmod(t - self.shift, F.lit(self.size))

    def _zoned(self, time: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(self.zone), time)

    def start(self, time: Column) -> Column:
        """The start of the bucket of a time, in UTC."""
        t = ticks_of(time, self.nanos)
        if self.zone is None:
            return time_of(self._floor(t), self.nanos)
        here = ticks_of(self._zoned(time), False)
        if self.local:
            return F.convert_timezone(F.lit(self.zone), F.lit("UTC"), time_of(self._floor(here), False))
        # the same offset back, so that a repeated hour stays two
        return time_of(self._floor(here) - (here - t), False)

    def place(self, start: Column) -> Column:
        """The start of a bucket as a long; neighbouring buckets are ``size`` apart."""
        # a day whose midnight the clock skips starts later, but keeps its place
        return self._floor(ticks_of(self._zoned(start), False)) if self.local else ticks_of(start, self.nanos)

    def at(self, place: Column) -> Column:
        """The start of the bucket at a place."""
        return F.convert_timezone(F.lit(self.zone), F.lit("UTC"), time_of(place, False)) if self.local else time_of(place, self.nanos)

    def literal(self, ns: int) -> Column:
        return self.start(F.lit(ns).cast("bigint") if self.nanos else micros_literal(ns // 1000))


def _calls(node: A.Node, kinds: tuple[str, ...]) -> list[A.Call]:
    return [n for n in walk(node) if isinstance(n, A.Call) and n.name in REGISTRY and REGISTRY[n.name].kind in kinds]


def _default_name(e: A.Node) -> str:
    if isinstance(e, A.VarRef):
        return e.name
    if isinstance(e, A.Nested):
        return _default_name(e.expr)
    if isinstance(e, A.Call):
        return e.name
    if isinstance(e, A.Distinct):
        return "distinct"
    if isinstance(e, A.Binary):
        parts = [_default_name(x) for x in (e.left, e.right) if not isinstance(x, A.Literal)]
        return "_".join(parts) or "value"
    return "value"


class SelectPlanner:
    def __init__(self, catalog: Catalog, now_ns: int):
        self.catalog, self.now_ns = catalog, now_ns

    # -- sources --------------------------------------------------------------------
    def needs(self, s: A.Select, m: Measurement) -> DataFrame:
        """The points of a measurement that a statement needs; only sources that choose what they read make use of it."""
        if m.scan is None:
            return m.frame
        own = Expressions(Frame(m.frame, m.tags, dict(m.fields), True, m.nanos), self.now_ns, s.zone.name if s.zone else None)
        condition = s.where.condition if s.where else None
        bounds = own.bounds(condition)
        nodes = [n for part in (s.fields, s.where) if part for n in walk(part)]
        named = {n.name for n in nodes if isinstance(n, (A.VarRef, A.Distinct))}
        whole = any(isinstance(n, A.Wildcard) or (isinstance(n, A.Literal) and n.kind == "regex") for n in nodes)
        return m.scan(bounds.low, bounds.high, own.tag_values(condition), None if whole else named)

    def sources(self, node: A.Sources, statement: A.Select) -> Frame:
        frames, several = [], len(node.items) > 1
        for s in node.items:
            if isinstance(s, A.Subquery):
                sub = self.plan(s.select)
                if not sub.time:
                    sub = Frame(sub.df.withColumn("time", F.lit("1970-01-01").cast("timestamp_ntz")), sub.tags, sub.fields, True, False, sub.named)
                name = next((x.name.text for x in s.select.sources.items if isinstance(x, A.Source) and isinstance(x.name, A.Name)), "")
                frames.append((name, sub))
                continue
            regex = s.name.text if isinstance(s.name, A.Regex) else None
            several = several or regex is not None
            found = self.catalog.find(s.database, s.policy, None if regex is not None else s.name.text, regex)
            if not found and regex is None:
                raise AnalysisError(f"measurement not found: {s}")
            frames += [(m.name, Frame(self.needs(statement, m), m.tags, dict(m.fields), True, m.nanos)) for m in found]
        if not frames:
            raise AnalysisError(f"no measurement matches {node}")
        if not several:
            name, f = frames[0]
            return f
        if len({f.nanos for _, f in frames}) > 1:
            raise AnalysisError("sources in nanoseconds and microseconds can't be combined")
        tags = sorted({t for _, f in frames for t in f.tags})
        fields: dict[str, str | None] = {}
        for _, f in frames:
            for c, k in f.fields.items():
                old = fields.setdefault(c, k)
                if old != k:
                    # numbers meet as floats, anything else as text
                    fields[c] = "float" if old in NUMERIC and k in NUMERIC else "string"
        parts = []
        for name, f in frames:
            own = F.col("name") if f.named else F.lit(name)
            columns = [own.alias("name"), F.col("time")]
            columns += [(q(t) if t in f.tags else F.lit(None).cast("string")).alias(t) for t in tags]
            columns += [(q(c).cast(SPARK_TYPES[k]) if c in f.fields else _null(k)).alias(c) for c, k in fields.items() if c not in tags]
            parts.append(f.df.select(*columns))
        df = fold(lambda a, b: a.unionByName(b), parts)
        return Frame(df, tags, {c: k for c, k in fields.items() if c not in tags}, True, frames[0][1].nanos, True)

    # -- fields ------------------------------------------------------------------------
    def expand(self, items: list[A.Field], frame: Frame, grouped: set[str], aggregated: bool) -> list[tuple[str, A.Node]]:
        """(name, expression) of each output column: wildcards and regexes are spelled out."""
        out: list[tuple[str, A.Node]] = []
        for item in items:
            e = item.expr
            while isinstance(e, A.Nested):
                e = e.expr
            if isinstance(e, A.Wildcard) or (isinstance(e, A.Literal) and e.kind == "regex"):
                fields, tags = sorted(frame.fields), sorted(t for t in frame.tags if t not in grouped)
                if isinstance(e, A.Wildcard):
                    names = (fields if e.cast != "tag" else []) + (tags if e.cast != "field" else [])
                else:
                    names = [n for n in fields + tags if re.search(e.value, n)]
                out += [(n, A.VarRef(n)) for n in names]
                continue
            if isinstance(e, A.Call) and e.args and (isinstance(e.args[0], A.Wildcard) or (isinstance(e.args[0], A.Literal) and e.args[0].kind == "regex")):
                f = lookup(e.name, len(e.args))
                first = e.args[0]
                names = [n for n in sorted(frame.fields) if (isinstance(first, A.Wildcard) or re.search(first.value, n)) and (not f.numeric or frame.fields[n] in NUMERIC)]
                if isinstance(first, A.Wildcard) and first.cast == "tag":
                    raise AnalysisError(f"{e.name}() takes fields")
                prefix = item.alias if item.alias is not None else e.name
                out += [(f"{prefix}_{n}", A.Call(e.name, [A.VarRef(n), *e.args[1:]])) for n in names]
                continue
            name = item.alias if item.alias is not None else _default_name(e)
            if not aggregated and isinstance(e, A.VarRef) and e.name == "time" and frame.time:
                continue  # there is a time column anyway
            if isinstance(e, A.Call) and e.name in ("top", "bottom") and len(e.args) > 2:
                out.append((name, A.Call(e.name, [e.args[0], e.args[-1]])))
                out += [(_default_name(a), a) for a in e.args[1:-1]]
                continue
            out.append((name, e))
        taken: dict[str, int] = {"time": 0}
        unique = []
        for name, e in out:
            n, base = taken.get(name, -1) + 1, name
            while n and f"{base}_{n}" in taken:
                n += 1
            taken[base] = n
            if n:
                name = f"{base}_{n}"
                taken[name] = 0
            unique.append((name, e))
        return unique

    # -- the statement -------------------------------------------------------------------
    def plan(self, s: A.Select) -> Frame:
        zone = s.zone.name if s.zone else None
        src = self.sources(s.sources, s)
        ex = Expressions(src, self.now_ns, zone)
        df = src.df
        bounds = Bounds()
        if s.where:
            df = df.where(ex.condition(s.where.condition))
            bounds = ex.bounds(s.where.condition)
        group_tags: list[str] = []
        time_dim = s.group_by.time if s.group_by else None
        for d in s.group_by.items if s.group_by else []:
            if isinstance(d, A.Tag):
                names = [d.name]
            elif isinstance(d, A.AllTags):
                names = sorted(src.tags)
            elif isinstance(d, A.Regex):
                names = [t for t in sorted(src.tags) if re.search(d.text, t)]
            else:
                names = []
            group_tags += [n for n in names if n not in group_tags]
        for t in group_tags:
            if t not in src.tags:
                df = df.withColumn(t, F.lit(None).cast("string"))
        heads = [(c.alias if c.alias is not None else None, c.expr) for c in s.fields.items]
        aggregated = any(_calls(e, ("agg", "selector", "rows")) for _, e in heads) or any(isinstance(n, A.Distinct) or (isinstance(n, A.Call) and n.name == "distinct") for _, e in heads for n in walk(e))
        fields = self.expand(s.fields.items, src, set(group_tags), aggregated)
        if not fields:
            raise AnalysisError("no field is selected")
        if time_dim is not None and not aggregated:
            raise AnalysisError("GROUP BY TIME needs an aggregate function")
        series = (["name"] if src.named else []) + group_tags
        keys = [q(k) for k in series]
        buckets = Buckets(time_dim, self.now_ns, zone, src.nanos) if time_dim else None
        frame = Frame(df, src.tags + [t for t in group_tags if t not in src.tags], src.fields, src.time, src.nanos, src.named)

        distinct = self._only_distinct(fields)
        if distinct:
            out = self._distinct(frame, fields[0][0], distinct, keys, buckets)
        elif any(_calls(e, ("rows",)) for _, e in fields) or (aggregated and self._picks_point(fields)):
            out = self._points(frame, fields, keys, series, buckets, zone)
        elif aggregated:
            out = self._aggregates(frame, fields, keys, series, buckets, s.fill, bounds, zone)
        else:
            out = self._raw(frame, fields, keys, series, zone)
        out.tags, out.series = group_tags, series
        head = [c for c in ("name", "time") if (c == "name" and out.named) or (c == "time" and out.time)]
        out.df = out.df.select(*[q(c) for c in head + [c for c in out.df.columns if c not in head]])
        return self._limits(out, s)

    @staticmethod
    def _only_distinct(fields: list[tuple[str, A.Node]]) -> A.Node | None:
        def inner(e):
            if isinstance(e, A.Distinct):
                return A.VarRef(e.name)
            if isinstance(e, A.Call) and e.name == "distinct" and len(e.args) == 1:
                return e.args[0]
            return None

        found = [inner(e) for _, e in fields]
        if not any(found):
            return None
        if len(fields) > 1:
            raise AnalysisError("DISTINCT can't be combined with other fields")
        return found[0]

    def _distinct(self, f: Frame, name: str, arg: A.Node, keys: list[Column], buckets: Buckets | None) -> Frame:
        v = Expressions(f, self.now_ns, None).value(arg)
        time = [buckets.start(F.col("time")).alias("time")] if buckets else []
        df = f.df.select(*time, *keys, v.column.alias(name)).where(q(name).isNotNull()).distinct()
        return Frame(df, [], {name: v.kind}, bool(buckets), f.nanos, f.named)

    @staticmethod
    def _picks_point(fields: list[tuple[str, A.Node]]) -> bool:
        """One selector beside plain fields."""
        calls = [c for _, e in fields for c in _calls(e, ("agg", "selector"))]
        raw = [e for _, e in fields if not _calls(e, ("agg", "selector", "transform"))]
        if not raw or all(isinstance(e, A.Literal) for e in raw):
            return False
        if len(calls) != 1 or REGISTRY[calls[0].name].kind != "selector":
            raise AnalysisError("mixing aggregate and non-aggregate fields is not supported")
        return True

    def _points(self, f: Frame, fields: list[tuple[str, A.Node]], keys: list[Column], series: list[str], buckets: Buckets | None, zone: str | None) -> Frame:
        """Rows that a selector, top, bottom or sample picks from each group, with other fields of the same points."""
        calls = [c for _, e in fields for c in _calls(e, ("rows", "selector"))]
        if len(calls) != 1 or any(_calls(e, ("agg", "transform")) for _, e in fields):
            raise AnalysisError(f"{calls[0].name}() can't be combined with other functions")
        call = calls[0]
        ex = Expressions(f, self.now_ns, zone)
        v = ex.value(call.args[0])
        args = [self._constant(a) for a in call.args[1:]]
        df = f.df.withColumn("__v", v.column).where(F.col("__v").isNotNull())
        group = [F.col("__bucket"), *keys] if buckets else keys
        if buckets:
            df = df.withColumn("__bucket", buckets.start(F.col("time")))
        value, t = F.col("__v"), F.col("time")
        if REGISTRY[call.name].kind == "rows":
            n, order = REGISTRY[call.name].build(value, t, args)
            if n < 1:
                raise AnalysisError(f"{call.name}() needs a positive number")
        elif call.name == "percentile":
            picked = df.groupBy(*group).agg(REGISTRY["percentile"].build(value, t, args, "__v").alias("__p"))
            names = [*(["__bucket"] if buckets else []), *series]
            picked = picked.select(*[q(c).alias(f"__k{i}") for i, c in enumerate(names)], "__p")
            on = F.col("__v") == F.col("__p")
            for i, c in enumerate(names):
                on = on & q(c).eqNullSafe(F.col(f"__k{i}"))
            df = df.join(picked, on, "left_semi")
            n, order = 1, [t.asc()]
        else:
            n, order = 1, {"first": [t.asc(), value.asc()], "last": [t.desc(), value.desc()], "min": [value.asc(), t.asc()], "max": [value.desc(), t.asc()]}[call.name]
        rest = [q(c).asc() for c in sorted({*f.tags, *f.fields})]
        if group:
            picked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order, *rest))).where(F.col("__n") <= n)
        else:
            picked = df.orderBy(*order, *rest).limit(n)
        own = Expressions(Frame(picked, f.tags, {**f.fields, "__v": v.kind}, True, f.nanos, f.named), self.now_ns, zone)
        out, kinds = [], {}
        for name, e in fields:
            got = own.value(self._swap(e, {id(call): A.VarRef("__v")}))
            out.append(got.column.alias(name))
            kinds[name] = "string" if got.kind == "tag" else got.kind
        time = F.col("__bucket") if buckets and REGISTRY[call.name].kind == "selector" else F.col("time")
        return Frame(picked.select(time.alias("time"), *keys, *out), [], kinds, True, f.nanos, f.named)

    @staticmethod
    def _constant(node: A.Node):
        node = reduce(node)
        if not isinstance(node, A.Literal):
            raise AnalysisError(f"{node} must be constant")
        return node.value

    @staticmethod
    def _swap(e: A.Node, by_id: dict[int, A.Node]) -> A.Node:
        """A copy with some nodes (by identity) replaced."""
        if id(e) in by_id:
            return by_id[id(e)]
        if isinstance(e, A.Nested):
            return A.Nested(SelectPlanner._swap(e.expr, by_id))
        if isinstance(e, A.Binary):
            return A.Binary(SelectPlanner._swap(e.left, by_id), e.op, SelectPlanner._swap(e.right, by_id))
        if isinstance(e, A.Call):
            return A.Call(e.name, [SelectPlanner._swap(a, by_id) for a in e.args])
        return e

    def _aggregates(self, f: Frame, fields, keys, series, buckets: Buckets | None, fill: A.Fill, bounds: Bounds, zone) -> Frame:
        ex = Expressions(f, self.now_ns, zone)
        inputs: dict[str, tuple[str, str | None]] = {}
        aggs: dict[str, tuple[str, Column, str | None]] = {}
        before: list[Column] = []

        def of(arg: A.Node) -> tuple[str, str | None]:
            text = str(arg)
            if text not in inputs:
                v = ex.value(arg)
                inputs[text] = (f"__i{len(inputs)}", v.kind)
                before.append(v.column.alias(inputs[text][0]))
            return inputs[text]

        def aggregate(call: A.Call) -> str:
            text = str(call)
            if text not in aggs:
                name, fn = f"__a{len(aggs)}", lookup(call.name, len(call.args))
                arg = call.args[0]
                if isinstance(arg, A.Distinct) or (isinstance(arg, A.Call) and arg.name == "distinct"):
                    if call.name != "count":
                        raise AnalysisError(f"{call.name}() can't take DISTINCT")
                    i, _ = of(A.VarRef(arg.name) if isinstance(arg, A.Distinct) else arg.args[0])
                    aggs[text] = (name, F.count_distinct(F.col(i)), "integer")
                elif call.name == "integral":
                    v = ex.value(arg)
                    if v.kind not in (*NUMERIC, None):
                        raise AnalysisError(f"integral() needs numbers, not {v.kind} values")
                    i = f"__i{len(inputs)}"
                    inputs[text] = (i, "float")
                    before.append(self._areas(f, call, v, series, buckets, i).alias(i))
                    aggs[text] = (name, F.sum(F.col(i)), "float")
                else:
                    i, kind = of(arg)
                    if fn.numeric and kind not in (*NUMERIC, None):
                        raise AnalysisError(f"{call.name}() needs numbers, not {kind} values")
                    c = fn.build(F.col(i), F.col("__time"), [self._constant(a) for a in call.args[1:]], i)
                    kind = fn.result(kind)
                    aggs[text] = (name, c.cast(SPARK_TYPES[kind]) if kind in SPARK_TYPES else c, kind)
            return aggs[text][0]

        # units: what is filled; results: what is computed from units
        units: list[tuple[str, Column, str | None]] = []
        kinds: dict[str, str | None] = {}

        def unit(e: A.Node) -> A.VarRef:
            found = _calls(e, ("agg", "selector"))
            e2 = self._swap(e, {id(c): A.VarRef(aggregate(c)) for c in found})
            inner = Expressions(Frame(f.df, [], {n: k for n, _, k in aggs.values()}, False), self.now_ns, zone)
            got = inner.value(e2)
            name = f"__u{len(units)}"
            units.append((name, got.column, got.kind))
            kinds[name] = got.kind
            return A.VarRef(name)

        def lower(e: A.Node) -> A.Node:
            if not _calls(e, ("transform", "agg", "selector")):
                if any(isinstance(n, (A.VarRef, A.Wildcard)) for n in walk(e)):
                    raise AnalysisError("mixing aggregate and non-aggregate fields is not supported")
                return e
            if not _calls(e, ("transform",)):
                return unit(e)
            if isinstance(e, A.Nested):
                return A.Nested(lower(e.expr))
            if isinstance(e, A.Binary):
                return A.Binary(lower(e.left), e.op, lower(e.right))
            if REGISTRY[e.name].kind == "transform":
                return A.Call(e.name, [lower(e.args[0]), *e.args[1:]])
            return A.Call(e.name, [lower(a) for a in e.args])

        lowered = [(name, lower(e)) for name, e in fields]
        if buckets:
            before.append(buckets.start(F.col("time")).alias("__bucket"))
        if f.time:
            before.append(F.col("time").alias("__time"))
        df = f.df.select(*keys, *before)
        group = ([F.col("__bucket")] if buckets else []) + keys
        made = [c.alias(n) for n, c, _ in aggs.values()]
        df = df.groupBy(*group).agg(*made) if group else df.agg(*made)
        df = df.select(*([F.col("__bucket").alias("time")] if buckets else []), *keys, *[c.alias(n) for n, c, _ in units])
        if buckets and fill.kind != "none":
            df = self._fill(df, series, [u[0] for u in units], kinds, buckets, fill, bounds)
            if fill.kind == "linear":
                kinds.update({k: "float" for k, v in kinds.items() if v in NUMERIC})
        return self._finish(df, lowered, kinds, series, bool(buckets), f, zone)

    def _areas(self, f: Frame, call: A.Call, v: Typed, series, buckets, name: str) -> Column:
        """The area between each point and the one before it in its group, for integral(f[, unit]); adds what it needs to the frame."""
        per = self._constant(call.args[1]) if len(call.args) > 1 else 10**9
        t = ticks_of(F.col("time"), f.nanos)
        stretch = f"{name}_stretch"
        if buckets:
            f.df = f.df.withColumns({stretch: buckets.start(F.col("time")), f"{name}_before": F.lit(None).cast("struct<t:bigint,v:double>")})
        else:
            f.df = self._with_before(f.df, v.column.cast("double"), series, f.nanos, stretch, f"{name}_before")
        line = Window.partitionBy(*[q(k) for k in series], stretch, v.column.isNotNull()).orderBy("time", v.column)
        old = F.coalesce(F.lag(F.struct(t.alias("t"), v.column.cast("double").alias("v"))).over(line), F.col(f"{name}_before"))
        area = (v.column + old["v"]) / 2 * ((t - old["t"]) / (per if f.nanos else per / 1000))
        return F.when(v.column.isNotNull(), F.coalesce(area, F.lit(0.0)))

    @staticmethod
    def _stretch(nanos: bool) -> Column:
        t = ticks_of(F.col("time"), nanos)
        return t - F.pmod(t, F.lit(STRETCH_NS if nanos else STRETCH_NS // 1000))

    def _with_before(self, df: DataFrame, value: Column, series: list[str], nanos: bool, stretch: str, before: str) -> DataFrame:
        """Points with their stretch of time and the last point with a value before it; only a row a stretch is sorted by series."""
        df = df.withColumn(stretch, self._stretch(nanos))
        point = F.when(value.isNotNull(), F.struct(ticks_of(F.col("time"), nanos).alias("t"), value.alias("v")))
        ends = df.groupBy(*[q(k) for k in series], stretch).agg(F.max(point).alias("end"))
        earlier = Window.partitionBy(*[q(k) for k in series]).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*[q(k).alias(f"__s{i}") for i, k in enumerate(series)], F.col(stretch).alias("__s"), F.last("end", ignorenulls=True).over(earlier).alias(before))
        on = F.col(stretch).eqNullSafe(F.col("__s"))
        for i, k in enumerate(series):
            on = on & q(k).eqNullSafe(F.col(f"__s{i}"))
        return df.join(ends, on).drop("__s", *[f"__s{i}" for i in range(len(series))])

    def _fill(self, df: DataFrame, series, units, kinds, buckets: Buckets, fill: A.Fill, bounds: Bounds) -> DataFrame:
        """Adds a row for each empty bucket between the bounds, or of each series' own buckets.

        Only buckets with points are put in order; the empty ones are spelled out
        from the gap between two of them, a stretch at a time.
        """
        keys = [q(k) for k in series]
        line = Window.partitionBy(*keys).orderBy("__p")
        size = F.lit(buckets.size).cast("bigint")
        df = df.withColumn("__p", buckets.place(F.col("time")))
        first = buckets.place(buckets.literal(bounds.low)) if bounds.low is not None else F.col("__p")
        last = buckets.place(buckets.literal(bounds.high)) if bounds.high is not None else F.col("__p")
        carried = [u for u in units if fill.kind == "previous" or (fill.kind == "linear" and kinds[u] in NUMERIC)]
        point = {u: F.when(F.col(u).isNotNull(), F.struct(F.col("__p").alias("p"), F.col(u).alias("v"))) for u in carried}
        past, ahead = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(1, Window.unboundedFollowing)
        more = {f"__b{u}": F.last(point[u], ignorenulls=True).over(past) for u in carried}
        if fill.kind == "linear":
            more |= {f"__a{u}": F.first(point[u], ignorenulls=True).over(ahead) for u in carried}
        df = df.withColumns({"__next": F.lead("__p").over(line), "__first": F.lag("__p").over(line).isNull()} | more)

        def run(start: Column, stop: Column, before: bool) -> Column:
            return F.struct(start.alias("start"), stop.alias("stop"), F.lit(before).alias("before"))

        p = F.col("__p")
        runs = F.array(run(p, p, False), run(p + size, F.coalesce(F.col("__next") - size, last), False), F.when(F.col("__first"), run(first, p - size, True)))
        far = F.lit(buckets.size * max(1, min(FILL_STRETCH, (1 << 62) // buckets.size))).cast("bigint")
        rows = df.select("*", F.explode(F.filter(runs, lambda r: r.isNotNull() & (r["start"] <= r["stop"]))).alias("__r"))
        rows = rows.select("*", F.explode(F.sequence("__r.start", "__r.stop", far)).alias("__piece"))
        rows = rows.select("*", F.explode(F.sequence("__piece", F.least(F.col("__r.stop"), F.col("__piece") + far - size), size)).alias("__t"))
        own, t = F.col("__t") == p, F.col("__t")
        out = []
        for u in units:
            v = F.when(own, F.col(u))
            if fill.kind == "value" and kinds[u] in NUMERIC:
                v = F.coalesce(v, F.lit(fill.value).cast(SPARK_TYPES[kinds[u]]))
            elif fill.kind == "previous":
                v = F.when(~F.col("__r.before"), F.col(f"__b{u}.v"))
            elif u in carried:
                # of the buckets before the first one nothing is known
                x, y = F.col(f"__b{u}"), F.col(f"__a{u}")
                between = x["v"].cast("double") + (y["v"].cast("double") - x["v"].cast("double")) * ((t - x["p"]) / (y["p"] - x["p"]))
                v = F.coalesce(v.cast("double"), F.when(~F.col("__r.before"), between))
            out.append(v.alias(u))
        return rows.select(buckets.at(t).alias("time"), *keys, *out)

    def _raw(self, f: Frame, fields, keys, series, zone) -> Frame:
        return self._finish(f.df, fields, f.fields, series, f.time, f, zone, raw=True)

    def _finish(self, df: DataFrame, fields, kinds, series, time: bool, f: Frame, zone, raw: bool = False) -> Frame:
        """The output columns; transforms run over the series of the frame, in time order."""
        tags = f.tags if raw else []
        own = Frame(df, tags, dict(kinds), time, f.nanos, f.named)
        transforms = any(_calls(e, ("transform",)) for _, e in fields)
        needed: list[str] = []
        if transforms:
            if not time:
                raise AnalysisError("functions over time need GROUP BY TIME")
            line = Window.partitionBy(*[q(k) for k in series]).orderBy("time")
            step = 0
            unit = 10**9 if f.nanos else 10**6

            def run(e: A.Node) -> A.Node:
                nonlocal step, own
                if not _calls(e, ("transform",)):
                    return e
                if isinstance(e, A.Nested):
                    return A.Nested(run(e.expr))
                if isinstance(e, A.Binary):
                    return A.Binary(run(e.left), e.op, run(e.right))
                fn = lookup(e.name, len(e.args))
                if fn.kind != "transform":
                    return A.Call(e.name, [run(a) for a in e.args])
                v = Expressions(own, self.now_ns, zone).value(run(e.args[0]))
                if fn.numeric and v.kind not in (*NUMERIC, None):
                    raise AnalysisError(f"{e.name}() needs numbers, not {v.kind} values")
                name, src = f"__t{step}", f"__v{step}"
                step += 1
                base = own.df.withColumn(src, v.column)
                args = [F.col(src), ticks_of(F.col("time"), f.nanos), [self._constant(a) for a in e.args[1:]]]
                if raw and fn.rows:
                    base = self._row_blocks(base, series, f.nanos, fn.rows(args[2]))
                    line_here = Window.partitionBy(*[q(k) for k in series], "__block").orderBy("__row")
                    base = base.withColumn(name, fn.build(*args, line_here, unit)).where("not __copy").drop("__block", "__row", "__copy")
                else:
                    base = base.withColumn(name, fn.build(*args, line, unit))
                own = Frame(base.drop(src), own.tags, {**own.fields, name: fn.result(v.kind)}, True, f.nanos, f.named)
                needed.append(name)
                return A.VarRef(name)

            if raw:
                fields, own = self._in_stretches(fields, own, series, zone, needed)
            fields = [(n, run(e)) for n, e in fields]
        ex = Expressions(own, self.now_ns, zone)
        out, result = [], {}
        for name, e in fields:
            v = ex.value(e)
            out.append(v.column.alias(name))
            result[name] = "string" if v.kind == "tag" else v.kind
        df = own.df.select(*([F.col("time")] if time else []), *[q(k) for k in series], *out)
        if raw or needed:
            # a point without any of the fields is no row
            df = df.where(fold(lambda a, b: a | b, [q(n).isNotNull() for n in result]))
        return Frame(df, [], result, time, f.nanos, f.named)

    def _in_stretches(self, fields, own: Frame, series: list[str], zone, needed: list[str]) -> tuple[list[tuple[str, A.Node]], Frame]:
        """The functions over time that need only the last point or the sum of all that is before, all at once.

        A series is worked on in stretches of time.  Into each stretch goes a row
        a function with what is before it, in front of its points; only a row a
        stretch is sorted by series.
        """
        made: dict[str, tuple[str, str, object, A.Call, str | None]] = {}
        base, swaps = own.df, {}
        ex = Expressions(own, self.now_ns, zone)
        for _, e in fields:
            for c in _calls(e, ("transform",)):
                fn = lookup(c.name, len(c.args))
                if not fn.carry or _calls(c.args[0], ("transform",)):
                    continue
                if str(c) not in made:
                    v = ex.value(c.args[0])
                    if fn.numeric and v.kind not in (*NUMERIC, None):
                        raise AnalysisError(f"{c.name}() needs numbers, not {v.kind} values")
                    n = len(made)
                    made[str(c)] = (f"__c{n}", f"__w{n}", fn, c, v.kind)
                    base = base.withColumn(f"__w{n}", v.column)
                swaps[id(c)] = A.VarRef(made[str(c)][0])
        if not made:
            return fields, own
        keys = [q(k) for k in series]
        base = base.withColumn("__stretch", self._stretch(own.nanos))
        sources = {src: fn.carry for _, src, fn, _, _ in made.values()}
        t = F.col("time")
        aggs = []
        for src, carry in sources.items():
            aggs.append(F.max(F.when(F.col(src).isNotNull(), F.struct(t.alias("t"), F.col(src).alias("v")))).alias(src))
            if carry == "sum":
                aggs.append(F.sum(src).alias(f"{src}_sum"))
        ends = base.groupBy(*keys, "__stretch").agg(*aggs)
        earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
        kinds = {x.name: x.dataType for x in base.schema}
        rows = base.withColumn("__first", F.lit(1))
        for src, carry in sources.items():
            last = F.last(src, ignorenulls=True).over(earlier)
            value = F.sum(f"{src}_sum").over(earlier) if carry == "sum" else last["v"]
            before = ends.select(*keys, "__stretch", last["t"].alias("time"), value.cast(kinds[src]).alias(src), F.lit(0).alias("__first")).where(F.col(src).isNotNull())
            rows = rows.unionByName(before, allowMissingColumns=True)
        line = Window.partitionBy(*keys, "__stretch").orderBy("__first", "time")
        unit = 10**9 if own.nanos else 10**6
        got = {name: fn.build(F.col(src), ticks_of(t, own.nanos), [self._constant(a) for a in c.args[1:]], line, unit) for name, src, fn, c, _ in made.values()}
        df = rows.withColumns(got).where("__first = 1").drop("__first", "__stretch", *sources)
        needed += got
        more = {name: fn.result(kind) for name, _, fn, _, kind in made.values()}
        return [(n, self._swap(e, swaps)) for n, e in fields], Frame(df, own.tags, {**own.fields, **more}, True, own.nanos, own.named)

    def _row_blocks(self, df: DataFrame, series: list[str], nanos: bool, n: int) -> DataFrame:
        """Points numbered by time in their series (__row), in blocks of numbers (__block) that begin with copies (__copy) of the n - 1 points before."""
        keys = [q(k) for k in series]
        df = df.withColumn("__stretch", self._stretch(nanos))
        counts = df.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"))
        earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
        heads = counts.select(*keys, "__stretch", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"), F.lit(0).alias("__first"))
        rows = df.withColumn("__first", F.lit(1)).unionByName(heads, allowMissingColumns=True)
        line = Window.partitionBy(*keys, "__stretch").orderBy("__first", "time")
        rows = rows.withColumn("__row", F.row_number().over(line) - 2 + F.first("__base").over(line)).where("__first = 1").drop("__first", "__base", "__stretch")
        size = max(BLOCK_POINTS, 4 * n)
        block = F.expr(f"__row div {size}")
        places = F.array(F.struct(block.alias("b"), F.lit(False).alias("c")), F.when(F.col("__row") % size > size - n, F.struct((block + 1).alias("b"), F.lit(True).alias("c"))))
        rows = rows.select("*", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("__x"))
        return rows.withColumns({"__block": F.col("__x.b"), "__copy": F.col("__x.c")}).drop("__x")

    def _limits(self, f: Frame, s: A.Select) -> Frame:
        df, series = f.df, f.series
        down = bool(s.order_by and s.order_by.descending)
        columns = [c for c in df.columns if c != "time" and c not in series]
        order = [F.col("time").desc() if down else F.col("time").asc()] if f.time else []
        order += [q(c).asc() for c in columns]
        if (s.slimit or s.soffset) and series:
            some = df.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(series)]).distinct().orderBy(*[F.col(f"__k{i}") for i in range(len(series))])
            on = fold(lambda a, b: a & b, [q(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(series)])
            if s.slimit:
                some = some.offset(s.soffset.n).limit(s.slimit.n) if s.soffset else some.limit(s.slimit.n)
                df = df.join(some, on, "left_semi")
            else:
                df = df.join(some.limit(s.soffset.n), on, "left_anti")
        elif (s.soffset and s.soffset.n > 0) or (s.slimit and s.slimit.n == 0):
            df = df.where(F.lit(False))
        if s.limit or s.offset:
            if series:
                line = Window.partitionBy(*[q(k) for k in series]).orderBy(*order)
                df = df.withColumn("__n", F.row_number().over(line))
                if s.limit:
                    df = df.where(F.col("__n") <= s.limit.n + (s.offset.n if s.offset else 0))
                if s.offset:
                    df = df.where(F.col("__n") > s.offset.n)
                df = df.drop("__n")
            else:
                df = df.orderBy(*order)
                df = df.offset(s.offset.n) if s.offset else df
                df = df.limit(s.limit.n) if s.limit else df
        if s.order_by:
            df = df.orderBy(*[q(k).asc() for k in series], *order)
        return Frame(df, f.tags, f.fields, f.time, f.nanos, f.named, series)
