"""Functions of the language, as builders of Spark columns.

kind
  agg        one value a group
  selector   an agg that picks a point, so other columns of the point can go along
  rows       picks several points a group (top, bottom, sample)
  transform  a value for each row from its series, by time
  math       row by row
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..lang.errors import AnalysisError


@dataclass
class Function:
    kind: str
    #: fewest and most arguments
    arity: tuple[int, int]
    build: Callable
    #: type of the result from the type of the first argument
    result: Callable[[str | None], str | None] = lambda t: t
    #: whether only numbers are accepted; a wildcard leaves other fields out
    numeric: bool = True
    #: what a transform needs of all that is before a stretch of its series: the last point or the sum; None: all of it
    carry: str | None = None
    #: how many points, with its own, a transform needs for each, from its arguments
    rows: Callable[[list], int] | None = None


REGISTRY: dict[str, Function] = {}


def register_function(name: str, function: Function) -> None:
    """Adds a function under a lower-case name, or replaces it."""
    REGISTRY[name.lower()] = function


def lookup(name: str, n_args: int) -> Function:
    f = REGISTRY.get(name)
    if f is None:
        raise AnalysisError(f"undefined function {name}()")
    if not f.arity[0] <= n_args <= f.arity[1]:
        raise AnalysisError(f"invalid number of arguments for {name}")
    return f


def _float(_):
    return "float"


def _integer(_):
    return "integer"


# build(value, time, args, name): an aggregate Column; name: of the column that holds the value
def _timed(pick: Callable[[Column], Column]) -> Callable:
    """first and last: by time, then value, among points that have a value."""
    return lambda v, t, a, n: pick(F.when(v.isNotNull(), F.struct(t.alias("t"), v.alias("v")))).getField("v")


def _percentile(v: Column, t: Column, args: list, name: str) -> Column:
    """Nearest rank: the least value that so many percent of the values don't exceed."""
    p = float(args[0])
    if not 0 <= p <= 100:
        raise AnalysisError("percentile must be between 0 and 100")
    return F.expr(f"percentile_disc({p / 100!r}) WITHIN GROUP (ORDER BY {name})")


for _name, _function in {
    "count": Function("agg", (1, 1), lambda v, t, a, n: F.count(v), _integer, False),
    "sum": Function("agg", (1, 1), lambda v, t, a, n: F.sum(v)),
    "mean": Function("agg", (1, 1), lambda v, t, a, n: F.avg(v), _float),
    "median": Function("agg", (1, 1), lambda v, t, a, n: F.median(v), _float),
    # ties: the least value
    "mode": Function("agg", (1, 1), lambda v, t, a, n: F.mode(v, True), numeric=False),
    "spread": Function("agg", (1, 1), lambda v, t, a, n: F.max(v) - F.min(v)),
    "stddev": Function("agg", (1, 1), lambda v, t, a, n: F.stddev_samp(v), _float),
    # the sketch of 2**16 registers that the storage keeps for cardinalities
    "approx_count_distinct": Function("agg", (1, 1), lambda v, t, a, n: F.hll_sketch_estimate(F.hll_sketch_agg(v.cast("string"), 16)), _integer, False),
    # the planner gives the areas between points of a group
    "integral": Function("agg", (1, 2), lambda v, t, a, n: F.sum(v), _float),
    "percentile": Function("selector", (2, 2), _percentile),
    "min": Function("selector", (1, 1), lambda v, t, a, n: F.min(v)),
    "max": Function("selector", (1, 1), lambda v, t, a, n: F.max(v)),
    "first": Function("selector", (1, 1), _timed(F.min), numeric=False),
    "last": Function("selector", (1, 1), _timed(F.max), numeric=False),
}.items():
    register_function(_name, _function)


# rows: build(value, time, args) -> (how many, order)
register_function("top", Function("rows", (2, 9), lambda v, t, a: (int(a[-1]), [v.desc(), t.asc()])))
register_function("bottom", Function("rows", (2, 9), lambda v, t, a: (int(a[-1]), [v.asc(), t.asc()])))
# the same rows for the same data: a hash is the random order
register_function("sample", Function("rows", (2, 2), lambda v, t, a: (int(a[-1]), [F.xxhash64(t, v).asc(), t.asc()]), numeric=False))


# transforms: build(value, ticks, args, series, unit): ticks is the time as a long, of which ``unit`` make a second;
# ``series`` is the window of the series, or of a part of it that begins with what is needed from before (``carry``, ``rows``)
def _lagged(make: Callable[[Column, Column, Column, Column], Column]) -> Callable:
    def build(v: Column, ticks: Column, args: list, series: WindowSpec, unit: int) -> Column:
        # the point before with a value
        old = F.last(F.when(v.isNotNull(), F.struct(ticks.alias("t"), v.alias("v"))), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
        per = (args[0] if args else 10**9) * unit / 10**9
        return F.when(v.isNotNull(), make(v, old.getField("v"), ticks - old.getField("t"), F.lit(per)))

    return build


def _rate(v, old, gap, per):
    return F.try_divide((v - old).cast("double"), gap / per)


def _only_up(make):
    def build(v, old, gap, per):
        x = make(v, old, gap, per)
        return F.when(x >= 0, x)

    return build


def _difference(v, old, gap, per):
    return v - old


register_function("difference", Function("transform", (1, 1), _lagged(_difference), carry="last"))
register_function("derivative", Function("transform", (1, 2), _lagged(_rate), _float, carry="last"))
register_function("non_negative_difference", Function("transform", (1, 1), _lagged(_only_up(_difference)), carry="last"))
register_function("non_negative_derivative", Function("transform", (1, 2), _lagged(_only_up(_rate)), _float, carry="last"))


def _elapsed(v: Column, ticks: Column, args: list, series: WindowSpec, unit: int) -> Column:
    old = F.last(F.when(v.isNotNull(), ticks), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    size = max(1, (args[0] if args else 1) * unit // 10**9) if unit < 10**9 else (args[0] if args else 1)
    scale = 1 if unit == 10**9 or args else 10**9 // unit
    return F.when(v.isNotNull(), F.floor((ticks - old) * scale / size).cast("long"))


def _moving(v: Column, ticks: Column, args: list, series: WindowSpec, unit: int) -> Column:
    n = int(args[0])
    if n < 2:
        raise AnalysisError("moving_average window must be greater than 1")
    frame = series.rowsBetween(1 - n, 0)
    return F.when((F.count(v).over(frame) == n), F.avg(v).over(frame))


register_function("elapsed", Function("transform", (1, 2), _elapsed, _integer, False, "last"))
register_function("moving_average", Function("transform", (2, 2), _moving, _float, rows=lambda a: int(a[0])))


def _running(v: Column, ticks: Column, args: list, series: WindowSpec, unit: int) -> Column:
    own = F.sum(v).over(series.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(v.isNotNull(), own)


register_function("cumulative_sum", Function("transform", (1, 1), _running, carry="sum"))

# math: build(columns)
for _name in ("sqrt", "exp", "sin", "cos", "tan", "asin", "acos", "atan"):
    register_function(_name, Function("math", (1, 1), lambda c, n=_name: getattr(F, n)(c[0]), _float))
# logarithms of what has none are null
for _name, _f in {"ln": F.log, "log2": F.log2, "log10": F.log10}.items():
    register_function(_name, Function("math", (1, 1), lambda c, f=_f: F.when(c[0] > 0, f(c[0])), _float))
register_function("log", Function("math", (2, 2), lambda c: F.when((c[0] > 0) & (c[1] > 0) & (c[1] != 1), F.log(c[0]) / F.log(c[1])), _float))
register_function("pow", Function("math", (2, 2), lambda c: F.pow(c[0], c[1]), _float))
register_function("atan2", Function("math", (2, 2), lambda c: F.atan2(c[0], c[1]), _float))
register_function("abs", Function("math", (1, 1), lambda c: F.abs(c[0])))
for _name in ("ceil", "floor", "round"):
    register_function(_name, Function("math", (1, 1), lambda c, n=_name: getattr(F, n)(c[0]).cast("double")))
