"""Functions by name: scalar, aggregate, stateful (running) and unnesting, built in or registered.

A builder takes Columns and returns a Column, so a function is part of the plan that Catalyst sees.
Python code enters only through what a user registers: a pandas_udf, or a UDTF's array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


class Kind(Enum):
    SCALAR = "scalar"
    AGGREGATE = "aggregate"
    STATEFUL = "stateful"
    UNNEST = "unnest"


@dataclass(frozen=True)
class Partial:
    """How a stateful function's value is put together from ranges of its input.

    parts: aggregates, each with how its values for several ranges fold into one ("sum", "min" or
    "max"); finish: the function's value, from the parts' values over all that came so far.
    """

    parts: tuple[tuple[Callable[..., Column], str], ...]
    finish: Callable[..., Column] = lambda part: part


@dataclass(frozen=True)
class Function:
    name: str
    kind: Kind
    build: Callable[..., Column]
    arity: int | None = None  # None: any number
    partial: Partial | None = None  # of a stateful function; None: it has to see all rows in turn

    def __call__(self, *args) -> Column:
        if self.arity is not None and len(args) != self.arity:
            raise TypeError(f"{self.name} takes {self.arity} arguments, not {len(args)}")
        return self.build(*[a if isinstance(a, Column) else F.lit(a) for a in args])


def _running(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _count(*columns: Column) -> Column:
    return F.count(*(columns or (F.lit(1),)))


_BUILT_IN = [
    Function("eq", Kind.SCALAR, lambda a, b: a == b, 2),
    Function("neq", Kind.SCALAR, lambda a, b: a != b, 2),
    Function("lt", Kind.SCALAR, lambda a, b: a < b, 2),
    Function("le", Kind.SCALAR, lambda a, b: a <= b, 2),
    Function("gt", Kind.SCALAR, lambda a, b: a > b, 2),
    Function("ge", Kind.SCALAR, lambda a, b: a >= b, 2),
    Function("not", Kind.SCALAR, lambda a: ~a, 1),
    Function("and", Kind.SCALAR, lambda *c: reduce(lambda a, b: a & b, c, F.lit(True))),
    Function("or", Kind.SCALAR, lambda *c: reduce(lambda a, b: a | b, c, F.lit(False))),
    Function("is-null", Kind.SCALAR, lambda a: a.isNull(), 1),
    Function("numeric-add", Kind.SCALAR, lambda a, b: a + b, 2),
    Function("numeric-subtract", Kind.SCALAR, lambda a, b: a - b, 2),
    Function("numeric-multiply", Kind.SCALAR, lambda a, b: a * b, 2),
    Function("numeric-divide", Kind.SCALAR, lambda a, b: a / b, 2),
    Function("numeric-mod", Kind.SCALAR, lambda a, b: a % b, 2),
    Function("count", Kind.AGGREGATE, _count),
    Function("sum", Kind.AGGREGATE, F.sum, 1),
    Function("avg", Kind.AGGREGATE, F.avg, 1),
    Function("min", Kind.AGGREGATE, F.min, 1),
    Function("max", Kind.AGGREGATE, F.max, 1),
    Function("running-count", Kind.STATEFUL, _count, None, Partial(((_count, "sum"),))),
    Function("running-sum", Kind.STATEFUL, F.sum, 1, Partial(((F.sum, "sum"),))),
    Function("running-min", Kind.STATEFUL, F.min, 1, Partial(((F.min, "min"),))),
    Function("running-max", Kind.STATEFUL, F.max, 1, Partial(((F.max, "max"),))),
    Function("running-avg", Kind.STATEFUL, F.avg, 1, Partial(((F.sum, "sum"), (_count, "sum")), lambda total, n: F.when(n > 0, total / n))),
    Function("scan-collection", Kind.UNNEST, lambda a: a, 1),
    Function("range", Kind.UNNEST, lambda low, high: F.when(low <= high, F.sequence(low, high)), 2),
]


class Registry:
    """Functions by name. An unnesting function builds an array, of which each element becomes a row."""

    def __init__(self):
        self._by_name = {f.name: f for f in _BUILT_IN}

    def register(self, name: str, kind: Kind, build: Callable[..., Column], arity: int | None = None, partial: Partial | None = None) -> Function:
        """Bind a name to a builder; a pandas_udf is a builder for SCALAR (or, grouped, for AGGREGATE).

        partial: for STATEFUL, how its values over ranges are put together. Without it the function
        takes the rows of a whole partition (or relation) one after another.
        """
        made = self._by_name[name] = Function(name, kind, build, arity, partial)
        return made

    def __getitem__(self, name: str) -> Function:
        if name not in self._by_name:
            raise KeyError(f"unknown function {name}")
        return self._by_name[name]

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def call(self, name: str, *args) -> Column:
        return self[name](*args)

    def running(self, name: str, window: WindowSpec, *args) -> Column:
        """The value of a stateful function up to and with each row of the window."""
        function = self[name]
        if function.kind is not Kind.STATEFUL:
            raise TypeError(f"{name} is not stateful")
        over = _running(window)
        if function.partial is None:
            return function(*args).over(over)
        function(*args)  # the number of arguments
        return function.partial.finish(*[build(*args).over(over) for build, _ in function.partial.parts])


#: The functions that Relation and the script language look up.
FUNCTIONS = Registry()
