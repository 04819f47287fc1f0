"""Plans as text, and the questions that tests ask of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from plankit.operators.relation import Relation


def _df(of: Relation | DataFrame) -> DataFrame:
    return of.df if isinstance(of, Relation) else of


def logical(of: Relation | DataFrame) -> str:
    """The optimized logical plan."""
    return _df(of)._jdf.queryExecution().optimizedPlan().toString()


def physical(of: Relation | DataFrame) -> str:
    """The physical plan."""
    return _df(of)._jdf.queryExecution().executedPlan().toString()


def operators(of: Relation | DataFrame) -> list[str]:
    """The names of the physical operators, from the top."""
    plan = _df(of)._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", plan, re.M)


def shuffles(of: Relation | DataFrame) -> int:
    """How many exchanges move rows between tasks; broadcasts are not counted."""
    return sum(name == "Exchange" for name in operators(of))
