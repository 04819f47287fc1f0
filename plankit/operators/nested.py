"""Subplans: a nested plan for each row of an outer relation, as joins that Catalyst can order and spread.

A correlated body is given by the equalities that tie it to the outer row and by what it does then.
Each form is one shuffle of the inner relation by the correlation keys; no plan runs row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plankit.operators.relation import Order, Relation, _order


def _tied(outer: DataFrame, inner: DataFrame, keys: dict[str, str]) -> Column:
    condition = F.lit(True)
    for i, (left, right) in enumerate(keys.items()):
        condition = outer[left] == inner[right] if i == 0 else condition & (outer[left] == inner[right])
    return condition


def subplan_aggregate(outer: Relation, inner: Relation, keys: dict[str, str], empty: dict[str, object] | None = None, **aggregates: Column) -> Relation:
    """Each outer row with aggregates over the inner rows that agree on the keys (outer name: inner name).

    The inner relation is aggregated first, by its keys. empty: values for outer rows without inner
    ones (a count's 0); null for the others. Without keys: the same aggregates for every row.
    """
    names = list(aggregates)
    if not keys:
        return Relation(outer.df.crossJoin(F.broadcast(inner.df.agg(*[c.alias(k) for k, c in aggregates.items()]))))  # one row
    renamed = {right: f"_key_{i}" for i, right in enumerate(dict.fromkeys(keys.values()))}
    grouped = inner.df.groupBy(*[F.col(r).alias(k) for r, k in renamed.items()]).agg(*[c.alias(k) for k, c in aggregates.items()])
    joined = outer.df.join(grouped, _tied(outer.df, grouped, {left: renamed[right] for left, right in keys.items()}), "left")
    values = [F.coalesce(F.col(n), F.lit(empty[n])).alias(n) if empty and n in empty else F.col(n) for n in names]
    return Relation(joined.select(*[outer.df[c] for c in outer.df.columns], *values))


def subplan(outer: Relation, inner: Relation, keys: dict[str, str], body: Callable[[Relation], Relation] | None = None, limit: int | None = None, order: Order = ()) -> Relation:
    """Each outer row with each row of the nested plan, or with nulls where that has none.

    body is applied to the inner relation first (filters, assignments, projections: what does not
    depend on the outer row but by the keys). With a limit, only the first rows by the order for each
    key, which ranks are cut before the shuffle too.
    """
    rows = body(inner) if body else inner
    if limit is not None:
        window = Window.partitionBy(*keys.values()).orderBy(*_order(order))
        rows = Relation(rows.df.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= limit).drop("_nth"))
    return Relation(outer.df.join(rows.df, _tied(outer.df, rows.df, keys), "left"))


def exists(outer: Relation, inner: Relation, keys: dict[str, str], negated: bool = False) -> Relation:
    """Outer rows for which the nested plan has a row; negated: has none."""
    return Relation(outer.df.join(inner.df, _tied(outer.df, inner.df, keys), "left_anti" if negated else "left_semi"))


def lateral(outer: Relation, body: Relation, keep_unmatched: bool = True) -> Relation:
    """Each outer row with each row of any nested plan over it, or with nulls where that has none.

    The body names outer columns as F.col("name").outer(); Catalyst rewrites it to joins, or rejects
    what it cannot. keep_unmatched: false drops the outer rows whose plan has no row.
    """
    return Relation(outer.df.lateralJoin(body.df, F.lit(True), "left" if keep_unmatched else "inner"))
