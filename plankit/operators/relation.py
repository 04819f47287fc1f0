"""The algebra: a Relation is a lazy DataFrame, and each operator gives another.

Operators keep the meaning of standard SQL: bags, three-valued logic, null keys that equal nothing.
Where an operator depends on order, the order is an argument, since rows have none of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plankit.functions.registry import FUNCTIONS, Kind

#: A side named in a broadcast hint is broadcast if its estimated size is at most this.
BROADCAST_BYTES = 256 << 20

#: A running function over all rows of a relation goes through one task if its estimated size is at most this:
#: estimates are by compressed files, and 4 MB of one number a row can be 1.3 M rows, of 80 bytes each in a sort.
ONE_TASK_BYTES = 4 << 20

#: Rows of a range that a larger one is dealt into, about, and rows sampled for each range.
RANGE_ROWS, SAMPLED = 500_000, 40

Order = Sequence[str | Column]


def _order(keys: Order) -> list[Column]:
    """Columns as they are; names, with "-" in front for descending."""
    return [k if isinstance(k, Column) else F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _hinted(df: DataFrame) -> DataFrame:
    """df to be broadcast, if its estimated size allows; else as it is, for Spark to choose at run time."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def _dealt(df: DataFrame) -> DataFrame:
    """df in equal parts: several for each core, so that none waits long for the last."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


class Relation:
    """A lazy relation. Nothing runs before a sink or the DataFrame's own actions, but for running() over ranges."""

    def __init__(self, df: DataFrame):
        self.df = df

    # sources without a table

    @classmethod
    def empty_tuple(cls, spark: SparkSession) -> Relation:
        """One row without columns."""
        return cls(spark.range(1).select())

    # projections, assignments, filters

    def assign(self, **columns: Column | str | int | float) -> Relation:
        """Keep all columns and add computed ones. Every expression sees the input row only."""
        return Relation(self.df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}))

    def project(self, *names: str) -> Relation:
        """The named columns, in the named order; duplicate rows stay."""
        return Relation(self.df.select(*names))

    def select(self, condition: Column) -> Relation:
        """Rows whose condition is true; false and null go."""
        return Relation(self.df.where(condition))

    # joins

    def join(self, other: Relation, on: Column | list[str] | str | None = None, how: str = "inner", hint: str | None = None) -> Relation:
        """Inner or left (left_semi, left_anti) join; without a condition the product.

        hint: "broadcast_left" or "broadcast_right" names the side to send whole (honoured up to
        BROADCAST_BYTES by estimate); "shuffle_hash" or "merge" names a strategy; "many" is for few keys
        that repeat on both sides: rows of the left are dealt out one by one, whatever their keys, so that
        all tasks make an equal share of the product (if the right can be sent whole; else Spark splits
        what is skewed). The condition of an outer join, residual included, decides what matches, and
        never filters afterwards.
        """
        left, right = self.df, other.df
        if hint == "broadcast_left":
            left = _hinted(left)
        elif hint == "broadcast_right":
            right = _hinted(right)
        elif hint == "many":
            if estimated_bytes(right) <= BROADCAST_BYTES:
                left, right = _dealt(left), F.broadcast(right)
        elif hint:
            right = right.hint(hint)
        if on is None and how == "inner":
            return Relation(left.crossJoin(right))
        return Relation(left.join(right, F.lit(True) if on is None else on, how))

    def left_outer(self, other: Relation, on: Column | list[str] | str, hint: str | None = None) -> Relation:
        """Each row of this relation with its matches, or with nulls."""
        return self.join(other, on, "left", hint)

    # aggregation

    def aggregate(self, **aggregates: Column) -> Relation:
        """One row, also of an empty input; the input's columns are gone."""
        return Relation(self.df.agg(*[c.alias(k) for k, c in aggregates.items()]))

    def group(self, keys: dict[str, Column | str] | list[str], decor: list[str] = (), **aggregates: Column) -> Relation:
        """One row for each group of equal keys (null keys make a group), none of an empty input.

        keys: names, or names for expressions. decor: columns that the keys determine, carried along;
        of different values in a group the smallest is taken, so that the result is defined.
        """
        named = keys if isinstance(keys, dict) else {k: k for k in keys}
        columns = [(F.col(e) if isinstance(e, str) else e).alias(k) for k, e in named.items()]
        values = [F.min(d).alias(d) for d in decor] + [c.alias(k) for k, c in aggregates.items()]
        grouped = self.df.groupBy(*columns)
        return Relation(grouped.agg(*values) if values else self.df.select(*columns).distinct())

    def group_nested(self, keys: list[str], inner: list[str], inner_aggregates: dict[str, Column], **outer: Column) -> Relation:
        """A group-by inside each group: first by keys and inner keys, then the outer aggregates by keys."""
        return self.group([*keys, *inner], **inner_aggregates).group(keys, **outer)

    def group_apply(self, keys: list[str], body: Callable, schema: str) -> Relation:
        """For nested plans that no aggregate expresses: body takes a group as pandas and returns pandas.

        A group comes into one task whole, so this is for groups of bounded size; the others are there
        for the rest.
        """
        return Relation(self.df.groupBy(*keys).applyInPandas(body, schema))

    def distinct(self, keys: list[str] | None = None, order: Order = ()) -> Relation:
        """One row for each different value of the keys, all columns kept: the first by the order.

        Without keys: of all columns. Without an order the survivor is the one with the smallest row.
        """
        if keys is None or set(keys) == set(self.df.columns):
            return Relation(self.df.distinct())
        by = _order(order) or [F.struct(*[c for c in self.df.columns if c not in keys])]
        window = Window.partitionBy(*keys).orderBy(*by)
        return Relation(self.df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth"))

    # running functions

    def running(self, order: Order, partition: list[str] = (), **functions: tuple) -> Relation:
        """Add the value, up to each row in the order, of stateful functions: name=(function, arguments...).

        With a partition, each part starts anew. Without one, a relation of at most ONE_TASK_BYTES by
        estimate goes through one task, in order. A larger one is dealt into ranges of all its order
        keys (two small jobs find their bounds now): the functions run inside each range, and are put
        together with what the ranges before it give, a table of one row for each range. Both ways
        give the same values. A function without a Partial, and an order that is not all names, have no
        ranged way: they go through one task at any size.
        """
        made = {k: (FUNCTIONS[f], [F.col(a) if isinstance(a, str) else a for a in args]) for k, (f, *args) in functions.items()}
        ranges = not partition and all(isinstance(k, str) for k in order) and all(f.partial for f, _ in made.values())
        if ranges and estimated_bytes(self.df) > ONE_TASK_BYTES:
            return self._running_ranges(order, made)
        window = Window.partitionBy(*partition).orderBy(*_order(order))
        return Relation(self.df.withColumns({k: FUNCTIONS.running(f.name, window, *args) for k, (f, args) in made.items()}))

    def _ranged(self, order: Sequence[str]) -> tuple[DataFrame, int]:
        """The rows with _range, the number of bounds that come before a row in the order. Rows of equal keys share a range.

        Also the number of ranges. There are so many ranges that each has RANGE_ROWS rows at most, about, however large the relation.
        A row is compared with the first bound of each group of bounds, then with those of one group.
        """
        names = [k.removeprefix("-") for k in order]
        keys = self.df.select(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)])
        rows = keys.count()
        count = max(2, int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
        share = min(1.0, SAMPLED * count / max(1, rows))
        sampled = keys.sample(share, 17).orderBy(*_order([k[: k.startswith("-")] + f"k{i}" for i, k in enumerate(order)])).collect()
        bounds = list(dict.fromkeys(sampled[i * len(sampled) // count] for i in range(1, count))) if sampled else []
        if not bounds:
            return self.df.withColumn("_range", F.lit(0)), 1

        def before(bound: Column) -> Column:
            """Whether the bound comes before the row: by the first key in which they differ."""
            found = F.lit(False)
            for i, (key, name) in reversed(list(enumerate(zip(order, names)))):
                a, b = bound[f"k{i}"], F.col(name)
                if key.startswith("-"):
                    a, b = b, a
                less = (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))
                found = less | (a.eqNullSafe(b) & found)
            return found

        wide = math.isqrt(len(bounds) - 1) + 1
        groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
        lists = ArrayType(keys.schema)
        table = self.df.sparkSession.createDataFrame([([g[0] for g in groups], groups)], StructType().add("_firsts", lists).add("_groups", ArrayType(lists)))
        dealt = self.df.crossJoin(F.broadcast(table)).withColumn("_group", F.size(F.filter("_firsts", before)) - 1)
        inside = (F.col("_group") * wide + F.size(F.filter(F.get("_groups", F.col("_group")), before))).cast("int")
        return dealt.withColumn("_range", F.when(F.col("_group") < 0, 0).otherwise(inside)).drop("_firsts", "_groups", "_group"), len(bounds) + 1

    def _running_ranges(self, order: Sequence[str], made: dict[str, tuple]) -> Relation:
        dealt, count = self._ranged(order)
        parts = {f"_{k}_{i}": (build(*args), fold) for k, (f, args) in made.items() for i, (build, fold) in enumerate(f.partial.parts)}
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
        totals = dealt.groupBy("_range").agg(*[value.alias(p) for p, (value, _) in parts.items()])
        totals = totals.select("_range", *[getattr(F, fold)(p).over(earlier).alias(f"{p}_before") for p, (_, fold) in parts.items()])
        inside = Window.partitionBy("_range").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        spread = dealt.repartition(max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), count), "_range")
        joined = spread.withColumns({p: value.over(inside) for p, (value, _) in parts.items()}).join(F.broadcast(totals), "_range")

        def so_far(part: str, fold: str) -> Column:
            old, new = F.col(f"{part}_before"), F.col(part)
            return F.coalesce(old + new, old, new) if fold == "sum" else (F.least if fold == "min" else F.greatest)(old, new)

        values = {k: f.partial.finish(*[so_far(f"_{k}_{i}", fold) for i, (_, fold) in enumerate(f.partial.parts)]) for k, (f, _) in made.items()}
        kinds = self.df.limit(0).agg(*[f(*args).alias(k) for k, (f, args) in made.items()]).schema
        return Relation(joined.select(*self.df.columns, *[v.cast(kinds[k].dataType).alias(k) for k, v in values.items()]))

    # order, limits, injected failures

    def order(self, *keys: str | Column) -> Relation:
        """Rows in total order; give a unique last key where ties matter. Nulls are first ascending, last descending."""
        return Relation(self.df.orderBy(*_order(keys)))

    def limit(self, count: int, offset: int = 0) -> Relation:
        """Skip offset rows, then at most count."""
        return Relation((self.df.offset(offset) if offset else self.df).limit(count))

    def limit_per(self, keys: list[str], order: Order, count: int, offset: int = 0) -> Relation:
        """A limit inside each group, which starts anew for each: the rank limit is applied before the shuffle too."""
        window = Window.partitionBy(*keys).orderBy(*_order(order))
        ranked = self.df.withColumn("_nth", F.row_number().over(window))
        return Relation(ranked.where((F.col("_nth") > offset) & (F.col("_nth") <= offset + count)).drop("_nth"))

    def die(self, after: int) -> Relation:
        """Pass up to that many rows; a relation of more fails with "injected failure". For tests of failure.

        The rows are counted by partial counts, so that none are moved for it.
        """
        counted = self.df.agg(F.count("*").alias("_rows"))  # one row
        over = F.when(F.col("_rows") > after, F.raise_error(F.lit("injected failure")).cast("boolean")).otherwise(True)
        return Relation(self.df.crossJoin(F.broadcast(counted)).where(over).drop("_rows"))

    # set operations, several consumers

    def union_all(self, other: Relation, columns: Sequence[tuple[str, str, str]] | None = None) -> Relation:
        """A bag union. columns: (left, right, out) for each output column; else by position, with the left's names."""
        if columns is None:
            return Relation(self.df.union(other.df))
        left = self.df.select(*[F.col(a).alias(out) for a, _, out in columns])
        return Relation(left.union(other.df.select(*[F.col(b).alias(out) for _, b, out in columns])))

    def union_many(self, *others: Relation, columns: Sequence[str] | None = None) -> Relation:
        """A bag union of this relation and others, by position, or of the named columns by name."""
        made = self.df.select(*columns) if columns else self.df
        for other in others:
            made = made.unionByName(other.df.select(*columns)) if columns else made.union(other.df)
        return Relation(made)

    def replicate(self, count: int, keep: bool = True) -> list[Relation]:
        """count relations of the same rows.

        keep: computed once, and held in memory and on disk until the first one's df.unpersist(). Else
        they share a plan, of which Spark reuses the exchanges that are alike in one query; for rows
        that are cheaper to read again than to hold.
        """
        shared = self.df.persist() if keep else self.df
        return [Relation(shared) for _ in range(count)]

    def split(self, *conditions: Column, default: bool = True, name: str = "branch") -> Relation:
        """Add each row's branch: the number of its first true condition; else, with a default, their count.

        Without a default, rows of no branch go. branches() gives one relation for each.
        """
        branch = F.lit(len(conditions)) if default else F.lit(None).cast("int")
        for i, condition in reversed(list(enumerate(conditions))):
            branch = F.when(condition, F.lit(i)).otherwise(branch)
        marked = self.df.withColumn(name, branch)
        return Relation(marked if default else marked.where(F.col(name).isNotNull()))

    def branches(self, count: int, name: str = "branch") -> list[Relation]:
        """The rows of each branch of a split()."""
        return [Relation(self.df.where(F.col(name) == i).drop(name)) for i in range(count)]

    # nested values

    def unnest(self, out: str, array: str | Column, position: str | None = None, outer: bool = False) -> Relation:
        """A row for each element of an array, with its 0-based position if asked for.

        A null or empty array gives no row; with outer, one with nulls.
        """
        column = F.col(array) if isinstance(array, str) else array
        if position is None:
            return Relation(self.df.select("*", (F.explode_outer if outer else F.explode)(column).alias(out)))
        return Relation(self.df.select("*", (F.posexplode_outer if outer else F.posexplode)(column).alias(position, out)))

    def unnest_call(self, out: str, function: str, *args) -> Relation:
        """unnest() of what a registered unnesting function builds."""
        made = FUNCTIONS[function]
        if made.kind is not Kind.UNNEST:
            raise TypeError(f"{function} does not unnest")
        return self.unnest(out, made(*args))

    def unnest_table(self, function: Callable, *arguments: str | Column) -> Relation:
        """Each row with each row that a user-defined table function makes of it; none drops the row."""
        columns = [F.col(a) if isinstance(a, str) else a for a in arguments]
        return Relation(self.df.lateralJoin(function(*[c.outer() for c in columns])))

    def unnest_map(self, structs: str | Column) -> Relation:
        """The fields of each struct of an array as a row of their own; input columns are not kept."""
        return Relation(self.df.select(F.inline(F.col(structs) if isinstance(structs, str) else structs)))

    # data movement, for the cases where the plan has to be told

    def hash_partition(self, *keys: str, count: int | None = None) -> Relation:
        return Relation(self.df.repartition(*([count] if count else []), *keys))

    def range_partition(self, *keys: str, count: int | None = None) -> Relation:
        return Relation(self.df.repartitionByRange(*([count] if count else []), *keys))

    def hash_partition_sorted(self, keys: list[str], order: Order) -> Relation:
        """Hash partitions, each in order."""
        return Relation(self.df.repartition(*keys).sortWithinPartitions(*_order(order)))

    def merge_to_one(self) -> Relation:
        """One partition, unordered: what makes the rows still runs in many tasks. For results that one task can hold."""
        return Relation(self.df.repartition(1))

    # external programs

    def script(self, command: str, out: Sequence[tuple[str, str]], delimiter: str = "|") -> Relation:
        """Send rows as delimited text through a command in each task, and read its output as the out columns.

        A status other than zero fails the query. Input columns are replaced by the output's.
        """
        name = f"_script_{id(self)}"
        self.df.createOrReplaceTempView(name)
        fields = ", ".join(f"`{n}` {kind}" for n, kind in out)
        columns = ", ".join(f"`{c}`" for c in self.df.columns)
        text = "ROW FORMAT DELIMITED FIELDS TERMINATED BY '{}' LINES TERMINATED BY '\\n'"
        quoted = command.replace("\\", "\\\\").replace("'", "\\'")
        # the script's output is split by a regular expression
        expression = "".join(f"[{c}]" if c in "|.*+?()$" else c for c in delimiter)
        query = f"SELECT TRANSFORM({columns}) {text.format(delimiter)} USING '{quoted}' AS ({fields}) {text.format(expression)} FROM {name}"
        found = self.df.sparkSession.sql(query)
        self.df.sparkSession.catalog.dropTempView(name)
        return Relation(found)
