"""The registered queries of the algebra, one or more for each operator, each with its SQL.

All read each table by name, and end in explicit column types, so that the SQL gives the same names,
types and values. Those of sinks, stored data sets and plans run them when they are built, in paths of
their own in the shared folder; the others are lazy.
"""

from __future__ import annotations

import io
import operator
from collections.abc import Callable
from contextlib import redirect_stdout

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from plankit.functions.registry import FUNCTIONS, Kind, Partial
from plankit.functions.types import printed
from plankit.operators import nested
from plankit.operators.relation import Relation
from plankit.plans import explain
from plankit.plans.scripts import Script
from plankit.sources import files
from plankit.sources.catalog import Catalog, deleted
from plankit.sources.shared import new_path
from plankit.streaming.events import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
col = F.col


class Tables:
    """The tables of a folder, as relations."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        """A path of its own in the shared folder."""
        return new_path(self.spark, name)

    def text(self, name: str, *columns: str, separator: str = ",", end: str = "") -> str:
        """The path of the named table's columns as delimited text."""
        path = self.path(name)
        line = F.concat(F.concat_ws(separator, *[col(c).cast("string") for c in columns]), F.lit(end))
        getattr(self, name).df.select(line.alias("value")).write.text(path)
        return path

    def __getattr__(self, name: str) -> Relation:
        return Relation(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def query(sql: str | None) -> Callable[[Callable[[Tables], Relation]], Callable[[Tables], Relation]]:
    """Register a function of Tables under its name, with its SQL."""

    def registered(build: Callable[[Tables], Relation]) -> Callable[[Tables], Relation]:
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder)).df
        if sql:
            ORACLES[build.__name__] = " ".join(sql.split())
        return build

    return registered


# scans, projections, assignments, filters


@query("""SELECT n.n_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance FROM nation n
          JOIN customer c ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name ORDER BY customers DESC, n.n_name LIMIT 10""")
def flagship(t):
    counted = t.customer.group(["c_nationkey"], customers=F.count("*"), total=F.sum("c_acctbal"))
    named = counted.join(t.nation, col("c_nationkey") == col("n_nationkey"))
    summed = named.group(["n_name"], customers=F.sum("customers"), balance=F.round(F.sum("total"), 2))
    return summed.order("-customers", "n_name").limit(10)


@query("SELECT c_custkey, c_name FROM customer")
def scan_project(t):
    return t.customer.project("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3")
def select_eq(t):
    return t.nation.select(FUNCTIONS.call("eq", col("n_nationkey"), 3)).project("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 1000 AND o_orderstatus = 'O') OR NOT (o_custkey >= 10)")
def select_conjuncts(t):
    f = FUNCTIONS.call
    both = f("and", f("gt", col("o_totalprice"), 1000), f("eq", col("o_orderstatus"), "O"))
    return t.orders.select(f("or", both, f("not", f("ge", col("o_custkey"), 10)))).project("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size <= 40 AND p_size >= 5 AND p_partkey < 1500 AND p_partkey > 10 AND p_size <> 7")
def select_compare_all(t):
    f = FUNCTIONS.call
    size, key = col("p_size"), col("p_partkey")
    return t.part.select(f("and", f("le", size, 40), f("ge", size, 5), f("lt", key, 1500), f("gt", key, 10), f("neq", size, 7))).project("p_partkey")


@query("""SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000
          WHERE o.o_orderkey IS NULL""")
def select_is_null(t):
    joined = t.customer.left_outer(t.orders, (col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 400000))
    return joined.select(FUNCTIONS.call("is-null", col("o_orderkey"))).project("c_custkey")


@query("SELECT n_nationkey, n_nationkey + n_regionkey AS s FROM nation")
def assign_add(t):
    return t.nation.assign(s=FUNCTIONS.call("numeric-add", col("n_nationkey"), col("n_regionkey"))).project("n_nationkey", "s")


@query("SELECT 400 AS a, 3 AS b")
def assign_const(t):
    return Relation.empty_tuple(t.spark).assign(a=400, b=3)


@query("SELECT 400 + 3 AS s")
def assign_subplan_const(t):
    return Relation.empty_tuple(t.spark).assign(a=400, b=3).assign(s=col("a") + col("b")).project("s")


@query("SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, p_size % 7 AS d FROM part")
def assign_arith(t):
    size = col("p_size")
    return t.part.assign(a=size + 1, b=size - 1, c=size * 2, d=size % 7).project("p_partkey", "a", "b", "c", "d")


# joins


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, col("o_custkey") == col("c_custkey")).project("o_orderkey", "c_name")


@query("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_broadcast(t):
    return t.nation.join(t.region, col("n_regionkey") == col("r_regionkey"), hint="broadcast_right").project("n_name", "r_name")


@query("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_broadcast_left(t):
    return t.region.join(t.nation, col("n_regionkey") == col("r_regionkey"), hint="broadcast_left").project("n_name", "r_name")


@query("SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_shuffle_hash(t):
    return t.orders.join(t.customer, col("o_custkey") == col("c_custkey"), hint="shuffle_hash").project("o_orderkey", "c_mktsegment")


@query("SELECT count(*) AS n FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey")
def join_multi_key(t):
    return t.customer.join(t.supplier, (col("c_nationkey") == col("s_nationkey")) & (col("c_custkey") == col("s_suppkey"))).aggregate(n=F.count("*"))


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
def join_left_outer(t):
    return t.customer.left_outer(t.orders, col("c_custkey") == col("o_custkey")).project("c_custkey", "o_orderkey")


@query("SELECT n.n_nationkey, c.c_custkey FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9000")
def join_left_outer_residual(t):
    on = (col("n_nationkey") == col("c_nationkey")) & (col("c_acctbal") > 9000)
    return t.nation.left_outer(t.customer, on).project("n_nationkey", "c_custkey")


@query("SELECT n.n_nationkey, c.c_custkey FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal > 9000")
def join_left_outer_where(t):
    return t.nation.left_outer(t.customer, col("n_nationkey") == col("c_nationkey")).select(col("c_acctbal") > 9000).project("n_nationkey", "c_custkey")


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey")
def join_theta(t):
    return t.nation.join(t.region, col("n_regionkey") < col("r_regionkey")).project("n_nationkey", "r_regionkey")


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n LEFT JOIN region r ON n.n_regionkey < r.r_regionkey")
def join_theta_left(t):
    return t.nation.left_outer(t.region, col("n_regionkey") < col("r_regionkey")).project("n_nationkey", "r_regionkey")


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n CROSS JOIN region r")
def join_product(t):
    return t.nation.join(t.region).project("n_nationkey", "r_regionkey")


@query("""SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey
          JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name""")
def join_three_way(t):
    places = t.region.join(t.nation, col("r_regionkey") == col("n_regionkey"))
    return t.customer.join(places, col("c_nationkey") == col("n_nationkey")).group(["r_name"], n=F.count("*"))


@query("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def join_semi(t):
    return nested.exists(t.customer, t.orders, {"c_custkey": "o_custkey"}).project("c_custkey")


@query("SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k = b.k")
def join_null_keys(t):
    left, right = t.customer.assign(k=F.nullif(col("c_nationkey"), F.lit(3))), t.supplier.assign(k=F.nullif(col("s_nationkey"), F.lit(3)))
    return left.join(right, ["k"], hint="many").project("c_custkey", "s_suppkey")


@query("""SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a
          LEFT JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k = b.k""")
def join_null_keys_left(t):
    left, right = t.customer.assign(k=F.nullif(col("c_nationkey"), F.lit(3))), t.supplier.assign(k=F.nullif(col("s_nationkey"), F.lit(3)))
    return left.left_outer(right, ["k"], hint="many").project("c_custkey", "s_suppkey")


# aggregation


@query("SELECT count(*) AS n FROM customer")
def agg_count(t):
    return t.customer.aggregate(n=FUNCTIONS.call("count"))


@query("SELECT count(*) AS n, sum(c_acctbal) AS s FROM customer WHERE c_custkey < 0")
def agg_empty(t):
    return t.customer.select(col("c_custkey") < 0).aggregate(n=F.count("*"), s=F.sum("c_acctbal"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def group_count(t):
    return t.customer.group(["c_nationkey"], n=F.count("*"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey < 0 GROUP BY c_nationkey")
def group_empty(t):
    return t.customer.select(col("c_custkey") < 0).group(["c_nationkey"], n=F.count("*"))


@query("SELECT p_size % 5 AS k, count(*) AS n FROM part GROUP BY p_size % 5")
def group_expr_key(t):
    return t.part.group({"k": col("p_size") % 5}, n=F.count("*"))


@query("""SELECT n.n_nationkey, n.n_name, count(*) AS n FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
          GROUP BY n.n_nationkey, n.n_name""")
def group_decor(t):
    return t.customer.join(t.nation, col("c_nationkey") == col("n_nationkey")).group(["n_nationkey"], decor=["n_name"], n=F.count("*"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_extendedprice) AS lo,
          max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_multi_agg(t):
    price = col("l_extendedprice")
    return t.lineitem.group(["l_returnflag", "l_linestatus"], n=F.count("*"), q=F.round(F.sum("l_quantity"), 2), lo=F.min(price), hi=F.max(price))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_custkey")
def group_filtered_agg(t):
    return t.orders.group(["o_custkey"], f=F.count_if(col("o_orderstatus") == "F"), n=F.count("*"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_having(t):
    return t.orders.group(["o_custkey"], n=F.count("*")).select(col("n") > 12)


@query("""SELECT o_orderstatus, count(*) AS custs, max(n) AS most FROM
          (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) t GROUP BY o_orderstatus""")
def group_nested(t):
    return t.orders.group_nested(["o_orderstatus"], ["o_custkey"], {"n": F.count("*")}, custs=F.count("*"), most=F.max("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_all(t):
    return t.orders.project("o_orderstatus", "o_orderpriority").distinct()


@query("""SELECT c_nationkey, c_custkey, c_name FROM
          (SELECT c.*, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer c) t WHERE rn = 1""")
def distinct_by_key(t):
    return t.customer.distinct(["c_nationkey"], order=["c_custkey"]).project("c_nationkey", "c_custkey", "c_name")


@query("SELECT c_nationkey, max(c_custkey) AS last, count(*) AS n FROM customer GROUP BY c_nationkey")
def group_apply(t):
    def body(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_nationkey": group["c_nationkey"][:1], "last": [group["c_custkey"].max()], "n": [len(group)]})

    return t.customer.project("c_nationkey", "c_custkey").group_apply(["c_nationkey"], body, "c_nationkey int, last long, n long")


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey")
def udaf_spread(t):
    @F.pandas_udf("double")
    def spread(values: pd.Series) -> float:
        return values.max() - values.min()

    made = FUNCTIONS.register("spread-of", Kind.AGGREGATE, spread, 1)
    return t.customer.group(["c_nationkey"], spread=made(col("c_acctbal"))).assign(spread=F.round("spread", 2))


@query("SELECT c_nationkey, round(sqrt(sum(c_acctbal * c_acctbal)), 2) AS norm FROM customer GROUP BY c_nationkey")
def udaf_of_built_ins(t):
    made = FUNCTIONS.register("norm", Kind.AGGREGATE, lambda c: F.sqrt(F.sum(c * c)), 1)  # with partial sums before the shuffle
    return t.customer.group(["c_nationkey"], norm=F.round(made(col("c_acctbal")), 2))


# running functions


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def running_count(t):
    return t.orders.project("o_orderkey").running(["o_orderkey"], rn=("running-count",))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders")
def running_count_part(t):
    return t.orders.project("o_orderkey", "o_custkey").running(["o_orderkey"], ["o_custkey"], rn=("running-count",))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM orders""")
def running_sum(t):
    made = t.orders.running(["o_orderkey"], ["o_custkey"], total=("running-sum", "o_totalprice"))
    return made.assign(s=F.round("total", 2)).project("o_orderkey", "s")


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS mean FROM orders")
def running_udaf(t):
    partial = Partial(((F.sum, "sum"), (F.count, "sum")), operator.truediv)
    FUNCTIONS.register("running-mean", Kind.STATEFUL, F.avg, 1, partial)
    made = t.orders.project("o_orderkey", "o_totalprice").running(["o_orderkey"], mean=("running-mean", "o_totalprice"))
    return made.assign(mean=F.round("mean", 2)).project("o_orderkey", "mean")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey DESC) AS rn FROM customer")
def running_string_key(t):
    made = t.customer.project("c_mktsegment", "c_custkey").running(["c_mktsegment", "-c_custkey"], rn=("running-count",))
    return made.project("c_custkey", "rn")


@query("""SELECT o_orderkey, max(o_totalprice) OVER w AS hi, min(o_orderdate) OVER w AS first FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_extremes(t):
    made = t.orders.running(["o_orderkey"], ["o_custkey"], hi=("running-max", "o_totalprice"), first=("running-min", "o_orderdate"))
    return made.project("o_orderkey", "hi", "first")


# order and limits


@query("SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey ASC, c_custkey DESC")
def order_multi(t):
    return t.customer.project("c_custkey", "c_nationkey").order("c_nationkey", "-c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def topk(t):
    return t.orders.project("o_orderkey", "o_totalprice").order("-o_totalprice", "o_orderkey").limit(5)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 3")
def limit_offset(t):
    return t.customer.project("c_custkey").order("c_custkey").limit(5, offset=3)


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t WHERE rn <= 2""")
def limit_per_group(t):
    return t.orders.project("o_custkey", "o_orderkey").limit_per(["o_custkey"], ["o_orderkey"], 2)


@query("SELECT c_custkey FROM (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_custkey LIMIT 100) t WHERE c_nationkey = 3")
def select_above_limit(t):
    return t.customer.project("c_custkey", "c_nationkey").order("c_custkey").limit(100).select(col("c_nationkey") == 3).project("c_custkey")


@query("SELECT c_custkey FROM customer")
def die_not_reached(t):
    return t.customer.project("c_custkey").die(1 << 40)


@query("SELECT true AS failed, count(*) AS n FROM customer")
def die_reached(t):
    try:
        files.sink(t.customer.project("c_custkey").die(10))
    except PySparkException as error:
        failed = "injected failure" in str(error)
    else:
        failed = False
    return t.customer.aggregate(n=F.count("*")).assign(failed=F.lit(failed)).project("failed", "n")


# unions, replicas, branches


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(t):
    return t.customer.union_all(t.supplier, [("c_nationkey", "s_nationkey", "k")])


@query("""SELECT a.o_custkey, a.n, b.total FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) a
          JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey""")
def replicate_self_join(t):
    one, two = t.orders.project("o_custkey", "o_totalprice").replicate(2, keep=False)
    return one.group(["o_custkey"], n=F.count("*")).join(two.group(["o_custkey"], total=F.round(F.sum("o_totalprice"), 2)), ["o_custkey"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def replicate_to_sinks(t):
    paths = t.path("first"), t.path("second")
    files.write_to_all(t.nation.project("n_nationkey", "n_name"), *paths)
    one, two = (files.read_parquet(t.spark, p) for p in paths)
    return one.union_all(two)


@query("""SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier
          UNION ALL SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_regionkey AS k FROM nation""")
def union_nary(t):
    named = [r.assign(k=col(c)).project("k") for r, c in ((t.customer, "c_nationkey"), (t.supplier, "s_nationkey"), (t.nation, "n_nationkey"), (t.nation, "n_regionkey"))]
    return named[0].union_many(*named[1:])


@query("""SELECT CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS branch, count(*) AS n
          FROM orders GROUP BY 1""")
def partition_split(t):
    return t.orders.split(col("o_totalprice") < 1000, col("o_orderstatus") == "O").group(["branch"], n=F.count("*"))


@query("""SELECT o_orderkey, 'small' AS kind FROM orders WHERE o_totalprice < 1000 UNION ALL
          SELECT o_orderkey, 'open' AS kind FROM orders WHERE NOT o_totalprice < 1000 AND o_orderstatus = 'O' UNION ALL
          SELECT o_orderkey, 'rest' AS kind FROM orders WHERE NOT o_totalprice < 1000 AND o_orderstatus <> 'O'""")
def split_branches(t):
    parts = t.orders.split(col("o_totalprice") < 1000, col("o_orderstatus") == "O").branches(3)
    small, open_, rest = (p.assign(kind=F.lit(kind)).project("o_orderkey", "kind") for p, kind in zip(parts, ("small", "open", "rest")))
    return small.union_many(open_, rest)


# unnesting and subplans


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def unnest(t):
    return t.embeddings.unnest("x", "embedding").project("vec_id", "x")


@query("""SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings""")
def unnest_positional(t):
    return t.embeddings.unnest("x", "embedding", position="pos").project("vec_id", "pos", "x")


@query("""SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE vec_id % 3 = 0
          UNION ALL SELECT vec_id, NULL AS x FROM embeddings WHERE vec_id % 3 <> 0""")
def unnest_outer(t):
    nothing = F.array().cast("array<float>")
    kept = F.when(col("vec_id") % 3 == 0, col("embedding")).when(col("vec_id") % 3 == 1, nothing)  # else null
    return t.embeddings.assign(kept=kept).unnest("x", "kept", outer=True).project("vec_id", "x")


@query("SELECT x FROM (SELECT unnest([100, 200, 300]) AS x) t")
def unnest_const(t):
    return Relation.empty_tuple(t.spark).unnest_call("x", "scan-collection", F.array(F.lit(100), F.lit(200), F.lit(300)))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_regionkey AS k, n_name AS v FROM nation")
def unnest_map(t):
    pairs = F.array(F.struct(col("n_nationkey").alias("k"), col("n_name").alias("v")), F.struct(col("n_regionkey").alias("k"), col("n_name").alias("v")))
    return t.nation.unnest_map(pairs)


@query("SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
def subplan_scalar_agg(t):
    return nested.subplan_aggregate(t.customer, t.orders, {"c_custkey": "o_custkey"}, {"n": 0}, n=F.count("*")).project("c_custkey", "n")


@query("""SELECT c.c_custkey, x.ok FROM customer c LEFT JOIN LATERAL
          (SELECT o.o_orderkey AS ok FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) x ON true""")
def subplan_null_extend(t):
    body = lambda r: r.select(col("o_totalprice") > 400000).assign(ok=col("o_orderkey"))
    return nested.subplan(t.customer, t.orders, {"c_custkey": "o_custkey"}, body).project("c_custkey", "ok")


@query("""SELECT c.c_custkey, x.o_orderkey FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x
          ON x.o_custkey = c.c_custkey AND x.rn <= 3""")
def subplan_limit(t):
    return nested.subplan(t.customer, t.orders, {"c_custkey": "o_custkey"}, limit=3, order=["-o_totalprice", "o_orderkey"]).project("c_custkey", "o_orderkey")


@query("SELECT n.n_nationkey, (SELECT count(*) FROM region) AS regions FROM nation n")
def subplan_uncorrelated(t):
    return nested.subplan_aggregate(t.nation, t.region, {}, regions=F.count("*")).project("n_nationkey", "regions")


@query("""SELECT n.n_nationkey, x.c_custkey FROM nation n LEFT JOIN LATERAL
          (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000) x ON true""")
def nested_tuple_source(t):
    body = t.customer.select((col("c_nationkey") == col("n_nationkey").outer()) & (col("c_acctbal") > 9000)).project("c_custkey")
    return nested.lateral(t.nation, body).project("n_nationkey", "c_custkey")


# sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def delimited_comma(t):
    path = t.text("nation", "n_nationkey", "n_name", "n_regionkey")
    return files.read_delimited(t.spark, f"node1:{path}", [("n_nationkey", "int"), ("n_name", "chararray"), ("n_regionkey", "int")])


@query("SELECT s_suppkey, s_name, CAST(s_acctbal AS FLOAT) AS s_acctbal FROM supplier")
def delimited_trailing(t):
    path = t.text("supplier", "s_suppkey", "s_name", "s_acctbal", separator="|", end="|")
    return files.read_delimited(t.spark, [path], [("s_suppkey", "long"), ("s_name", "chararray"), ("s_acctbal", "float")], "|", trailing=True)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS name FROM customer")
def delimited_empty_fields(t):
    path = t.path("customer")
    name = F.when(col("c_custkey") % 2 == 0, "").otherwise(col("c_name"))
    t.customer.df.select(F.concat_ws(",", col("c_custkey").cast("string"), name).alias("value")).write.text(path)
    return files.read_delimited(t.spark, [path], [("c_custkey", "long"), ("name", "chararray")])


@query("SELECT r_regionkey || '|' || r_name AS line FROM region")
def raw_lines(t):
    return files.read_lines(t.spark, [t.text("region", "r_regionkey", "r_name", separator="|")])


@query("""SELECT n_nationkey || '; "' || n_name || '"; ' || n_regionkey AS line FROM nation""")
def write_text(t):
    path = t.path("nation")
    files.write_text(t.nation, path, ["n_nationkey", "n_name", "n_regionkey"])
    return files.read_lines(t.spark, [path])


@query("SELECT n_name || '; ' || n_nationkey AS line, row_number() OVER (ORDER BY n_name DESC) AS nth FROM nation")
def write_text_in_order(t):
    path = t.path("nation")
    files.write_text(t.nation.order("-n_name"), path, ["n_name", "n_nationkey"], quoted=False, single=True)
    whole = t.spark.read.text(path, wholetext=True)  # one row, as there is one file
    return Relation(whole.select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("line <> ''").select("line", (col("pos") + 1).cast("long").alias("nth")))


@query(r"""SELECT event_id, '"' || replace(replace(props, '\', '\\'), '"', '\"') || '"' AS quoted, props AS bare, CAST(user_id AS VARCHAR) AS number FROM events""")
def value_printers(t):
    kinds = t.events.df.schema
    props = col("props")
    made = t.events.assign(quoted=printed(props, kinds["props"].dataType), bare=printed(props, kinds["props"].dataType, False), number=printed(col("user_id"), kinds["user_id"].dataType))
    return made.project("event_id", "quoted", "bare", "number")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def binary_writer(t):
    path = t.path("orders")
    files.write_parquet(t.orders.project("o_orderkey", "o_orderdate", "o_totalprice"), path)
    return files.read_parquet(t.spark, path)


@query("""SELECT r_regionkey || '; "' || r_name || '"' AS row FROM region""")
def console_printer(t):
    shown = io.StringIO()
    with redirect_stdout(shown):
        files.show(t.region.project("r_regionkey", "r_name"))
    lines = [x.strip("|").strip() for x in shown.getvalue().splitlines() if x.startswith("|")][1:]
    return Relation(t.spark.createDataFrame([(x,) for x in lines], "row string"))


@query("SELECT count(*) AS n FROM orders")
def sink(t):
    seen = Observation()
    files.sink(Relation(t.orders.df.observe(seen, F.count(F.lit(1)).alias("n"))))
    return Relation(t.spark.createDataFrame([(seen.get["n"],)], "n long"))


# data movement: what the plan promises, counted


@query("SELECT count(DISTINCT o_custkey) AS keys, 1 AS most FROM orders")
def hash_partition(t):
    at = t.orders.hash_partition("o_custkey").assign(at=F.spark_partition_id())
    return at.group(["o_custkey"], parts=F.count_distinct("at")).aggregate(keys=F.count("*"), most=F.max("parts").cast("int"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM orders")
def hash_partition_merge(t):
    parts = t.orders.hash_partition_sorted(["o_custkey"], ["o_orderkey"]).assign(at=F.spark_partition_id(), nth=F.monotonically_increasing_id())
    before = F.lag("o_orderkey").over(Window.partitionBy("at").orderBy("nth"))
    return parts.assign(before=before).aggregate(n=F.count("*"), out_of_order=F.count_if(col("before") > col("o_orderkey")))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS overlaps FROM orders")
def range_partition(t):
    parts = t.orders.range_partition("o_totalprice").assign(at=F.spark_partition_id()).group(["at"], n=F.count("*"), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"))
    before = F.lag("hi").over(Window.orderBy("at"))  # a row for each partition
    return parts.assign(before=before).aggregate(n=F.sum("n"), overlaps=F.count_if(col("before") > col("lo")))


@query("SELECT count(*) AS n, CAST(1 AS BIGINT) AS parts FROM nation")
def random_merge(t):
    return t.nation.merge_to_one().assign(at=F.spark_partition_id()).aggregate(n=F.count("*"), parts=F.count_distinct("at"))


# functions by name


@query("SELECT p_partkey, p_size - 1 AS b, p_size * 2 AS c, p_size / 4.0::DOUBLE AS d, p_size % 7 AS e, p_size + p_partkey AS f FROM part")
def arith_by_name(t):
    f, size = FUNCTIONS.call, col("p_size")
    values = {"b": f("numeric-subtract", size, 1), "c": f("numeric-multiply", size, 2), "d": f("numeric-divide", size, 4), "e": f("numeric-mod", size, 7)}
    return t.part.assign(**values, f=f("numeric-add", size, col("p_partkey"))).project("p_partkey", *"bcdef")


@query("SELECT p_partkey, upper(p_brand) || '-' || p_size AS label FROM part")
def scalar_udf(t):
    made = FUNCTIONS.register("label", Kind.SCALAR, lambda a, b: F.concat(F.upper(a), F.lit("-"), b.cast("string")), 2)
    return t.part.assign(label=made(col("p_brand"), col("p_size"))).project("p_partkey", "label")


@query("SELECT n_nationkey, length(n_name) AS size FROM nation")
def scalar_pandas_udf(t):
    @F.pandas_udf("long")
    def size(names: pd.Series) -> pd.Series:
        return names.str.len()

    return t.nation.assign(size=FUNCTIONS.register("size", Kind.SCALAR, size, 1)(col("n_name"))).project("n_nationkey", "size")


@query("SELECT r_regionkey, CAST(unnest(range(0, r_regionkey)) AS INTEGER) AS below FROM region")
def udtf(t):
    @F.udtf(returnType="below int")
    class Below:
        def eval(self, top: int):
            for i in range(top):
                yield (i,)

    return t.region.unnest_table(Below, "r_regionkey").project("r_regionkey", "below")


@query("SELECT true AS pushed, true AS pruned, 1 AS shuffles")
def explain_plan(t):
    filtered = t.customer.select(col("c_nationkey") == 3).group(["c_mktsegment"], n=F.count("*"))
    plan = explain.physical(filtered)
    found = ("EqualTo(c_nationkey,3)" in plan, "c_name" not in plan, explain.shuffles(filtered))
    return Relation(t.spark.createDataFrame([found], "pushed boolean, pruned boolean, shuffles int"))


# changes


def _stored(t) -> Catalog:
    """A catalog with customers by key, and their index by nation."""
    made = Catalog(t.spark, t.path("catalog"))
    made.declare("customer", ["c_custkey"])
    made.write_result("customer", t.customer.project("c_custkey", "c_nationkey", "c_acctbal"))
    made.create_index("customer", "by_nation", ["c_nationkey"])
    return made


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def write_result(t):
    return _stored(t).scan("customer")


@query("""SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey <> 3
          UNION ALL SELECT s_suppkey + 1000000 AS c_custkey, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal FROM supplier""")
def insert_delete(t):
    made = _stored(t)
    made.insert("customer", t.supplier.assign(c_custkey=col("s_suppkey") + 1_000_000, c_nationkey=col("s_nationkey"), c_acctbal=col("s_acctbal")))
    made.delete("customer", t.customer.select(col("c_nationkey") == 3))
    return made.scan("customer")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 99 ELSE c_nationkey END AS c_nationkey, greatest(c_acctbal, 0) AS c_acctbal FROM customer")
def update(t):
    made = _stored(t)
    made.update("customer", t.customer.select(col("c_acctbal") < 0).assign(c_nationkey=99, c_acctbal=0.0))
    return made.scan("customer")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def index_search(t):
    return _stored(t).search("customer", "by_nation", col("c_nationkey") == 7)


@query("""SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal >= 0
          UNION ALL SELECT c_custkey + 5000000 AS c_custkey FROM customer WHERE c_nationkey = 8""")
def index_insert_delete(t):
    made = _stored(t)
    made.insert_into_index("customer", "by_nation", t.customer.select(col("c_nationkey") == 8).assign(c_nationkey=7, c_custkey=col("c_custkey") + 5_000_000))
    made.delete_from_index("customer", "by_nation", t.customer.select((col("c_nationkey") == 7) & (col("c_acctbal") < 0)))
    return made.search("customer", "by_nation", col("c_nationkey") == 7)


@query("""SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal >= 0
          UNION ALL SELECT s_suppkey + 1000000 AS c_custkey FROM supplier WHERE s_nationkey = 7""")
def index_follows_changes(t):
    made = _stored(t)
    made.insert("customer", t.supplier.assign(c_custkey=col("s_suppkey") + 1_000_000, c_nationkey=col("s_nationkey"), c_acctbal=col("s_acctbal")))
    made.delete("customer", t.customer.select(col("c_acctbal") < 0))
    return made.search("customer", "by_nation", col("c_nationkey") == 7)


@query("""SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS
          (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = 3)""")
def delete_by_key(t):
    gone = t.customer.select(col("c_nationkey") == 3).df
    return Relation(deleted(t.orders.df, gone, [("o_custkey", "c_custkey")])).project("o_orderkey")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation WHERE n_nationkey > 20")
def insert_rows(t):
    added = t.nation.select(col("n_nationkey") > 20)
    return t.region.union_all(added, [("r_regionkey", "n_nationkey", "r_regionkey"), ("r_name", "n_name", "r_name")])


# scripts, and extras beyond the algebra


@query("SELECT n_nationkey AS k, n_name AS v FROM nation")
def script_identity(t):
    return t.nation.project("n_nationkey", "n_name").script("cat", [("k", "int"), ("v", "string")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey = 5) OR (o_orderkey % 7 < 2 AND o_totalprice > 1000.5 AND o_orderstatus <> '//')")
def script_language(t):
    path = t.text("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    script = f"""R = load "node1:{path}" as (o_orderkey : long, o_custkey : long, price : double, status : chararray);
                 S = filter R by o_custkey == 5 or $0 % 7 < 2 and R.price > 1.0005e3 and status != "//";
                 dump S into "node1:{t.path("dump")}";"""
    return Script(t.spark).run(script)[0].relation.project("o_orderkey", "o_custkey")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    return Relation(windowed_counts(t.events.df))
