"""Connected components by alternating large-star and small-star rewrites of the edge list.

Each round replaces edges so that every node points nearer to the smallest node of its component;
when no node points to two, nor to one that points on, the edges are stars around those smallest nodes.
Each round is aggregations and joins keyed by node, written to the shared folder, so a lost executor
costs at most the round it was in. A node of very high degree is one skewed join key, which adaptive
execution splits; its minimum is pre-aggregated before the shuffle. The driver plans each round's jobs
and keeps what it knows of them, so no round is run only to see that it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plankit.llm.scratch import drop_path, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each u of distinct edges (u, v), u > v, has one edge, and no v is a u. Such edges are the components."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").count() == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (u long, v long), any order, repeats allowed, no nulls. Returns (u, v): each node that has
    an edge to another and is not itself the smallest of its component, and that smallest node.

    An empty edge list gives no rows. ``rounds`` guards against a fault; it raises when it is not
    enough, and never returns unfinished components.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            return now
        after, new = written(_small_star(_large_star(now)), "edges")
        drop_path(spark, path)
        now, path = after, new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
