"""Written tables in the folder that the cluster shares, and running totals over them.

Intermediate results that are read more than once, or that hold labels taken from a running task
(its number, a row's place in it), are written as Parquet to the folder named in
``spark.checkpoint.dir``. Spark's committers keep exactly one attempt of each task, so such a label
stays what it is when executors are lost. The JVM removes the folders when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plankit.sources.shared import drop_path, new_path

__all__ = ["drop_path", "new_path", "starts", "written"]


#: Whether Spark removes the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """The rows of df, written to the shared folder and read again; and their path. What df shuffled is removed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def starts(sums: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None, block: int = 1024) -> DataFrame:
    """For each row of sums, the sum of value over the rows before it in the given order, within ``by``.

    sums has a row or a few per task or file, numbered by its integer column order[0]. Blocks of
    ``block`` consecutive numbers are summed first, and the running total over blocks is added to
    that inside each block; so a window sees the rows of one block, or one row for each block.
    """
    by = by or []
    wide = sums.withColumn("_block", F.floor(F.col(order[0]) / block))
    inner = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = wide.groupBy(*by, "_block").agg(F.sum(value).alias("_all"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_all").over(outer), F.lit(0))).drop("_all")
    inside = wide.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return inside.join(blocks, [*by, "_block"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")
