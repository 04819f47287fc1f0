"""File sources and sinks: delimited text, raw lines, Parquet; text with printed values, no-op, console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plankit.functions.types import printed, schema
from plankit.operators.relation import Relation
from plankit.sources.shared import file_system


def paths(splits: str) -> list[str]:
    """The paths of "node:path,node:path". Nodes are left to Spark's scheduler; a path without a node, and one with a URI scheme, stays."""
    found = []
    for split in (s.strip() for s in splits.split(",")):
        node, colon, path = split.partition(":")
        found.append(path if colon and not path.startswith("//") and "/" not in node else split)
    return found


def read_delimited(spark: SparkSession, splits: str | list[str], fields: list[tuple[str, str]], delimiter: str = ",", trailing: bool = False) -> Relation:
    """Delimited text without header or quotes, of declared fields; a malformed row fails the query.

    A row is malformed if its number of fields differs, or if a field's text is no value of its type;
    an empty text is a string, and no number. Every row is checked, whatever columns are used and also
    if it is an empty line. trailing: a line may end with a delimiter. Without declared fields each
    line is a row without columns.
    """
    lines = spark.read.text(paths(splits) if isinstance(splits, str) else splits)
    if not fields:
        return Relation(lines.select())
    kinds = schema(*fields)
    if odd := [f.name for f in kinds if not isinstance(f.dataType, T.AtomicType)]:
        raise TypeError(f"delimited text has no values for {', '.join(odd)}")
    cells, n = F.col("_cells"), len(kinds)
    right = F.size(cells) == n
    if trailing:
        right = right | ((F.size(cells) == n + 1) & (F.get(cells, F.lit(n)) == ""))
    texts = [F.get(cells, F.lit(i)) for i in range(n)]
    for text, f in zip(texts, kinds):
        if not isinstance(f.dataType, T.StringType):
            right = right & text.try_cast(f.dataType).isNotNull()
    checked = F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), "value")).cast("boolean"))
    split = lines.withColumn("_cells", F.split("value", f"\\Q{delimiter}\\E", -1)).where(checked)
    values = [(t if isinstance(f.dataType, T.StringType) else t.try_cast(f.dataType)).alias(f.name) for t, f in zip(texts, kinds)]
    return Relation(split.select(*values))


def read_lines(spark: SparkSession, splits: str | list[str], name: str = "line") -> Relation:
    """Each line as one string."""
    return Relation(spark.read.text(paths(splits) if isinstance(splits, str) else splits).withColumnRenamed("value", name))


def read_parquet(spark: SparkSession, *where: str) -> Relation:
    return Relation(spark.read.parquet(*where))


def product_with(relation: Relation, source: Relation) -> Relation:
    """A scan over an input: each input row with each row of the source."""
    return relation.join(source)


def printed_row(df: DataFrame, separator: str = "; ", quoted: bool = True) -> Column:
    """A row's values as text, joined by the separator."""
    return F.concat_ws(separator, *[printed(F.col(f"`{f.name}`"), f.dataType, quoted) for f in df.schema.fields])


def write_text(relation: Relation, path: str, columns: list[str] | None = None, separator: str = "; ", quoted: bool = True, single: bool = False, mode: str = "error") -> None:
    """A line for each row, in files below path; single: in one file, in the relation's order.

    Rows are printed, and sorted, in many tasks either way; for one file what they wrote is joined.
    """
    df = relation.df.select(*columns) if columns else relation.df
    df.select(printed_row(df, separator, quoted).alias("value")).write.mode(mode).text(path)
    if single:
        _join_parts(df.sparkSession, path)


def _join_parts(spark: SparkSession, folder: str) -> None:
    """One file in place of a folder's part files, in their order, which is that of the partitions."""
    files, path = file_system(spark, folder)
    at = spark._jvm.org.apache.hadoop.fs.Path
    parts = sorted(s.getPath().toString() for s in files.listStatus(path) if s.getPath().getName().startswith("part-"))
    whole = files.create(at(f"{folder}/_whole"), True)
    for part in parts:
        read = files.open(at(part))
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, whole, spark._jsc.hadoopConfiguration(), False)
        read.close()
    whole.close()
    for part in parts:
        files.delete(at(part), False)
    if not files.rename(at(f"{folder}/_whole"), at(f"{folder}/part-00000.txt")):
        raise OSError(f"cannot name the file in {folder}")


def write_parquet(relation: Relation, path: str, partition_by: list[str] = (), mode: str = "error") -> None:
    """The binary, self-describing sink."""
    relation.df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_to_all(relation: Relation, *sinks: str) -> None:
    """The same rows, computed once, as Parquet to several paths."""
    copies = relation.replicate(len(sinks))
    try:
        for copy, path in zip(copies, sinks):
            write_parquet(copy, path)
    finally:
        relation.df.unpersist()


def sink(relation: Relation) -> None:
    """Compute every row and keep none."""
    relation.df.write.format("noop").mode("overwrite").save()


def show(relation: Relation, rows: int = 20) -> None:
    """The first rows on the console, as printed text."""
    relation.df.select(printed_row(relation.df).alias("row")).show(rows, truncate=False)
