"""Type names of the script language and of delimited files, and how values are printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type names; tuple, bag and map hold strings unless a Spark DDL type is given instead.
TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "chararray": T.StringType(),
    "boolean": T.BooleanType(),
    "tuple": T.StructType([T.StructField("value", T.StringType())]),
    "bag": T.ArrayType(T.StringType()),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def data_type(name: str) -> T.DataType:
    """The Spark type of a declared type name (any case), or of a Spark DDL type."""
    found = TYPES.get(name.lower())
    return found if found is not None else T._parse_datatype_string(name)


def schema(*fields: tuple[str, str]) -> T.StructType:
    """A schema of (name, type name) pairs. Every field may be null."""
    return T.StructType([T.StructField(name, data_type(kind), True) for name, kind in fields])


def printed(column: Column, kind: T.DataType, quoted: bool = True) -> Column:
    """A value as text: strings in double quotes, with backslash and quote escaped; others as Spark casts them; null as null."""
    text = column.cast("string")
    if isinstance(kind, T.StringType) and quoted:
        text = F.concat(F.lit('"'), F.regexp_replace(text, r'([\\"])', r"\\$1"), F.lit('"'))
    return F.coalesce(text, F.lit("null"))
