"""Reading one schema through another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero(kind: T.DataType) -> Column:
    """What a column that a file lacks reads as."""
    if isinstance(kind, T.StructType):
        return F.struct(*[zero(f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("0001-01-01 00:00:00").cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit("0001-01-01").cast(kind)
    return F.lit(0).cast(kind)


def filled(columns: list[str], f: T.StructField, optional: tuple[str, ...] = ()) -> Column:
    """Field ``f`` of a table with these columns; absent and null is zero, but for optional fields."""
    c = F.col(f.name).cast(f.dataType) if f.name in columns else F.lit(None).cast(f.dataType)
    return (c if f.name in optional else F.coalesce(c, zero(f.dataType))).alias(f.name)


def zero_fill(df: DataFrame, schema: T.StructType, optional: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """``schema``'s columns of ``df``, filled, and ``also`` as they are."""
    return df.select(*also, *[filled(df.columns, f, optional) for f in schema])
