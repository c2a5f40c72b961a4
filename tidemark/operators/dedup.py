"""Versioned deduplication inside partitions, and the contractual row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _pick(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First of each group; Spark keeps one row per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(df: DataFrame, partition: Sequence[str], entity: Sequence[str], version: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row of the highest version of each entity in each partition; of equal ones the last by ``tie``."""
    return _pick(df, [*partition, *entity], [F.desc(version), *[F.desc(t) for t in tie]])


def history(df: DataFrame, partition: Sequence[str], entity: Sequence[str], version: str, tie: Sequence[str] = ()) -> DataFrame:
    """One row of each (entity, version) in each partition, the first by ``tie``."""
    by = [*partition, *entity, version]
    return _pick(df, by, [F.asc(t) for t in tie]) if tie else df.dropDuplicates(by)


def dedup(df: DataFrame, partition: Sequence[str], entity: Sequence[str], version: str | None, keep_history: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """As configured: without an entity rows pass as they are."""
    if not entity:
        return df
    return (history if keep_history else latest)(df, partition, entity, version, tie)


def order_of(key: str, entity: Sequence[str] = (), version: str | None = None, tie: Sequence[str] = ()) -> list[str]:
    """By whole key string, then entity and version, or file and row where there is no entity."""
    return [key, *([*entity, version] if entity else []), *tie]


def ordered(df: DataFrame, key: str, entity: Sequence[str] = (), version: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*order_of(key, entity, version, tie))
