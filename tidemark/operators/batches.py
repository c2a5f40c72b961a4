"""Rows by partition."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def partition_counts(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("hive_key")).agg(F.count(F.lit(1)).alias("n_rows"))


def group_by_partition(df: DataFrame, key: Column, order: Sequence[str] = ()) -> DataFrame:
    """(key, rows): each partition's rows as one array, in ``order``, or as they come in ``df``.

    A partition is one row of the result, as asked for; for partitions beyond
    a task's memory use ``run_pieces``, which streams.
    """
    own = F.struct(*[F.col(c) for c in order], *([] if order else [F.col("__at")]), F.struct(*df.columns).alias("__row"))
    placed = df if order else df.withColumn("__at", F.monotonically_increasing_id())
    grouped = placed.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(own)).alias("rows"))
    return grouped.select("key", F.transform("rows", lambda x: x["__row"]).alias("rows"))


def per_partition(df: DataFrame, key: Column, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``run`` on each partition's rows as an Arrow table."""
    return df.groupBy(key.alias("key")).applyInArrow(run, schema)


def zip_partitions(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``run`` on the rows that both sides have for a partition."""
    return a.groupBy(key_a.alias("key")).cogroup(b.groupBy(key_b.alias("key"))).applyInArrow(run, schema)


def in_pieces(df: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """``df`` in ``order``, dealt to tasks by ranges of it, so a large partition is several tasks' pieces; ``n`` tasks, or as many as Spark finds."""
    dealt = df.repartitionByRange(*order) if n is None else df.repartitionByRange(n, *order)
    return dealt.sortWithinPartitions(*order)


def _runs(found: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Batches cut where the key changes."""
    for batch in found:
        at, encoded = 0, pc.run_end_encode(batch.column(key))
        for name, end in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist(), strict=True):
            yield name, batch.slice(at, end - at)
            at = end


def run_pieces(df: DataFrame, run: Callable[[str, int, Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType | str, key: str = "hive_key") -> DataFrame:
    """``run(key, piece, batches)`` on executors, for each task's piece of each partition; ``df`` must be in pieces.

    Pieces of a partition are numbered in its order, with gaps; the caller
    puts together what it makes of them.  Batches stream: no task holds a piece.
    """

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        for name, rows in itertools.groupby(_runs(found, key), key=lambda x: x[0]):
            yield from run(name, piece, (batch for _, batch in rows))

    return df.mapInArrow(task, schema)


def with_places(df: DataFrame) -> DataFrame:
    """``df``, in pieces, with the number of each row's piece and its place there; to be stored before ``numbered``, as another run may cut otherwise."""
    return df.select("*", F.spark_partition_id().alias("__piece"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))


def numbered(stored: DataFrame, place: str = "place") -> DataFrame:
    """Rows with their place over all pieces, from 0; only a row for each piece is brought together."""
    sizes = stored.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("__piece", (F.sum("__n").over(w) - F.col("__n")).alias("__start"))
    return stored.join(starts, "__piece").withColumn(place, F.col("__start") + F.col("__at")).drop("__piece", "__at", "__start")


def partitions(df: DataFrame, key: str = "hive_key"):
    """(key, rows) in key order, read partition by partition; ``df`` must be ordered by key.

    All rows pass through the driver, which holds a partition and two tasks' rows.
    """
    held, name = [], None
    for row in df.toLocalIterator(prefetchPartitions=True):
        if row[key] != name and held:
            yield name, held
            held = []
        name = row[key]
        held.append(row)
    if held:
        yield name, held
