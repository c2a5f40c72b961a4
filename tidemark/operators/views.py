"""Distinct-tuple views: what is written, looked up and filled in later."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import patterns

#: Longest tuple, written as a path.
MAX_PATH = 1000


@dataclass(frozen=True)
class View:
    """``columns`` are names of record fields, or of ``of``'s expressions.

    ``layouts`` gives time fields a Spark pattern; ``where`` skips rows.
    """

    name: str
    columns: tuple[str, ...]
    of: dict[str, Column] | None = None
    where: Column | None = None
    layouts: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name or "/" in self.name:
            raise ValueError(f"bad view name {self.name!r}")
        patterns.check_parts(self.columns)
        if self.of is not None and set(self.of) != set(self.columns):
            raise ValueError(f"view {self.name}: expressions must be given for exactly its columns")

    def check(self, schema: T.StructType) -> None:
        """Without expressions every column must be a string, or a time with a layout, of the record."""
        for c in () if self.of else self.columns:
            if c not in schema.names:
                raise ValueError(f"view {self.name}: the record has no field {c}")
            kind = schema[c].dataType
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                if c not in self.layouts:
                    raise ValueError(f"view {self.name}: time column {c} needs a layout")
            elif not isinstance(kind, T.StringType):
                raise ValueError(f"view {self.name}: column {c} is neither a string nor a time")

    def project(self, df: DataFrame) -> DataFrame:
        """Each row's tuple as strings."""
        df = df if self.where is None else df.where(self.where)
        value = lambda c: (self.of or {}).get(c, F.col(c))
        text = lambda c: F.date_format(value(c), self.layouts[c]) if c in self.layouts else value(c).cast("string")
        return df.select(*[text(c).alias(c) for c in self.columns])

    def path(self) -> Column:
        return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in self.columns])


def distinct_tuples(df: DataFrame, view: View) -> DataFrame:
    """The tuples of a batch; bad values and too long tuples are errors, not rows."""
    bad = [F.coalesce((F.col(c) == "") | F.col(c).contains("/") | F.col(c).contains(".."), F.lit(True)) for c in view.columns]
    checked = view.project(df).distinct()
    for b, c in zip(bad, view.columns, strict=True):
        checked = checked.withColumn(c, F.when(b, F.raise_error(F.concat(F.lit(f"view {view.name}: bad value of {c}: "), F.coalesce(F.col(c), F.lit("null")))).cast("string")).otherwise(F.col(c)))
    long = F.octet_length(view.path()) > MAX_PATH
    first = view.columns[0]
    return checked.withColumn(first, F.when(long, F.raise_error(F.lit(f"view {view.name}: a tuple is longer than {MAX_PATH} bytes")).cast("string")).otherwise(F.col(first)))


def parse_path(path: Column, columns: Sequence[str]) -> Column:
    """The tuple of a path made by ``View.path``, or null where it is malformed."""
    text = "^" + "/".join(f"{re.escape(c)}=([^/]+)" for c in columns) + "$"
    return F.when(path.rlike(text), F.struct(*[F.regexp_extract(path, text, i + 1).alias(c) for i, c in enumerate(columns)]))


def lookup(tuples: DataFrame, columns: Sequence[str], found: Sequence[str], bind: Callable[[DataFrame], DataFrame] | None = None, layouts: dict[str, str] | None = None) -> DataFrame:
    """Tuples that meet the patterns.  They are made distinct before ``bind``, which may repeat what it maps together."""
    df = tuples.where(patterns.predicate(found, {c: F.col(c) for c in columns})).select(*columns).distinct()
    for c, layout in (layouts or {}).items():
        df = df.withColumn(c, F.to_timestamp(c, layout))
    return bind(df) if bind else df


def backfill_stats(tuples_by_file: DataFrame, file: str, columns: Sequence[str]) -> DataFrame:
    """data_objects, records, markers: files, rows, and distinct tuples of each file added up.

    ``tuples_by_file`` has a row for each record; a null tuple was skipped.
    """
    each = tuples_by_file.groupBy(file, *columns).agg(F.count(F.lit(1)).alias("n"))
    some = F.col(columns[0]).isNotNull()
    per_file = each.groupBy(file).agg(F.sum("n").alias("n"), F.count(F.when(some, F.lit(1))).alias("m"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_file.agg(F.count(F.lit(1)).alias("data_objects"), zero("n").alias("records"), zero("m").alias("markers"))
