"""Small pieces shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java character class body: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, as a URI that Spark and ``filesystem`` read alike.

    A path without a scheme belongs to the default file system, as it does for
    Spark.  Where no folder is set, one is made on a local master (tests); a
    cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _test_folder()
        spark.sparkContext.setCheckpointDir(found)
    if "://" not in found and not found.startswith("file:"):
        found = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + os.path.abspath(found)
    return found.rstrip("/")


_scratch: list[str] = []


@atexit.register
def _remove_scratch() -> None:
    """What this driver's queries left in the shared folder goes when it ends."""
    from tidemark.llm.zip_ranges import filesystem

    for uri in _scratch:
        with contextlib.suppress(OSError):  # gone already
            fs, at = filesystem(uri)
            fs.delete_dir(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder, removed when the driver ends."""
    uri = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(uri)
    return uri


#: Whether Spark removes an execution's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here.

    The shuffles that led up to it are not needed any more, and their files
    go at once.
    """
    spark = df.sparkSession
    shared = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame made while the setting holds
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is.

    ``lower`` is much faster than ``translate``; it is used where the text
    has only ASCII characters, for which both agree.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


class Sealed:
    """A table whose columns are found by exact name and place, whatever the others are called.

    ``df`` has the columns asked for, under the names of the keywords, and the
    whole row in the struct ``d``.  Names with dots, names of columns that an
    operator makes for itself and names that differ in case do no harm.  Of
    columns that bear one name, the first counts.
    """

    def __init__(self, docs: DataFrame, keep: bool = True, **wanted: str) -> None:
        self.names = docs.columns
        flat = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        missing = [n for n in wanted.values() if n not in self.names]
        if missing:
            raise ValueError(f"the table has no column {missing[0]!r}")
        own = [F.col(f"c{self.names.index(n)}").alias(k) for k, n in wanted.items()]
        self.df = flat.select(*own, *([F.struct(*flat.columns).alias("d")] if keep else []))

    def open(self, also: Sequence[Column | str] = (), **changed: Column) -> list[Column | str]:
        """The table's own columns out of ``d`` for a select, some of them changed."""
        return [changed.get(n, F.col("d")[f"c{i}"]).alias(n) for i, n in enumerate(self.names)] + list(also)


def pick(docs: DataFrame, **wanted: str) -> DataFrame:
    """The columns asked for, by exact name, under the names of the keywords."""
    return Sealed(docs, keep=False, **wanted).df


def row_key(row: str = "d") -> Column:
    """A hash of a whole row, by which rows equal in id and text are put in order."""
    return F.xxhash64(F.to_json(row))
