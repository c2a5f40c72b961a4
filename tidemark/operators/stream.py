"""The change stream: refs in time order, gated by commits.

``refs`` has ref_key, ref_micro_ts, token, attempt_id, partition; ``commits``
has partition, token, attempt_id, inserted_at_us, row_count.  Both are a row
per write, far smaller than data, and no row of data is read to page through
them.  A ref passes if the commit of its (partition, token) names its attempt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.keys import REFS, offset_at, parse_ref_key, ref_key


def first_commits(commits: DataFrame) -> DataFrame:
    """One row for each (partition, token): a repaired log may repeat some."""
    return commits.dropDuplicates(["partition", "token"])


def gate(data: DataFrame, commits: DataFrame, partition: str = "partition", token: str = "token", attempt: str = "attempt_id") -> DataFrame:
    """Rows of committed attempts, each once: a semi-join.

    A lone attempt that its commit does not name is left out, as the stream
    does; that is stricter than to keep it.
    """
    c = first_commits(commits).select(F.col("partition").alias(partition), F.col("token").alias(token), F.col("attempt_id").alias(attempt))
    return data.join(c, [partition, token, attempt], "left_semi")


def with_ref_keys(writes: DataFrame) -> DataFrame:
    key = ref_key(F.col("ref_micro_ts"), F.col("token"), F.col("attempt_id"), F.col("partition"))
    return writes.select(key.alias("ref_key"), "ref_micro_ts", "token", "attempt_id", "partition")


def decode_refs(names: DataFrame, name: str = "ref_key") -> DataFrame:
    """Names of refs with their fields; malformed names keep null fields."""
    return names.withColumn("__r", parse_ref_key(F.col(name))).select(F.col(name).alias("ref_key"), "__r.*")


def visible(refs: DataFrame, since: str = "", until: str = "", cutoff_us: int | None = None) -> DataFrame:
    """since < ref_key < until, and stamped before the cutoff.

    The bounds are also put on the stamp, which Parquet statistics prune by.
    """
    key = F.col("ref_key")
    conditions: list[Column] = []
    if since:
        conditions.append(key > since)
    if until:
        conditions.append(key < until)
    if cutoff_us is not None:
        conditions.append(key <= offset_at(cutoff_us))
    for text, low in ((since, True), (until, False)):
        digits = text.removeprefix(REFS)[:16]
        if len(digits) == 16 and digits.isdigit():
            us = F.col("ref_micro_ts")
            conditions.append(us.isNull() | ((us >= int(digits)) if low else (us <= int(digits))))
    if cutoff_us is not None:
        conditions.append(F.col("ref_micro_ts").isNull() | (F.col("ref_micro_ts") < cutoff_us))
    for c in conditions:
        refs = refs.where(c)
    return refs


def passing(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """``refs`` with ``passes`` and the commit's row_count."""
    c = first_commits(commits).select("partition", "token", F.col("attempt_id").alias("__a"), "row_count")
    df = refs.join(c, ["partition", "token"], "left")
    return df.withColumn("passes", F.coalesce(F.col("__a") == F.col("attempt_id"), F.lit(False))).drop("__a")


def entries(passed: DataFrame, data_path: Column | None = None) -> DataFrame:
    """Stream entries: offset, key, data_path, ref_path, inserted_at, row_count, and the attempt."""
    name = F.concat(F.col("token"), F.lit("-"), F.col("attempt_id"))
    path = data_path if data_path is not None else F.concat(F.lit("data/"), F.col("partition"), F.lit("/"), name, F.lit(".parquet"))
    return passed.select(
        F.col("ref_key").alias("offset"),
        F.col("partition").alias("key"),
        path.alias("data_path"),
        F.col("ref_key").alias("ref_path"),
        F.timestamp_micros("ref_micro_ts").alias("inserted_at"),
        "row_count",
        "token",
        "attempt_id",
    )


@dataclass(frozen=True)
class Page:
    entries: DataFrame
    next_offset: str


def poll(refs: DataFrame, commits: DataFrame, since: str = "", max_entries: int = 1000, until: str = "", cutoff_us: int | None = None) -> Page:
    """The next passing refs after ``since``, at most ``max_entries``, and where to go on.

    The page is found in two steps that each keep only a bounded number of
    rows: the last of the first ``max_entries`` passing refs, then the visible
    refs up to it.  Refs that do not pass move the offset too; those after the
    last one of a full page do not.
    """
    if max_entries <= 0:
        raise ValueError("max_entries must be positive")
    seen = passing(visible(refs, since, until, cutoff_us), commits)
    first = seen.where("passes").select("ref_key").orderBy("ref_key").limit(max_entries)
    n, last = first.agg(F.count(F.lit(1)), F.max("ref_key")).first()
    if n < max_entries:
        # refs alone tell how far the page went
        last = visible(refs, since, until, cutoff_us).agg(F.max("ref_key")).first()[0]
        if last is None:
            return Page(entries(seen.where("passes")).orderBy("offset"), since)
    # the page's own plan reads refs up to its end only
    page = passing(visible(refs, since, "", cutoff_us).where(F.col("ref_key") <= last), commits).where("passes")
    return Page(entries(page).orderBy("offset"), last)


def poll_range(refs: DataFrame, commits: DataFrame, since: str = "", until: str = "", cutoff_us: int | None = None) -> DataFrame:
    """All passing entries of a window, in order, with no pages."""
    return entries(passing(visible(refs, since, until, cutoff_us), commits).where("passes")).orderBy("offset")


def running_page(refs: DataFrame, commits: DataFrame, max_entries: int) -> DataFrame:
    """The visited refs of a page by their running count; for tests of ``poll`` on small inputs."""
    w = Window.orderBy("ref_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = passing(refs, commits).withColumn("p", F.col("passes").cast("int"))
    return df.withColumn("before", F.sum("p").over(w) - F.col("p")).where(F.col("before") < max_entries)


def records_of(found: DataFrame, data: DataFrame, partition: str = "partition", token: str = "token", attempt: str = "attempt_id") -> DataFrame:
    """The rows of entries' data, once for each entry: an inner join, so a restamped write comes twice."""
    e = found.select(F.col("key").alias(partition), F.col("token").alias(token), F.col("attempt_id").alias(attempt))
    return data.join(e, [partition, token, attempt], "inner")


def partition_keys(found: DataFrame) -> DataFrame:
    """Distinct, ascending."""
    return found.select("key").distinct().orderBy("key")


def common_partitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Partition keys that both have; reads of each can then be joined by key."""
    return partition_keys(a).intersect(partition_keys(b))
