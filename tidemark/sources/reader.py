"""Snapshot, range and stream reads."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import keys, patterns
from tidemark.operators import batches, stream, views
from tidemark.operators.dedup import dedup, order_of, ordered
from tidemark.operators.projection import zero_fill
from tidemark.sources.config import StoreConfig, Timing, load_timing
from tidemark.sources.log import Logs
from tidemark.sources.views import add_tuples, tuples_of
from tidemark.sources.observe import measured, watched

KEY, TIE = "__hive_key", ("__commit", "__file", "__row")
#: Beyond so many partitions a read lists the whole tree, in parallel, instead of each folder.
MOST_FOLDERS = 10_000
#: Bytes of rows in a task of an iterator, which the driver holds and fetches ahead.
READ_AHEAD = 8 << 20
#: Tasks of an iterator at most; beyond, each has more rows.
MOST_TASKS = 10_000

#: What is made on executors of a piece of a partition: key, number of the piece, its rows as Arrow batches.
Run = Callable[[str, int, Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]


class ForeignEntry(ValueError):
    """An entry's data lie outside this dataset."""


class Reader:
    """``ordered=True`` asks for the contractual order: whole key, entity, version.

    Iterators bring all rows to the driver.  ``run_...`` and ``read_numbered``
    do the same on executors: for what is larger than one machine should see.
    """

    def __init__(self, spark: SparkSession, config: StoreConfig, timing: Timing | None = None, read_ahead: int = READ_AHEAD) -> None:
        self.spark, self.config, self.read_ahead = spark, config, read_ahead
        self.timing = timing or load_timing(spark, config.root)
        self.logs = Logs(spark, config)
        self.counters: Counter[str] = Counter()

    def narrow(self, schema: T.StructType, entity: Sequence[str] | None = None, version: str | None = None) -> Reader:
        """Another reader of the same dataset that reads only ``schema``'s columns."""
        entity = self.config.entity if entity is None else entity
        return Reader(self.spark, self.config.narrow(schema, entity=entity, version=(version or self.config.version) if entity else None), self.timing, self.read_ahead)

    def with_read_ahead(self, size: int) -> Reader:
        """The same reader, whose iterators hold and fetch ahead about ``size`` bytes at a time.

        It has a session of its own, so other queries keep their partition sizes.
        """
        session = self.spark.newSession()
        for name in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
            session.conf.set(name, str(size))
        session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        return Reader(session, self.config, self.timing, size)

    # scans ----------------------------------------------------------------

    def _parts(self) -> dict[str, Column]:
        return {p: F.col(f"__pk_{p}") for p in self.config.parts}

    def _folders(self, partitions: DataFrame | None) -> list[str]:
        """The folders to list: those of ``partitions`` (a column of keys), or the whole tree if they are none or very many.

        Partitions are counted in folders, as any listing does; no data is read.
        """
        base = self.config.path("data")
        whole = [base] if self.logs.files.exists(base) else []
        if partitions is None or not whole:
            return whole
        found = partitions.distinct().limit(MOST_FOLDERS + 1).collect()
        if len(found) > MOST_FOLDERS:
            return whole
        folders = [keys.data_folder(base, r[0], "", "").rpartition("/")[0] for r in found]
        there = self.logs.files.there(folders)
        self.counters.update(folders=len(there), missing_folders=len(folders) - len(there))
        return there

    def _scan(self, tolerant: bool, partitions: DataFrame | None = None) -> DataFrame:
        """All written rows of ``partitions``, committed or not, with path columns, each row's place and its file's time."""
        c = self.config
        fields = [T.StructField(f"__pk_{p}", T.StringType()) for p in c.parts] + [T.StructField("__commit", T.StringType())]
        schema = T.StructType([*c.schema.fields, *fields])
        folders = self._folders(partitions)
        if not folders:
            df = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType()), T.StructField("__changed", T.TimestampType())]))
        else:
            read = self.spark.read.schema(schema).option("ignoreMissingFiles", str(tolerant).lower()).option("basePath", c.path("data"))
            df = read.parquet(*folders).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"), F.col("_metadata.file_modification_time").alias("__changed"))
        return df.withColumn(KEY, keys.hive_key(self._parts()))

    def _commits(self, found: Sequence[str]) -> DataFrame:
        """The commits of partitions that any pattern meets; the log is cut down before it is made distinct."""
        of = keys.key_values(F.col("partition"), list(self.config.parts))
        return self.logs.commits(patterns.predicate(found, of))

    def _commit_names(self, commits: DataFrame) -> DataFrame:
        return commits.select(F.col("partition").alias(KEY), keys.commit_name(F.col("token"), F.col("attempt_id")).alias("__commit"))

    def _picked(self, df: DataFrame, history: bool) -> DataFrame:
        c = self.config
        return dedup(zero_fill(df, c.schema, c.optional, (KEY, *TIE)), [KEY], list(c.entity), c.version, history, TIE)

    def _named(self, df: DataFrame, keep_key: bool) -> DataFrame:
        return df.select(*([F.col(KEY).alias("hive_key")] if keep_key else []), *self.config.schema.names)

    def _finish(self, df: DataFrame, history: bool, in_order: bool, keep_key: bool = False) -> DataFrame:
        df = self._picked(df, history)
        if in_order:
            df = ordered(df, KEY, list(self.config.entity), self.config.version, TIE)
        return self._named(df, keep_key)

    def _pieces(self, df: DataFrame, history: bool, keep_key: bool = False, tasks: int | None = None) -> DataFrame:
        """In the contractual order, a range of it in each task."""
        c = self.config
        order = order_of(KEY, list(c.entity), c.version, () if c.entity else TIE)  # where there is an entity no two rows are alike in it
        return self._named(batches.in_pieces(self._picked(df, history), order, tasks), keep_key)

    def _bounded(self, df: DataFrame, log: DataFrame, history: bool, keep_key: bool = False) -> DataFrame:
        """For iterators: tasks of about ``read_ahead`` bytes, by the rows that ``log`` tells of and the size of the files."""
        rows = (log.agg(F.sum("row_count")).first()[0] if "row_count" in log.columns else None) or 0
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        files = [x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
        size = max(rows * df._jdf.schema().defaultSize(), sum(x.stats().sizeInBytes() for x in files))
        return self._pieces(df, history, keep_key, max(1, min(MOST_TASKS, math.ceil(size / self.read_ahead))))

    def _snapshot(self, found: Sequence[str], tolerant: bool = False) -> DataFrame:
        commits = self._commits(found)
        every = all(s.kind == "any" for p in patterns.parse_all(found, list(self.config.parts)) for s in p) and len(found) > 0
        scan = self._scan(tolerant, None if every else commits.select("partition")).where(patterns.predicate(found, self._parts()))
        return scan.join(self._commit_names(commits), [KEY, "__commit"], "left_semi")

    @measured
    def read(self, found: Sequence[str], history: bool = False, ordered: bool = False) -> DataFrame:
        """Committed rows of the partitions that any pattern meets; the latest of each entity, or its history."""
        return self._finish(self._snapshot(found), history, ordered)

    @measured
    def read_iter(self, found: Sequence[str], history: bool = False, read_ahead: bool = True, stall_after: float | None = None) -> Iterator[Row]:
        """Rows in order; ``stall_after`` seconds without one count as a stall and warn."""
        rows = self._bounded(self._snapshot(found), self._commits(found), history).toLocalIterator(prefetchPartitions=read_ahead)
        return watched(rows, self.counters, stall_after) if stall_after else rows

    def _grouped(self, df: DataFrame, log: DataFrame, history: bool) -> Iterator[tuple[str, list[Row]]]:
        for key, rows in batches.partitions(self._bounded(df, log, history, keep_key=True)):
            yield key, [Row(**{k: v for k, v in r.asDict().items() if k != "hive_key"}) for r in rows]

    @measured
    def read_partitions(self, found: Sequence[str], history: bool = False) -> DataFrame:
        """(key, rows) of each partition as one row."""
        df = self._finish(self._snapshot(found), history, False, keep_key=True)
        order = [*self.config.entity, *([self.config.version] if self.config.version else [])]
        return batches.group_by_partition(df, F.col("hive_key"), order).select("key", F.transform("rows", lambda x: F.struct(*[x[n].alias(n) for n in self.config.schema.names])).alias("rows"))

    @measured
    def read_partition_iter(self, found: Sequence[str], history: bool = False) -> Iterator[tuple[str, list[Row]]]:
        return self._grouped(self._snapshot(found), self._commits(found), history)

    @measured
    def read_numbered(self, found: Sequence[str], folder: str, history: bool = False) -> DataFrame:
        """Rows with ``place``, their number in the order of ``read_iter``.

        The rows are stored in ``folder``, which must be new and shared with the executors, so that all places are of one sort.
        """
        batches.with_places(self._pieces(self._snapshot(found), history)).write.parquet(folder)
        return batches.numbered(self.spark.read.parquet(folder))

    @measured
    def run_partitions(self, found: Sequence[str], run: Run, schema: T.StructType | str, history: bool = False) -> DataFrame:
        """``read_partition_iter`` on executors: what ``run`` makes of each piece of each partition, see ``batches.run_pieces``."""
        return batches.run_pieces(self._pieces(self._snapshot(found), history, True), run, schema)

    # stream ---------------------------------------------------------------

    def cutoff_us(self, now: datetime | None = None) -> int:
        """Refs stamped before this are settled; taken once, when asked."""
        return keys.micros((now or self.config.clock()) - self.timing.settle)

    def offset_at(self, t: datetime) -> str:
        return keys.offset_at(t)

    def _refs(self) -> DataFrame:
        return self.logs.refs()

    def _path(self, partition: str = "partition") -> Column:
        return keys.data_folder_of(self.config.path("data"), F.col(partition), F.col("token"), F.col("attempt_id"))

    def _entries(self, since: str, until: str, cutoff: int) -> DataFrame:
        found = stream.poll_range(self._refs(), self.logs.commits(), since, until, cutoff)
        return found.withColumn("data_path", self._path("key"))

    @measured
    def poll(self, since: str = "", max_entries: int = 1000, until: str = "") -> stream.Page:
        """A page of entries after ``since`` and the offset to go on from."""
        page = stream.poll(self._refs(), self.logs.commits(), since, max_entries, until, self.cutoff_us())
        return stream.Page(page.entries.withColumn("data_path", self._path("key")), page.next_offset)

    @measured
    def poll_records(self, since: str = "", max_entries: int = 1000, until: str = "") -> tuple[DataFrame, str]:
        """The records of a page, every version of each entity; the offset moves over refs without records."""
        page = self.poll(since, max_entries, until)
        return self._finish(self._records(page.entries), True, False), page.next_offset

    @measured
    def poll_range(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """All entries of [since, until); open ends are the first ref and the settled tip at the call."""
        low, high, cutoff = self._bounds(since, until)
        return self._entries(low, high, cutoff)

    def _bounds(self, since: datetime | None, until: datetime | None) -> tuple[str, str, int]:
        cutoff = self.cutoff_us()
        return keys.offset_at(since) if since else "", keys.offset_at(until) if until else keys.offset_at(cutoff), cutoff

    def _records(self, found: DataFrame) -> DataFrame:
        names = found.select(F.col("key").alias(KEY), keys.commit_name(F.col("token"), F.col("attempt_id")).alias("__commit"))
        return self._scan(True, found.select("key")).join(names, [KEY, "__commit"])

    @measured
    def read_range(self, since: datetime | None = None, until: datetime | None = None, history: bool = False, ordered: bool = False) -> DataFrame:
        return self._finish(self._records(self.poll_range(since, until)), history, ordered)

    @measured
    def read_range_iter(self, since: datetime | None = None, until: datetime | None = None, history: bool = False, read_ahead: bool = True) -> Iterator[Row]:
        found = self.poll_range(since, until)
        return self._bounded(self._records(found), found, history).toLocalIterator(prefetchPartitions=read_ahead)

    @measured
    def read_partition_range_iter(self, since: datetime | None = None, until: datetime | None = None, history: bool = False) -> Iterator[tuple[str, list[Row]]]:
        found = self.poll_range(since, until)
        return self._grouped(self._records(found), found, history)

    @measured
    def run_partition_range(self, run: Run, schema: T.StructType | str, since: datetime | None = None, until: datetime | None = None, history: bool = False) -> DataFrame:
        return batches.run_pieces(self._pieces(self._records(self.poll_range(since, until)), history, True), run, schema)

    def _own(self, found: DataFrame) -> DataFrame:
        base = self.config.path("data") + "/"
        if (foreign := found.where(~F.col("data_path").startswith(base)).select("data_path").head(1)):
            raise ForeignEntry(f"{foreign[0][0]} does not lie under {base}")
        return found

    @measured
    def read_entries(self, found: DataFrame, history: bool = False, ordered: bool = False) -> DataFrame:
        """The records of entries that were polled before."""
        return self._finish(self._records(self._own(found)), history, ordered)

    @measured
    def read_entries_iter(self, found: DataFrame, history: bool = False, read_ahead: bool = True) -> Iterator[Row]:
        return self._bounded(self._records(self._own(found)), found, history).toLocalIterator(prefetchPartitions=read_ahead)

    @measured
    def read_partition_entries_iter(self, found: DataFrame, history: bool = False) -> Iterator[tuple[str, list[Row]]]:
        return self._grouped(self._records(self._own(found)), found, history)

    @measured
    def run_partition_entries(self, found: DataFrame, run: Run, schema: T.StructType | str, history: bool = False) -> DataFrame:
        return batches.run_pieces(self._pieces(self._records(self._own(found)), history, True), run, schema)


class ViewReader:
    """Looks up a view's tuples; neither data nor commits are read."""

    def __init__(self, spark: SparkSession, config: StoreConfig, view: views.View, bind=None) -> None:
        self.spark, self.config, self.view, self.bind = spark, config, view, bind

    def lookup(self, found: Sequence[str]) -> DataFrame:
        tuples = tuples_of(self.spark, self.config, self.view)
        return views.lookup(tuples, self.view.columns, found, self.bind, self.view.layouts)


def backfill(spark: SparkSession, config: StoreConfig, view: views.View, found: Sequence[str], until: datetime | None = None, timing: Timing | None = None) -> Row:
    """Adds the tuples of data files made before ``until``; returns data_objects, records, markers."""
    view.check(config.schema)
    rows = Reader(spark, config, timing)._snapshot(found, tolerant=True)
    if until is not None:  # by when the file was made, whatever the write says of its time
        rows = rows.where(F.col("__changed") < F.timestamp_micros(F.lit(keys.micros(until))))
    filled = zero_fill(rows, config.schema, config.optional, (KEY, "__commit"))
    value = lambda c: (view.of or {}).get(c, F.col(c))
    text = {c: F.date_format(value(c), view.layouts[c]) if c in view.layouts else value(c).cast("string") for c in view.columns}
    ok = F.lit(True) if view.where is None else F.coalesce(view.where, F.lit(False))
    tuples = filled.select(F.concat(KEY, F.lit("/"), "__commit").alias("__object"), *[F.when(ok, x).alias(f"v_{c}") for c, x in text.items()])
    stats = views.backfill_stats(tuples, "__object", [f"v_{c}" for c in view.columns]).first()
    add_tuples(spark, config, view, views.distinct_tuples(filled, view))
    return stats
