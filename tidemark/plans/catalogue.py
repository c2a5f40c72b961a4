"""Queries by name, each with equivalent SQL."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import keys, patterns
from tidemark.functions.durations import parse_duration
from tidemark.operators import batches, stream, views
from tidemark.operators.dedup import history, latest
from tidemark.operators.projection import zero_fill
from tidemark.sources.config import StoreConfig, Timing, load_timing, write_timing
from tidemark.sources.reader import backfill
from tidemark.sources.store import Store
from tidemark.sources.views import tuples_of
from tidemark.sources.writer import CommitAfterTimeout
from tidemark.streaming.source import process_entries, read_changes, with_records

PARTS = ["day", "event_type"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return df.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("ver", F.unix_micros(F.col("ts").cast("timestamp")))


def _cols() -> dict:
    return {p: F.col(p) for p in PARTS}


def _key():
    return keys.hive_key(_cols())


def _matching(df: DataFrame, *found: str) -> DataFrame:
    return df.where(patterns.predicate(found, _cols()))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write for each (day, event_type), stamped with its last event."""
    token = F.concat(F.lit("batch-"), F.col("day"), F.lit("-"), F.col("event_type"))
    df = _events(spark, sf_dir).groupBy("day", "event_type").agg(F.max("ver").alias("ref_micro_ts"), F.count(F.lit(1)).alias("row_count"))
    return df.withColumn("token", token).withColumn("attempt_id", F.md5(token)).withColumn("partition", _key())


def _commits(writes: DataFrame) -> DataFrame:
    return writes.select("partition", "token", "attempt_id", "ref_micro_ts", F.col("ref_micro_ts").alias("inserted_at_us"), "row_count")


def _refs(writes: DataFrame) -> DataFrame:
    return stream.with_ref_keys(writes)


def _rows_of(spark: SparkSession, sf_dir: str, writes: DataFrame) -> DataFrame:
    """Events with the write that holds them."""
    df = _events(spark, sf_dir).withColumn("partition", _key())
    token = F.concat(F.lit("batch-"), F.col("day"), F.lit("-"), F.col("event_type"))
    return df.withColumn("token", token).withColumn("attempt_id", F.md5(token))


def _key_parts(df: DataFrame, key: str = "key") -> DataFrame:
    return df.withColumn("day", F.regexp_extract(key, "day=([^/]*)", 1)).withColumn("event_type", F.regexp_extract(key, "event_type=([^/]*)", 1))


DAY10, DAY15, DAY20 = (keys.offset_at(datetime(2024, 1, d)) for d in (10, 15, 20))


def scan_all(s, d):
    return _matching(_events(s, d), "*").select("event_id", "day", "event_type", "user_id", "value")


def pattern_exact(s, d):
    return _matching(_events(s, d), "day=2024-01-05/event_type=click").select("event_id", "day", "event_type")


def pattern_prefix(s, d):
    return _matching(_events(s, d), "day=2024-01-1*/event_type=view").select("event_id", "day", "event_type")


def pattern_range(s, d):
    return _matching(_events(s, d), "day=2024-01-05..2024-01-15/*").select("event_id", "day")


def pattern_range_open(s, d):
    return _matching(_events(s, d), "day=2024-01-20../event_type=..error").select("event_id", "day", "event_type")


def pattern_wild_head(s, d):
    return _matching(_events(s, d), "*/event_type=signup").select("event_id", "day")


def pattern_multi(s, d):
    return _matching(_events(s, d), "day=2024-01-05/event_type=click", "day=2024-01-06/event_type=view").select("event_id", "day", "event_type")


def pattern_overlap(s, d):
    return _matching(_events(s, d), "day=2024-01-01..2024-01-15/*", "day=2024-01-10..2024-01-20/*").select("event_id", "day")


def read_latest(s, d):
    df = _matching(_events(s, d), "day=2024-01-05..2024-01-15/event_type=click")
    return latest(df, PARTS, ["user_id"], "ver").select("day", "event_type", "user_id", "ts", "value")


def read_latest_all(s, d):
    return latest(_events(s, d), PARTS, ["user_id"], "ver").select("day", "event_type", "user_id", "event_id", "value")


def _lineitem(s, d):
    df = _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return df.withColumn("ship_month", F.date_format("l_shipdate", "yyyy-MM")).withColumn("ver", F.unix_micros(F.col("l_shipdate").cast("timestamp")))


def read_history(s, d):
    return history(_lineitem(s, d).drop("l_shipdate"), ["ship_month"], ["l_orderkey", "l_linenumber"], "ver").select("ship_month", "l_orderkey", "l_linenumber", "ver")


def latest_spanning_entities(s, d):
    return latest(_lineitem(s, d).drop("l_shipdate"), ["ship_month"], ["l_orderkey", "l_linenumber"], "ver").select("ship_month", "l_orderkey", "l_linenumber", "ver")


def latest_tie_last(s, d):
    df = _table(s, d, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM")).withColumn("ver", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return latest(df, ["period"], ["o_custkey"], "ver", ["o_orderkey"]).select("period", "o_custkey", "o_orderkey", "o_totalprice")


def group_by_partition(s, d):
    return batches.partition_counts(_events(s, d), _key())


def partition_batches(s, d):
    rows = latest(_events(s, d), PARTS, ["user_id"], "ver").select("day", "event_type", "user_id", "ver")
    found = batches.group_by_partition(rows, _key(), ["user_id", "ver"])
    return found.select(F.col("key").alias("hive_key"), F.size("rows").cast("long").alias("n_rows"), F.col("rows")[0]["user_id"].alias("first_entity"))


def narrow_read(s, d):
    """Another reader of a stored dataset, which reads two columns."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())])
    return _loaded(s, d).reader.narrow(schema, entity=[]).read(["*"])


def zero_fill_query(s, d):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType())])
    return zero_fill(_table(s, d, "events").select("event_id"), schema)


def commit_gate(s, d):
    w = _writes(s, d)
    return stream.gate(_rows_of(s, d, w), _commits(w.where("event_type <> 'error'"))).select("event_id", "day")


def commit_gate_attempts(s, d):
    w = _writes(s, d)
    rows = _rows_of(s, d, w)
    again = lambda n: rows.withColumn("attempt", F.lit(n)).withColumn("attempt_id", F.md5(F.concat("token", F.lit(n))))
    commits = _commits(w.withColumn("attempt_id", F.md5(F.concat("token", F.lit("second")))))
    return stream.gate(again("first").unionByName(again("second")), commits).select("event_id", "attempt")


def poll_all(s, d):
    w = _writes(s, d)
    found = stream.poll_range(_refs(w), _commits(w))
    ref_id = F.concat(F.substring("offset", len(keys.REFS) + 1, 17), F.col("token"), F.lit("-"), F.col("attempt_id"))
    return found.select(ref_id.alias("ref_id"), "row_count")


def poll_window(s, d):
    w = _writes(s, d)
    return _key_parts(stream.poll_range(_refs(w), _commits(w), DAY10, DAY20)).select("day", "event_type", "row_count")


def poll_settle(s, d):
    w = _writes(s, d)
    cutoff = keys.micros(datetime(2024, 1, 20) - timedelta(seconds=16))
    return _key_parts(stream.poll_range(_refs(w), _commits(w), cutoff_us=cutoff)).select("day", "event_type")


def poll_page(s, d):
    w = _writes(s, d)
    found = stream.poll(_refs(w), _commits(w), max_entries=7).entries
    return found.select("token", F.unix_micros("inserted_at").alias("ref_micro_ts"))


def poll_gated(s, d):
    w = _writes(s, d)
    return stream.poll(_refs(w), _commits(w.where("event_type <> 'error'")), max_entries=7).entries.select("token")


def poll_records(s, d):
    w = _writes(s, d)
    found = stream.poll_range(_refs(w), _commits(w), DAY10, DAY20)
    rows = stream.records_of(found, _rows_of(s, d, w))
    return history(rows, PARTS, ["event_id"], "ver").select("event_id", "day")


def range_latest(s, d):
    w = _writes(s, d)
    rows = stream.records_of(stream.poll_range(_refs(w), _commits(w), until=DAY15), _rows_of(s, d, w))
    return latest(rows, PARTS, ["user_id"], "ver").select("day", "event_type", "user_id", "value")


def restamp_bag(s, d):
    w = _writes(s, d)
    again = w.where("event_type = 'click'").withColumn("ref_micro_ts", F.col("ref_micro_ts") + 1)
    found = stream.poll_range(_refs(w).unionByName(_refs(again)), _commits(w))
    return stream.records_of(found, _rows_of(s, d, w)).select("event_id")


def partition_keys(s, d):
    w = _writes(s, d)
    return stream.partition_keys(stream.poll_range(_refs(w), _commits(w)))


def partition_intersect(s, d):
    w = _writes(s, d)
    found = _key_parts(stream.poll_range(_refs(w), _commits(w)))
    only = lambda df: df.select(F.col("day").alias("key"))
    return stream.common_partitions(only(found.where("event_type = 'click'")), only(found.where("event_type = 'purchase' AND row_count > 60"))).select(F.col("key").alias("day"))


def _user_view(**more):
    return views.View("users", ("event_type", "user_id"), {"event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")}, **more)


def view_distinct(s, d):
    return views.distinct_tuples(_events(s, d), _user_view())


def view_lookup(s, d):
    v = views.View("days", ("event_type", "day"))
    return views.lookup(views.distinct_tuples(_events(s, d), v), v.columns, ["event_type=view/day=2024-01-10..2024-01-20"])


def view_time_layout(s, d):
    v = views.View("months", ("month", "o_orderstatus"), {"month": F.col("o_orderdate"), "o_orderstatus": F.col("o_orderstatus")}, layouts={"month": "yyyy-MM"})
    return views.distinct_tuples(_table(s, d, "orders"), v)


def view_skip(s, d):
    return views.distinct_tuples(_events(s, d), _user_view(where=F.col("value") >= 150))


def view_lossy_bind(s, d):
    v = _user_view()
    return views.lookup(views.distinct_tuples(_events(s, d), v), v.columns, ["*"], lambda df: df.select("event_type"))


def backfill_stats(s, d):
    df = _events(s, d).select(_key().alias("object"), F.col("user_id").cast("string").alias("u"))
    return views.backfill_stats(df, "object", ["u"])


# through a store ------------------------------------------------------------


def _shared(spark: SparkSession) -> str:
    """A fresh folder where the cluster shares files; a local master without one makes its own (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


class Clock:
    """Time that stands still until it is set."""

    def __init__(self, now: datetime = datetime(2024, 2, 1)) -> None:
        self.now = now

    def __call__(self) -> datetime:
        return self.now


COLUMNS = ["event_id", "day", "event_type", "user_id", "value", "ver"]
DAYS_VIEW = views.View("days", ("event_type", "day"))


def _store(s: SparkSession, d: str, clock: Clock | None = None, **more) -> Store:
    kind = _events(s, d).select(*COLUMNS).schema
    schema = T.StructType([*kind.fields, *([T.StructField("inserted_at", T.TimestampType())] if more.get("inserted_at") else [])])
    about = {"parts": {p: p for p in PARTS}, "entity": ["event_id"], "version": "ver", "clock": clock or Clock()} | more
    return Store(s, StoreConfig(_shared(s), schema, **about), Timing(timedelta(seconds=10), timedelta(seconds=6)))


#: Events are written in three parts, at these times.
WRITES = (("one", "day=..2024-01-11/*", datetime(2024, 2, 1)), ("two", "day=2024-01-11..2024-01-21/*", datetime(2024, 2, 2)), ("three", "day=2024-01-21../*", datetime(2024, 2, 3)))
_stores: dict[tuple[str, str], Store] = {}


def _loaded(s: SparkSession, d: str) -> Store:
    """All events, written in three parts; made once for each session and read by several queries."""
    at = (s.sparkContext.applicationId, d)
    if at not in _stores:
        clock = Clock()
        store = _store(s, d, clock, views=[DAYS_VIEW])
        for token, found, clock.now in WRITES:
            store.write(_matching(_events(s, d), found), token=token)
        clock.now = datetime(2024, 2, 5)
        _stores[at] = store
    return _stores[at]


def idempotent_retry(s, d):
    store, rows = _store(s, d), _events(s, d)
    first = store.write(rows, token="load-1")
    if store.write(rows, token="load-1") != first:
        raise AssertionError("a retry returns the first result")
    return store.read(["*"]).select("event_id")


def inserted_at_column(s, d):
    store = _store(s, d, inserted_at="inserted_at")
    store.write(_events(s, d), inserted_at=datetime(2024, 2, 1))
    return store.read(["*"]).select("event_id", F.col("inserted_at").cast("timestamp_ntz").alias("inserted_at"))


def write_results(s, d):
    """Results of a write of all events, one for each partition, in order."""
    found = _store(s, d).write(_events(s, d))
    rows = [(k, r.ref_path.split(";")[1].removesuffix(".ref").replace("%2F", "/"), r.row_count) for k, r in enumerate(found)]
    return s.createDataFrame(rows, "place long, hive_key string, row_count long")


def store_commits(s, d):
    """The log of a real write, one commit per partition."""
    store = _store(s, d)
    store.write(_events(s, d), token="load-1")
    return store.logs.commits().select(F.col("partition").alias("hive_key"), "row_count")


def store_latest(s, d):
    """Latest rows of a dataset written twice, the second time with the values of 100 and more changed."""
    store, rows = _store(s, d), _events(s, d)
    store.write(rows, token="one")
    store.write(rows.where("value >= 100").withColumn("value", F.col("value") * 2).withColumn("ver", F.col("ver") + 1), token="two")
    return store.read(["*"]).select("event_id", "day", "value")


def store_pattern(s, d):
    return _loaded(s, d).read(["day=2024-01-05..2024-01-15/event_type=click", "day=2024-01-2*/*"]).select("event_id", "day")


def store_ordered(s, d):
    """Every row with its place in the contractual order, as the iterator would give them, numbered on executors."""
    store = _loaded(s, d)
    narrow = T.StructType([f for f in store.config.schema if f.name in ("event_id", "ver")])
    return store.reader.narrow(narrow).read_numbered(["*"], _shared(s)).select("place", "event_id")


def store_early_stop(s, d):
    """The first ten rows; the iterator is left there."""
    return s.createDataFrame([(r.event_id,) for r in itertools.islice(_loaded(s, d).read_iter(["*"]), 10)], "event_id long")


def store_partitions(s, d):
    found = _loaded(s, d).read_partitions(["*"])
    return found.select(F.col("key").alias("hive_key"), F.size("rows").cast("long").alias("n_rows"), F.col("rows")[0]["event_id"].alias("first_event"))


PIECES = "hive_key string, piece long, n_rows long, first_event long"


def _count(key, piece, rows):
    """Rows of a piece of a partition, and its first event."""
    n, first = 0, None
    for batch in rows:
        first = batch.column("event_id")[0].as_py() if first is None else first
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), *(pa.array([x], pa.int64()) for x in (piece, n, first))], ["hive_key", "piece", "n_rows", "first_event"])


def _merged(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("hive_key").agg(F.sum("n_rows").alias("n_rows"), F.min_by("first_event", "piece").alias("first_event"))


def store_partition_iter(s, d):
    """Partitions read in order on executors, piece by piece."""
    return _merged(_loaded(s, d).run_partitions(["*"], _count, PIECES))


def store_range(s, d):
    """Records of the writes of [second, third)."""
    return _loaded(s, d).read_range(WRITES[1][2], WRITES[2][2]).select("event_id", "day")


def store_range_tip(s, d):
    """Records of all writes up to the settled tip, which stands from the call on."""
    return _loaded(s, d).read_range(WRITES[1][2]).select("event_id")


def store_range_partitions(s, d):
    return _merged(_loaded(s, d).run_partition_range(_count, PIECES, WRITES[1][2]))


def store_entries(s, d):
    store = _loaded(s, d)
    return store.read_entries(store.poll_range(until=WRITES[2][2])).select("event_id")


def store_entries_partitions(s, d):
    store = _loaded(s, d)
    return _merged(store.run_partition_entries(store.poll_range(WRITES[2][2]), _count, PIECES))


def store_poll_pages(s, d):
    """Pages of 40 entries until there are no more."""
    store, since, rows = _loaded(s, d), "", []
    while True:
        page = store.poll(since, 40)
        n = page.entries.count()
        if page.next_offset == since:
            return s.createDataFrame(rows, "page long, n_entries long")
        rows, since = [*rows, (len(rows), n)], page.next_offset


def store_poll_records(s, d):
    records, _ = _loaded(s, d).poll_records(max_entries=1_000_000)
    return records.select("event_id", "value")


def store_data_paths(s, d):
    """Entries in order, with the folders of their data, which exist."""
    store = _loaded(s, d)
    found = [(r.key, r.data_path) for r in store.poll_range().collect()]
    there = set(store.logs.files.there([p for _, p in found]))
    if found != sorted(found, key=lambda x: (next(k for k, (_, days, _) in enumerate(WRITES) if patterns.matches(x[0], days, PARTS)), found.index(x))):
        raise AssertionError("entries come in the order of their writes")
    return s.createDataFrame([(key, p in there) for key, p in found], "hive_key string, there boolean")


def lookup_commit(s, d):
    """Each partition's write by partition and token, without reading data."""
    store = _loaded(s, d)
    asked = [(r.partition, r.token) for r in store.logs.commits().select("partition", "token").collect()]
    found = [(p, store.lookup_commit(p, t).row_count) for p, t in asked]
    if store.lookup_commit(asked[0][0], "never") is not None:
        raise AssertionError("an unknown token has no commit")
    return s.createDataFrame(found, "hive_key string, row_count long")


def write_single_key(s, d):
    """All events in one partition, whatever their days say."""
    store = _store(s, d)
    store.write_with_key("day=2000-01-01/event_type=all", _events(s, d))
    return store.read(["day=2000-01-01/event_type=all"]).select("event_id", "day")


def write_codec(s, d):
    store = _store(s, d, compression="zstd")
    store.write(_events(s, d))
    return store.read(["*"]).select("event_id", "value")


def write_token_of(s, d):
    """Tokens made of each partition's rows."""
    store = _store(s, d)
    store.write(_events(s, d), token_of=F.concat(F.lit("n-"), F.count(F.lit(1)).cast("string")))
    return store.logs.commits().select(F.col("partition").alias("hive_key"), "token")


def write_expression_parts(s, d):
    """A partition part that is an expression over the record."""
    store = _store(s, d, parts={"tenth": F.substring("day", 1, 9)})
    store.write(_events(s, d))
    return store.read(["tenth=2024-01-1"]).select("event_id", "day")


def write_restamp(s, d):
    """A partition stamped anew: its rows come a second time on the stream, as a bag."""
    clock = Clock()
    store = _store(s, d, clock, entity=(), version=None)
    first = store.write(_events(s, d), token="load-1")
    clock.now = datetime(2024, 2, 3)
    store.restamp(next(r for r in first if "event_type=click" in r.data_path))
    clock.now = datetime(2024, 2, 5)
    return store.read_entries(store.poll_range()).select("event_id")


def lost_commit_repaired(s, d):
    """Locks whose log rows were never written are found and logged, and the rows seen."""
    store = _store(s, d)
    store.logs.add_commits = lambda commits: None  # the writer dies here
    store.write(_events(s, d), token="load-1")
    del store.logs.add_commits
    before = store.read(["*"]).count()
    store.logs.add_commits = type(store.logs).add_commits.__get__(store.logs)
    store.logs.repair_all()
    return store.read(["*"]).select("event_id", F.lit(before).alias("seen_before"))


def compacted_logs(s, d):
    """Reads and polls of a dataset whose logs were made few files."""
    clock = Clock()
    store = _store(s, d, clock)
    for token, found, clock.now in WRITES:
        store.write(_matching(_events(s, d), found), token=token)
    clock.now = datetime(2024, 2, 5)
    store.logs.compact()
    return store.read_entries(store.poll_range()).select("event_id")


def view_store_lookup(s, d):
    """A view that three writes kept up, looked up without reading data or commits."""
    return _loaded(s, d).view("days").lookup(["event_type=view/day=2024-01-10..2024-01-20", "event_type=click/*"])


def view_repeats_cost_nothing(s, d):
    """Rows that the view stores after the same events were written twice."""
    store = _store(s, d, views=[DAYS_VIEW])
    for token in ("one", "two"):
        store.write(_events(s, d), token=token)
    return tuples_of(s, store.config, DAYS_VIEW)


def view_bind_times(s, d):
    """A view's times, written as text and bound to times again."""
    v = views.View("hours", ("event_type", "at"), {"event_type": F.col("event_type"), "at": F.timestamp_micros("ver")}, layouts={"at": "yyyy-MM-dd HH"})
    store = _store(s, d, views=[v])
    store.write(_events(s, d))
    return store.view("hours").lookup(["*"]).select("event_type", F.col("at").cast("timestamp_ntz").alias("at"))


def view_store_backfill(s, d):
    """Statistics of filling a view of data that are there, and how many tuples it has then."""
    store = _loaded(s, d)
    v = views.View(f"users-{uuid.uuid4().hex}", ("event_type", "user_id"), {"event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")})
    stats = backfill(s, store.config, v, ["day=2024-01-05..2024-01-15/*"], timing=store.timing)
    none = backfill(s, store.config, v, ["*"], until=datetime(2000, 1, 1), timing=store.timing)
    return s.createDataFrame([(*stats, *none, tuples_of(s, store.config, v).count())], "data_objects long, records long, markers long, old_objects long, old_records long, old_markers long, tuples long")


def view_paths(s, d):
    """Tuples as paths, and parsed from them."""
    tuples = views.distinct_tuples(_events(s, d), DAYS_VIEW).select(DAYS_VIEW.path().alias("path"))
    return tuples.select("path", views.parse_path(F.col("path"), DAYS_VIEW.columns).alias("t")).select("path", "t.*")


def ref_keys_decoded(s, d):
    """Ref names made and read again, with names that are none among them."""
    w = _refs(_writes(s, d)).select("ref_key").unionByName(s.createDataFrame([("refs/0-malformed.ref",)], "ref_key string"))
    return stream.decode_refs(w).select("ref_micro_ts", "token", "attempt_id", "partition")


def zip_by_partition(s, d):
    """Clicks and purchases of each day, read partition by partition side by side."""
    df = _events(s, d)
    schema = "day string, n_clicks long, n_purchases long"

    def run(key, a, b):
        return pa.table({"day": pa.array([key[0].as_py()], pa.string()), "n_clicks": pa.array([a.num_rows], pa.int64()), "n_purchases": pa.array([b.num_rows], pa.int64())})

    rows = lambda kind: df.where(F.col("event_type") == kind).select("day", "event_id")
    return batches.zip_partitions(rows("click"), rows("purchase"), F.col("day"), F.col("day"), run, schema)


def stream_drain(s, d):
    """All records of the stream, page by page, from the start."""
    store, rows = _loaded(s, d), []
    process_entries(s, store.reader, "", lambda entries, records: rows.append((records.count(), records.agg(F.sum("event_id")).first()[0])), page=60)
    return s.createDataFrame([(sum(n for n, _ in rows), sum(t for _, t in rows))], "n_rows long, sum_ids long")


def stream_structured(s, d):
    """The same by Structured Streaming: a page a batch, started anew from its checkpoint, every version once."""
    store = _loaded(s, d)
    at = _shared(s)
    each = lambda entries, records, batch: records.select("event_id", "value").write.mode("overwrite").parquet(f"{at}/out/{batch}")
    for _ in range(4):  # a run takes one page
        q = read_changes(s, store.reader, page=60).writeStream.foreachBatch(with_records(store.reader, each)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return s.read.schema("event_id long, value double").option("recursiveFileLookup", "true").parquet(f"{at}/out")


def poll_cursor(s, d):
    """Refs that do not pass move the offset all the same."""
    w = _writes(s, d)
    page = stream.poll(_refs(w), _commits(w.where("event_type = 'none'")))
    return s.createDataFrame([(page.entries.count(), page.next_offset)], "n_entries long, next_offset string")


def write_late(s, d):
    """A write whose commits all came after the timeout: it is told so, with its results, and the rows are there."""

    class Slow(Clock):
        def __call__(self) -> datetime:
            self.now += timedelta(minutes=1)
            return self.now

    store = _store(s, d, Slow())
    try:
        store.write(_events(s, d))
        found = []
    except CommitAfterTimeout as e:
        found = e.results
    return s.createDataFrame([(len(found), store.read(["*"]).count())], "n_late long, n_rows long")


def dedup_off(s, d):
    """Without an entity rows are read as they were written, copies too."""
    store = _store(s, d, entity=(), version=None)
    rows = _events(s, d)
    store.write(rows.unionByName(rows.where("event_type = 'click'")))
    return store.read(["*"]).select("event_id")


def timing_config(s, d):
    """The timing that a dataset's folder holds."""
    root = _shared(s)
    write_timing(s, root, " 1m2.5s\n", "100ms")
    t = load_timing(s, root)
    us = timedelta(microseconds=1)
    return s.createDataFrame([(t.commit_timeout // us, t.max_clock_skew // us, t.settle // us)], "commit_timeout_us long, max_clock_skew_us long, settle_us long")


def durations(s, d):
    rows = [(x, parse_duration(x) // timedelta(microseconds=1)) for x in ("1h", "1h2m3.5s", "250ms", "7us", "1.5m", "0s")]
    return s.createDataFrame(rows, "text string, us long")


def attempt_ids(s, d):
    """Ids made one after another: distinct, of 32 digits, their times in order."""
    found = [keys.new_id() for _ in range(1000)]
    ordered = all(a[:12] <= b[:12] for a, b in itertools.pairwise(found))
    back = all(keys.parse_commit_name(f"a-b-{x}") == ("a-b", x) for x in found)
    return s.createDataFrame([(len(set(found)), all(keys.ATTEMPT.fullmatch(x) for x in found), ordered, back)], "n long, well_formed boolean, ordered boolean, read_back boolean")


def rejected(s, d):
    """What validation turns away, and what it does not."""
    store = _loaded(s, d)
    entries = store.poll_range(until=WRITES[1][2])
    rows = _events(s, d)
    cases = {
        "key without a part": lambda: store.write_with_key("day=2024-01-01", rows),
        "key with an empty value": lambda: store.write_with_key("day=/event_type=x", rows),
        "pattern with a star inside": lambda: store.read(["day=2024-*-01/*"]),
        "pattern upside down": lambda: store.read(["day=b..a/*"]),
        "pattern that is well formed": lambda: store.read(["day=a..b/*"]),
        "token with a slash": lambda: store.write(rows, token="a/b"),
        "two tokens": lambda: store.write(rows, token="a", token_of=lambda key: "b"),
        "value with a slash": lambda: store.write(rows.withColumn("day", F.lit("a/b"))),
        "entries of another dataset": lambda: store.read_entries(entries.withColumn("data_path", F.lit("file:///elsewhere/x"))),
        "entries of this dataset": lambda: store.read_entries(entries),
        "page of none": lambda: store.poll(max_entries=0),
        "unknown codec": lambda: _store(s, d, compression="lzo"),
        "timing that is missing": lambda: load_timing(s, _shared(s)),
        "duration without a unit": lambda: parse_duration("5"),
        "view of a column that is no text": lambda: _store(s, d, views=[views.View("v", ("value",))]),
        "entity without a version": lambda: _store(s, d, version=None),
    }

    def turned_away(run) -> bool:
        try:
            run()
        except ValueError:
            return True
        return False

    return s.createDataFrame([(name, turned_away(run)) for name, run in cases.items()], "test_case string, rejected boolean")


QUERIES = {
    "scan_all": scan_all,
    "pattern_exact": pattern_exact,
    "pattern_prefix": pattern_prefix,
    "pattern_range": pattern_range,
    "pattern_range_open": pattern_range_open,
    "pattern_wild_head": pattern_wild_head,
    "pattern_multi": pattern_multi,
    "pattern_overlap": pattern_overlap,
    "read_latest": read_latest,
    "read_latest_all": read_latest_all,
    "read_history": read_history,
    "latest_tie_last": latest_tie_last,
    "latest_spanning_entities": latest_spanning_entities,
    "group_by_partition": group_by_partition,
    "partition_batches": partition_batches,
    "narrow_read": narrow_read,
    "zero_fill": zero_fill_query,
    "commit_gate": commit_gate,
    "commit_gate_attempts": commit_gate_attempts,
    "poll_all": poll_all,
    "poll_window": poll_window,
    "poll_settle": poll_settle,
    "poll_page": poll_page,
    "poll_gated": poll_gated,
    "poll_records": poll_records,
    "range_latest": range_latest,
    "restamp_bag": restamp_bag,
    "partition_keys": partition_keys,
    "partition_intersect": partition_intersect,
    "view_distinct": view_distinct,
    "view_lookup": view_lookup,
    "view_time_layout": view_time_layout,
    "view_skip": view_skip,
    "view_lossy_bind": view_lossy_bind,
    "backfill_stats": backfill_stats,
    "idempotent_retry": idempotent_retry,
    "inserted_at_column": inserted_at_column,
    "write_results": write_results,
    "store_commits": store_commits,
    "store_latest": store_latest,
    "store_pattern": store_pattern,
    "store_ordered": store_ordered,
    "store_early_stop": store_early_stop,
    "store_partitions": store_partitions,
    "store_partition_iter": store_partition_iter,
    "store_range": store_range,
    "store_range_tip": store_range_tip,
    "store_range_partitions": store_range_partitions,
    "store_entries": store_entries,
    "store_entries_partitions": store_entries_partitions,
    "store_poll_pages": store_poll_pages,
    "store_poll_records": store_poll_records,
    "store_data_paths": store_data_paths,
    "lookup_commit": lookup_commit,
    "write_single_key": write_single_key,
    "write_codec": write_codec,
    "write_token_of": write_token_of,
    "write_expression_parts": write_expression_parts,
    "write_restamp": write_restamp,
    "lost_commit_repaired": lost_commit_repaired,
    "compacted_logs": compacted_logs,
    "view_store_lookup": view_store_lookup,
    "view_repeats_cost_nothing": view_repeats_cost_nothing,
    "view_bind_times": view_bind_times,
    "view_store_backfill": view_store_backfill,
    "view_paths": view_paths,
    "ref_keys_decoded": ref_keys_decoded,
    "zip_by_partition": zip_by_partition,
    "stream_drain": stream_drain,
    "stream_structured": stream_structured,
    "rejected": rejected,
    "poll_cursor": poll_cursor,
    "write_late": write_late,
    "dedup_off": dedup_off,
    "timing_config": timing_config,
    "durations": durations,
    "attempt_ids": attempt_ids,
}

_E = "WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) AS ver FROM events)"
_W = (
    _E + ", w AS (SELECT day, event_type, 'batch-' || day || '-' || event_type AS token, md5('batch-' || day || '-' || event_type) AS attempt_id,"
    " max(ver) AS ref_micro_ts, count(*) AS row_count FROM e GROUP BY day, event_type)"
)
_REF = "lpad(CAST(ref_micro_ts AS VARCHAR), 16, '0') || '-' || token"
_US = "epoch_us(TIMESTAMP '2024-01-{}')"

_KEY = "'day=' || day || '/event_type=' || event_type"
_PARTITIONS = f"{_E} SELECT {_KEY} AS hive_key, count(*) AS n_rows, min(event_id) AS first_event FROM e WHERE day >= '2024-01-{{}}' GROUP BY day, event_type"

ORACLE_SQL = {
    "scan_all": f"{_E} SELECT event_id, day, event_type, user_id, value FROM e",
    "pattern_exact": f"{_E} SELECT event_id, day, event_type FROM e WHERE day = '2024-01-05' AND event_type = 'click'",
    "pattern_prefix": f"{_E} SELECT event_id, day, event_type FROM e WHERE starts_with(day, '2024-01-1') AND event_type = 'view'",
    "pattern_range": f"{_E} SELECT event_id, day FROM e WHERE day >= '2024-01-05' AND day < '2024-01-15'",
    "pattern_range_open": f"{_E} SELECT event_id, day, event_type FROM e WHERE day >= '2024-01-20' AND event_type < 'error'",
    "pattern_wild_head": f"{_E} SELECT event_id, day FROM e WHERE event_type = 'signup'",
    "pattern_multi": f"{_E} SELECT event_id, day, event_type FROM e WHERE (day = '2024-01-05' AND event_type = 'click') OR (day = '2024-01-06' AND event_type = 'view')",
    "pattern_overlap": f"{_E} SELECT event_id, day FROM e WHERE day >= '2024-01-01' AND day < '2024-01-20'",
    "read_latest": f"{_E} SELECT day, event_type, user_id, ts, value FROM e WHERE day >= '2024-01-05' AND day < '2024-01-15' AND event_type = 'click' QUALIFY row_number() OVER (PARTITION BY day, event_type, user_id ORDER BY ver DESC) = 1",
    "read_latest_all": f"{_E} SELECT day, event_type, user_id, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY day, event_type, user_id ORDER BY ver DESC) = 1",
    "read_history": "SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS ship_month, l_orderkey, l_linenumber, epoch_us(l_shipdate) AS ver FROM lineitem",
    "latest_tie_last": "SELECT strftime(o_orderdate, '%Y-%m') AS period, o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_custkey ORDER BY epoch_us(o_orderdate) DESC, o_orderkey DESC) = 1",
    "latest_spanning_entities": "SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, l_orderkey, l_linenumber, max(epoch_us(l_shipdate)) AS ver FROM lineitem GROUP BY ALL",
    "group_by_partition": f"{_E} SELECT 'day=' || day || '/event_type=' || event_type AS hive_key, count(*) AS n_rows FROM e GROUP BY ALL",
    "partition_batches": f"{_E} SELECT 'day=' || day || '/event_type=' || event_type AS hive_key, count(DISTINCT user_id) AS n_rows, min(user_id) AS first_entity FROM e GROUP BY ALL",
    "narrow_read": f"{_E} SELECT event_id, user_id FROM e",
    "zero_fill": f"{_E} SELECT event_id, CAST(0.0 AS DOUBLE) AS amount, '' AS currency FROM e",
    "commit_gate": f"{_E} SELECT event_id, day FROM e WHERE event_type <> 'error'",
    "commit_gate_attempts": f"{_E} SELECT event_id, 'second' AS attempt FROM e",
    "poll_all": f"{_W} SELECT {_REF} || '-' || attempt_id AS ref_id, row_count FROM w",
    "poll_window": f"{_W} SELECT day, event_type, row_count FROM w WHERE ref_micro_ts >= {_US.format(10)} AND ref_micro_ts < {_US.format(20)}",
    "poll_settle": f"{_W} SELECT day, event_type FROM w WHERE ref_micro_ts < {_US.format(20)} - 16000000",
    "poll_page": f"{_W} SELECT token, ref_micro_ts FROM w ORDER BY {_REF} LIMIT 7",
    "poll_gated": f"{_W} SELECT token FROM w WHERE event_type <> 'error' ORDER BY {_REF} LIMIT 7",
    "poll_records": f"{_W} SELECT e.event_id, e.day FROM e JOIN w USING (day, event_type) WHERE w.ref_micro_ts >= {_US.format(10)} AND w.ref_micro_ts < {_US.format(20)}",
    "range_latest": f"{_W} SELECT e.day, e.event_type, e.user_id, e.value FROM e JOIN w USING (day, event_type) WHERE w.ref_micro_ts < {_US.format(15)} QUALIFY row_number() OVER (PARTITION BY e.day, e.event_type, e.user_id ORDER BY e.ver DESC) = 1",
    "restamp_bag": f"{_E} SELECT event_id FROM e UNION ALL SELECT event_id FROM e WHERE event_type = 'click'",
    "partition_keys": f"{_W} SELECT DISTINCT 'day=' || day || '/event_type=' || event_type AS key FROM w",
    "partition_intersect": f"{_W} SELECT DISTINCT day FROM w WHERE event_type = 'click' INTERSECT SELECT DISTINCT day FROM w WHERE event_type = 'purchase' AND row_count > 60",
    "view_distinct": f"{_E} SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM e",
    "view_lookup": f"{_E} SELECT DISTINCT event_type, day FROM e WHERE event_type = 'view' AND day >= '2024-01-10' AND day < '2024-01-20'",
    "view_time_layout": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus FROM orders",
    "view_skip": f"{_E} SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM e WHERE value >= 150",
    "view_lossy_bind": f"{_E} SELECT event_type FROM (SELECT DISTINCT event_type, user_id FROM e)",
    "backfill_stats": f"{_E} SELECT count(*) AS data_objects, CAST(sum(n) AS BIGINT) AS records, CAST(sum(m) AS BIGINT) AS markers FROM (SELECT day, event_type, count(*) AS n, count(DISTINCT user_id) AS m FROM e GROUP BY day, event_type)",
    "idempotent_retry": "SELECT event_id FROM events",
    "inserted_at_column": "SELECT event_id, TIMESTAMP '2024-02-01 00:00:00' AS inserted_at FROM events",
    "write_results": f"{_W} SELECT row_number() OVER (ORDER BY {_KEY}) - 1 AS place, {_KEY} AS hive_key, row_count FROM w",
    "store_commits": f"{_W} SELECT {_KEY} AS hive_key, row_count FROM w",
    "store_latest": f"{_E} SELECT event_id, day, CASE WHEN value >= 100 THEN value * 2 ELSE value END AS value FROM e",
    "store_pattern": f"{_E} SELECT event_id, day FROM e WHERE (day >= '2024-01-05' AND day < '2024-01-15' AND event_type = 'click') OR starts_with(day, '2024-01-2')",
    "store_ordered": f"{_E} SELECT row_number() OVER (ORDER BY {_KEY}, event_id, ver) - 1 AS place, event_id FROM e",
    "store_early_stop": f"{_E} SELECT event_id FROM e ORDER BY {_KEY}, event_id, ver LIMIT 10",
    "store_partitions": _PARTITIONS.format("01"),
    "store_partition_iter": _PARTITIONS.format("01"),
    "store_range": f"{_E} SELECT event_id, day FROM e WHERE day >= '2024-01-11' AND day < '2024-01-21'",
    "store_range_tip": f"{_E} SELECT event_id FROM e WHERE day >= '2024-01-11'",
    "store_range_partitions": _PARTITIONS.format("11"),
    "store_entries": f"{_E} SELECT event_id FROM e WHERE day < '2024-01-21'",
    "store_entries_partitions": _PARTITIONS.format("21"),
    "store_poll_pages": f"{_W}, o AS (SELECT (row_number() OVER (ORDER BY CASE WHEN day < '2024-01-11' THEN 1 WHEN day < '2024-01-21' THEN 2 ELSE 3 END) - 1) // 40 AS page FROM w) SELECT page, count(*) AS n_entries FROM o GROUP BY page",
    "store_poll_records": "SELECT event_id, value FROM events",
    "store_data_paths": f"{_W} SELECT {_KEY} AS hive_key, true AS there FROM w",
    "lookup_commit": f"{_W} SELECT {_KEY} AS hive_key, row_count FROM w",
    "write_single_key": f"{_E} SELECT event_id, day FROM e",
    "write_codec": "SELECT event_id, value FROM events",
    "write_token_of": f"{_W} SELECT {_KEY} AS hive_key, 'n-' || row_count AS token FROM w",
    "write_expression_parts": f"{_E} SELECT event_id, day FROM e WHERE starts_with(day, '2024-01-1')",
    "write_restamp": f"{_E}, c AS (SELECT min(day) AS day FROM e WHERE event_type = 'click') SELECT event_id FROM e UNION ALL SELECT event_id FROM e JOIN c USING (day) WHERE event_type = 'click'",
    "lost_commit_repaired": "SELECT event_id, 0 AS seen_before FROM events",
    "compacted_logs": "SELECT event_id FROM events",
    "view_store_lookup": f"{_E} SELECT DISTINCT event_type, day FROM e WHERE (event_type = 'view' AND day >= '2024-01-10' AND day < '2024-01-20') OR event_type = 'click'",
    "view_repeats_cost_nothing": f"{_E} SELECT DISTINCT event_type, day FROM e",
    "view_bind_times": f"{_E} SELECT DISTINCT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS at FROM e",
    "view_store_backfill": f"{_E}, p AS (SELECT day, event_type, count(*) AS n, count(DISTINCT user_id) AS m FROM e WHERE day >= '2024-01-05' AND day < '2024-01-15' GROUP BY day, event_type)"
    " SELECT count(*) AS data_objects, CAST(sum(n) AS BIGINT) AS records, CAST(sum(m) AS BIGINT) AS markers, CAST(0 AS BIGINT) AS old_objects, CAST(0 AS BIGINT) AS old_records, CAST(0 AS BIGINT) AS old_markers,"
    " (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM e WHERE day >= '2024-01-05' AND day < '2024-01-15')) AS tuples FROM p",
    "view_paths": f"{_E} SELECT DISTINCT 'event_type=' || event_type || '/day=' || day AS path, event_type, day FROM e",
    "ref_keys_decoded": f"{_W} SELECT ref_micro_ts, token, attempt_id, {_KEY} AS partition FROM w UNION ALL SELECT NULL, NULL, NULL, NULL",
    "zip_by_partition": f"{_E} SELECT day, count(*) FILTER (event_type = 'click') AS n_clicks, count(*) FILTER (event_type = 'purchase') AS n_purchases FROM e WHERE event_type IN ('click', 'purchase') GROUP BY day",
    "stream_drain": "SELECT count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS sum_ids FROM events",
    "stream_structured": "SELECT event_id, value FROM events",
    "poll_cursor": f"{_W} SELECT CAST(0 AS BIGINT) AS n_entries, 'refs/' || max({_REF} || '-' || attempt_id || ';' || replace({_KEY}, '/', '%2F') || '.ref') AS next_offset FROM w",
    "write_late": f"{_W} SELECT (SELECT count(*) FROM w) AS n_late, (SELECT count(*) FROM events) AS n_rows",
    "dedup_off": "SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_type = 'click'",
    "timing_config": "SELECT CAST(62500000 AS BIGINT) AS commit_timeout_us, CAST(100000 AS BIGINT) AS max_clock_skew_us, CAST(62600000 AS BIGINT) AS settle_us",
    "durations": "SELECT text, CAST(us AS BIGINT) AS us FROM (VALUES ('1h', 3600000000), ('1h2m3.5s', 3723500000), ('250ms', 250000), ('7us', 7), ('1.5m', 90000000), ('0s', 0)) AS t(text, us)",
    "attempt_ids": "SELECT CAST(1000 AS BIGINT) AS n, true AS well_formed, true AS ordered, true AS read_back",
    "rejected": "SELECT * FROM (VALUES ('key without a part', true), ('key with an empty value', true), ('pattern with a star inside', true), ('pattern upside down', true), ('pattern that is well formed', false),"
    " ('token with a slash', true), ('two tokens', true), ('value with a slash', true), ('entries of another dataset', true), ('entries of this dataset', false), ('page of none', true), ('unknown codec', true),"
    " ('entity without a version', true), ('timing that is missing', true), ('duration without a unit', true), ('view of a column that is no text', true)) AS t(test_case, rejected)",
}
