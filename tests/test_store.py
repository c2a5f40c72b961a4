import dataclasses
import glob
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.views import View
from tidemark.sources import config as conf
from tidemark.sources.reader import ForeignEntry, Reader, backfill
from tidemark.sources.store import Store
from tidemark.sources.writer import CommitAfterTimeout
from tidemark.streaming import source

SCHEMA = T.StructType([T.StructField("period", T.StringType()), T.StructField("customer", T.StringType()), T.StructField("sku", T.StringType()), T.StructField("value", T.LongType())])
TIMING = conf.Timing(timedelta(seconds=2), timedelta(milliseconds=100))
ROWS = [("2026-03-17", "abc", "s1", 1), ("2026-03-17", "def", "s2", 2), ("2026-03-18", "abc", "s3", 3), ("2026-04-01", "abc", "s4", 4)]


class Clock:
    """Time stands still but for ``tick``; each look may move it by ``step``."""

    def __init__(self):
        self.now, self.step = datetime(2026, 5, 1), timedelta(milliseconds=1)

    def __call__(self):
        self.now += self.step
        return self.now

    def tick(self, s=10):
        self.now += timedelta(seconds=s)


@pytest.fixture
def made(spark, tmp_path):
    def make(**more):
        clock = Clock()
        parts = more.pop("parts", {"period": "period", "customer": "customer"})
        schema = more.pop("schema", SCHEMA)
        return Store(spark, conf.StoreConfig(f"file://{tmp_path}/ds", schema, parts, clock=clock, **more), TIMING), clock

    return make


def df(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def values(frame):
    return sorted(r.value for r in frame.collect())


def test_write_and_patterns(spark, made):
    store, _ = made()
    results = store.write(df(spark, ROWS))
    assert [r.row_count for r in results] == [1, 1, 1, 1] and [r.data_path for r in results] == sorted(r.data_path for r in results)
    assert values(store.read(["period=2026-03-*/customer=abc"])) == [1, 3]
    assert values(store.read(["*", "period=2026-03-17/customer=abc"])) == [1, 2, 3, 4]
    assert values(store.read([])) == []
    assert [r.value for r in store.read_iter(["*"])] == [1, 2, 3, 4]
    assert [(k, [x.value for x in v]) for k, v in store.read_partition_iter(["period=2026-03-17/*"])] == [("period=2026-03-17/customer=abc", [1]), ("period=2026-03-17/customer=def", [2])]
    assert store.read_partitions(["*"]).count() == 4
    assert store.write(df(spark, [])) == [] and store.write_with_key("period=x/customer=y", df(spark, [])) is None
    plan = store.read(["period=2026-03-17/*"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__pk_period" in plan
    with pytest.raises(ValueError):
        store.write(df(spark, [("", "a", "s", 1)]))
    with pytest.raises(ValueError):
        store.write(df(spark, [("a/b", "a", "s", 1)]))
    with pytest.raises(ValueError):
        store.read(["period=x"])


def test_versions(spark, made):
    store, clock = made(entity=["sku"], version="value")
    for v in (0, 1, 2):
        store.write(df(spark, [("p", "c", "s", v), ("p", "c", "s", v)]))
    clock.tick()
    assert values(store.read(["*"])) == [2]
    assert values(store.read(["*"], history=True)) == [0, 1, 2]
    records, end = store.poll_records()
    assert values(records) == [0, 1, 2]
    assert store.poll(end).next_offset == end and store.poll(end).entries.count() == 0
    assert values(store.read_range()) == [2]


def test_order_is_by_whole_key(spark, made):
    store, _ = made(entity=["sku"], version="value")
    store.write(df(spark, [("a", "z", "b", 2), ("a-b", "c", "a", 1), ("a", "z", "a", 1), ("a", "z", "b", 1)]))
    assert [(r.period, r.sku, r.value) for r in store.read(["*"], history=True, ordered=True).collect()] == [("a-b", "a", 1), ("a", "a", 1), ("a", "b", 1), ("a", "b", 2)]


def test_poll_and_settle(spark, made):
    store, clock = made()
    for k in range(3):
        store.write(df(spark, [("p", f"c{k}", "s", k)]))
        clock.tick(3)
    clock.tick(-2)
    assert store.poll().entries.count() == 2  # the last is not settled
    clock.tick()
    page = store.poll(max_entries=2)
    assert [r.key for r in page.entries.collect()] == ["period=p/customer=c0", "period=p/customer=c1"]
    assert [r.row_count for r in store.poll(page.next_offset).entries.collect()] == [1]
    entries = store.poll_range()
    assert values(store.read_entries(entries)) == [0, 1, 2]
    first = store.poll(max_entries=1).entries.first()
    assert store.poll_range(until=first.inserted_at).count() == 0
    assert store.poll_range(since=first.inserted_at).count() == 3
    assert values(store.read_range(since=first.inserted_at + timedelta(microseconds=1))) == [1, 2]
    assert [k for k, _ in store.read_partition_range_iter()] == [f"period=p/customer=c{k}" for k in range(3)]
    with pytest.raises(ForeignEntry):
        store.read_entries(entries.withColumn("data_path", F.lit("file:///elsewhere/x")))


def test_gate_and_malformed(spark, made):
    store, clock = made()
    store.write(df(spark, ROWS[:1]))
    store.write(df(spark, ROWS[1:2]))
    lost = store.logs.commits().where("partition like '%def'").first()
    path = store.config.path("log", "commits").removeprefix("file://")
    kept = [tuple(r) for r in store.logs.commits().where(F.col("token") != lost.token).collect()]
    shutil.rmtree(path)
    store.logs._append("commits", "partition string, token string, attempt_id string, ref_micro_ts long, inserted_at_us long, row_count long", kept)
    store.logs.add_refs(["refs/0-malformed.ref"])
    store.write(df(spark, ROWS[2:3]))
    clock.tick()
    assert values(store.read(["*"])) == [1, 3]
    assert values(store.poll_records()[0]) == [1, 3]
    assert store.logs.malformed_refs() == 1


def test_idempotent(spark, made):
    store, _ = made()
    first = store.write(df(spark, ROWS), token="job-1")
    assert store.write(df(spark, [("2026-03-17", "abc", "other", 99)]), token="job-1") == first[:1]
    assert values(store.read(["*"])) == [1, 2, 3, 4]
    assert store.lookup_commit("period=2026-03-17/customer=abc", "job-1") == first[0]
    assert store.lookup_commit("period=2026-03-17/customer=abc", "job-2") is None
    again = store.write(df(spark, ROWS[:1]), token="job-1", optimistic=True)
    assert again == first[:1] and store.writer.counters["optimistic_collisions"] == 1
    assert values(store.read(["*"])) == [1, 2, 3, 4]
    own = store.write(df(spark, ROWS), token_of=F.concat(F.lit("sum-"), F.sum("value").cast("string")))
    assert len(own) == 4 and store.write(df(spark, ROWS[:1]), token_of=lambda key: "sum-1") == own[:1]
    for bad in ({"token": ""}, {"token": "a/b"}, {"token": "x", "token_of": lambda k: "y"}, {"token_of": lambda k: ""}):
        with pytest.raises(ValueError):
            store.write(df(spark, ROWS), **bad)


def test_results_by_key_and_folders_that_exist(spark, made):
    """Folder names go on after a value, so paths sort otherwise than keys; Spark escapes some characters in them."""
    store, clock = made(parts={"period": "period"})
    rows = [(x, "c", "s", k) for k, x in enumerate(["abc-eu", "abc", "t:1", "50%", "a=b?#", "é ü", "tab\tx"])]
    results = store.write(df(spark, rows), token="tok:en=1")
    names = [r.ref_path.split(";")[1] for r in results]
    assert names[:4] == ["period=50%25.ref", "period=a=b%3F%23.ref", "period=abc.ref", "period=abc-eu.ref"]
    assert all(os.path.exists(r.data_path.removeprefix("file://")) for r in results)
    assert store.write(df(spark, rows), token="tok:en=1") == results
    clock.tick()
    entries = store.poll_range().collect()
    assert sorted(r.data_path for r in entries) == sorted(r.data_path for r in results)
    assert [r.offset for r in entries] == sorted(r.offset for r in entries)
    again = store.restamp(next(r for r in results if "t%3A1" in r.data_path))
    clock.tick()
    late = store.poll_range(since=again.inserted_at).collect()
    assert [r.key for r in late] == ["period=t:1"] and values(store.read_entries(store.poll_range(since=again.inserted_at))) == [2]
    assert values(store.read(["period=t:1"])) == [2]
    assert [r[0] for r in source.read_page(store.config.root, "", "", 10**16 - 1, 100)[0]] == sorted([r.offset for r in results] + [again.offset])
    assert {r[2] for r in source.read_page(store.config.root, "", "", 10**16 - 1, 100)[0]} == {r.data_path for r in results}


def test_only_folders_of_the_pattern_are_listed(spark, made):
    store, clock = made()
    store.write(df(spark, ROWS))
    clock.tick()
    plan = store.read(["period=2026-03-17/*"])._jdf.queryExecution().executedPlan().toString()
    assert store.reader.counters["folders"] == 2 and "InMemoryFileIndex(2 paths)" in plan
    assert [r.value for r in store.reader.with_read_ahead(1 << 20).read_iter(["*"])] == [1, 2, 3, 4]
    store.read(["*"])
    assert store.reader.counters["folders"] == 2
    assert values(store.read_range()) == [1, 2, 3, 4] and store.reader.counters["folders"] == 6
    assert values(store.read(["period=none/*"])) == []
    shutil.rmtree(store.config.root.removeprefix("file://") + "/data/__pk_period=2026-03-17")
    assert values(store.read(["period=2026-03-*/*"])) == [3] and store.reader.counters["missing_folders"] == 2


def test_partitions_in_pieces_on_executors(spark, made):
    """Some hundred rows of a partition in several tasks: pieces together are what the iterator gives, and no rows come to the driver."""
    store, clock = made(entity=["sku"], version="value")
    rows = [("a-b" if k % 10 else "a", "c", f"s{k * 7919 % 1009:04}", k) for k in range(400)]
    store.write(df(spark, rows))
    store.write(df(spark, [(*r[:3], r[3] + 1) for r in rows[::3]]))
    clock.tick()

    def run(key, piece, batches):
        import pyarrow as pa

        skus = [x for b in batches for x in b.column("sku").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([piece], pa.int64()), pa.array([skus])], ["key", "piece", "skus"])

    made_of = "key string, piece long, skus array<string>"
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for history in (False, True):
            expected = [(k, [r.sku for r in v]) for k, v in store.read_partition_iter(["*"], history)]
            for found in (
                store.run_partitions(["*"], run, made_of, history),
                store.run_partition_range(run, made_of, history=history),
                store.run_partition_entries(store.poll_range(), run, made_of, history),
            ):
                pieces = sorted(found.collect(), key=lambda r: r.piece)
                assert len(pieces) > 4 > len(expected)
                assert [(k, [x for r in pieces if r.key == k for x in r.skus]) for k in dict.fromkeys(r.key for r in pieces)] == expected
            numbered = store.read_numbered(["*"], f"{store.config.root}-numbered-{history}", history).orderBy("place").collect()
            assert [r.place for r in numbered] == list(range(len(numbered)))
            assert [(r.period, r.sku, r.value) for r in numbered] == [(r.period, r.sku, r.value) for r in store.read_iter(["*"], history)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert store.run_partitions(["period=none/*"], run, made_of).count() == 0 and store.read_numbered(["period=none/*"], f"{store.config.root}-none").count() == 0


def test_an_iterator_has_tasks_of_bounded_size(spark, made):
    """However many rows there are, the driver holds two tasks' rows; the number of shuffle partitions is 4 here."""
    store, clock = made(entity=["sku"], version="value")
    store.write(df(spark, [("p", "c", f"s{k:04}", k) for k in range(1000)]))
    clock.tick()
    reader = Reader(spark, store.config, TIMING, read_ahead=4096)
    found = reader._bounded(reader._snapshot(["*"]), reader._commits(["*"]), False)
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 10 and max(sizes) < 200
    assert [r.value for r in reader.read_iter(["*"])] == list(range(1000))
    assert [r.value for r in reader.read_range_iter()] == [r.value for r in reader.read_entries_iter(store.poll_range())] == list(range(1000))


@pytest.mark.parametrize("name", ["store_partition_iter", "store_ordered", "store_range_partitions", "store_entries_partitions"])
def test_whole_tables_do_not_pass_through_the_driver(spark, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame

    import __spark_entry__ as entry

    def never(*a, **b):
        raise AssertionError("rows are brought to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_logs_compact(spark, made):
    store, clock = made()
    for row in ROWS:
        store.write(df(spark, [row]))
    clock.tick()
    files = lambda name: glob.glob(store.config.path("log", name).removeprefix("file://") + "/*.parquet")
    before = [tuple(r) for r in store.poll_range().collect()]
    assert len(files("refs")) == len(files("commits")) == 4
    store.logs.compact()
    assert len(files("refs")) == len(files("commits")) == 1
    assert [tuple(r) for r in store.poll_range().collect()] == before and values(store.read(["*"])) == [1, 2, 3, 4]


def test_a_page_is_cut_at_bounds(spark, made):
    store, clock = made()
    for row in ROWS:
        store.write(df(spark, [row]))
    got = [r[0] for r in source.read_page(store.config.root, "", "", 10**16 - 1, 100)[0]]
    assert len(got) == 4
    page, at = source.read_page(store.config.root, got[0], "", 10**16 - 1, 2)
    assert [r[0] for r in page] == got[1:3] and at == got[2]
    assert [r[0] for r in source.read_page(store.config.root, got[0], got[1], 10**16 - 1, 100)[0]] == got[1:2]
    assert source.read_page(store.config.root, got[-1], "", 10**16 - 1, 2) == ([], got[-1])


def test_stalls_are_counted(spark, made):
    import itertools
    import time

    from tidemark.sources.observe import watched

    store, _ = made()
    store.write(df(spark, ROWS))
    assert [r.value for r in store.read_iter(["*"], stall_after=60)] == [1, 2, 3, 4] and store.reader.counters["stalls"] == 0
    slow = (time.sleep(0.3) or x for x in range(2))
    with pytest.warns(RuntimeWarning):
        assert list(watched(slow, store.reader.counters, 0.05)) == [0, 1]
    assert store.reader.counters["stalls"] >= 2
    assert list(itertools.islice(watched(iter(range(9)), store.reader.counters, 5), 3)) == [0, 1, 2]


def test_input_order_inside_partitions(spark, made):
    store, _ = made(parts={"customer": "customer"})
    rows = [("p", "c", f"s{k}", (k * 7919) % 101) for k in range(100)]
    got = store.group_by_partition(df(spark, rows).coalesce(1)).first()
    assert [r.value for r in got.rows] == [r[3] for r in rows]


def test_crash_between_lock_and_log(spark, made):
    store, _ = made()
    first = store.write(df(spark, ROWS[:1]), token="t")
    shutil.rmtree(store.config.path("log", "commits").removeprefix("file://"))
    assert values(store.read(["*"])) == []
    assert store.write(df(spark, ROWS[:1]), token="t") == first
    assert values(store.read(["*"])) == [1]
    shutil.rmtree(store.config.path("log", "commits").removeprefix("file://"))
    assert store.logs.repair_all(datetime(2030, 1, 1)) == []
    assert [c.token for c in store.logs.repair_all()] == ["t"] and store.logs.repair_all() == []
    assert values(store.read(["*"])) == [1]


def test_late_commit_and_restamp(spark, made):
    store, clock = made()
    clock.step = timedelta(seconds=3)
    with pytest.raises(CommitAfterTimeout) as e:
        store.write(df(spark, ROWS[:1]))
    clock.step = timedelta(milliseconds=1)
    assert values(store.read(["*"])) == [1]
    again = store.restamp(e.value.results[0])
    clock.tick()
    assert again.data_path == e.value.results[0].data_path and again.offset > e.value.results[0].offset
    assert values(store.read_entries(store.poll_range())) == [1, 1]  # a bag: the write comes once for each ref
    assert values(store.read(["*"])) == [1]
    with pytest.raises(ValueError):
        store.restamp(dataclasses.replace(again, data_path="file:///elsewhere/__commit=x"))


def test_missing_files(spark, made):
    store, clock = made()
    store.write(df(spark, ROWS))
    clock.tick()
    entries = store.poll_range().cache()
    assert entries.count() == 4
    reader = store.read(["*"])
    gone = glob.glob(store.config.root.removeprefix("file://") + "/data/__pk_period=2026-03-17/__pk_customer=abc/*")[0]
    stream = store.read_entries(entries)
    shutil.rmtree(gone)
    assert values(stream) == [2, 3, 4]
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        reader.collect()


def test_narrow_and_evolved(spark, made):
    store, _ = made()
    store.write(df(spark, ROWS))
    narrow = store.reader.narrow(T.StructType(SCHEMA.fields[:1]))
    assert narrow.read(["*"]).columns == ["period"] and narrow.read(["*"]).count() == 4
    wider = dataclasses.replace(store.config, schema=T.StructType([*SCHEMA.fields, T.StructField("amount", T.DoubleType()), T.StructField("note", T.StringType())]))
    r = Reader(spark, wider, TIMING).read(["period=2026-03-18/*"]).first()
    assert (r.value, r.amount, r.note) == (3, 0.0, "")


def test_values_round_trip(spark, made):
    store, _ = made()
    odd = ["a=b", "50%off", "日本", "x y:z", "00042"]
    store.write(df(spark, [(x, "c", x, k) for k, x in enumerate(odd)]))
    for k, x in enumerate(odd):
        assert values(store.read([f"period={x}/*"])) == [k]
    assert {r.period for r in store.read(["*"]).collect()} == set(odd)
    clock_free = store.poll_range(until=datetime(2030, 1, 1))
    assert clock_free.count() in (0, 5)


@pytest.mark.parametrize("codec", ["", "snappy", "zstd", "gzip", "uncompressed"])
def test_codecs(spark, made, codec):
    store, _ = made(compression=codec)
    store.write(df(spark, ROWS))
    assert values(store.read(["*"])) == [1, 2, 3, 4]


def test_nested(spark, made):
    kind = T.StructType([*SCHEMA.fields, T.StructField("logs", T.ArrayType(T.StructType([T.StructField("field", T.ByteType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))]))), T.StructField("raw", T.BinaryType())])
    store, _ = made(schema=kind)
    row = ("p", "c", "s", 1, [(1, {"k": "v"}), (2, {})], bytearray(b"\x00\xff"))
    store.write(df(spark, [row], kind))
    r = store.read(["*"]).first()
    assert ([(x.field, x.attrs) for x in r.logs], bytes(r.raw)) == ([(1, {"k": "v"}), (2, {})], b"\x00\xff")


def test_key_of_write_with_key_and_expression_parts(spark, made):
    store, _ = made(parts={"month": F.substring("period", 1, 7)})
    store.write(df(spark, ROWS))
    assert values(store.read(["month=2026-03"])) == [1, 2, 3]
    store.write_with_key("month=1999-01", df(spark, ROWS[:1]))
    assert values(store.read(["month=1999-01"])) == [1]
    assert [(r.key, len(r.rows)) for r in store.group_by_partition(df(spark, ROWS)).collect()] == [("month=2026-03", 3), ("month=2026-04", 1)]


def test_inserted_at(spark, made):
    kind = T.StructType([*SCHEMA.fields, T.StructField("at", T.TimestampType())])
    store, _ = made(schema=kind, inserted_at="at")
    t = datetime(2026, 1, 2, 3, 4, 5, 678901)
    (r,) = store.write(df(spark, ROWS[:1]), inserted_at=t)
    assert r.inserted_at == t
    assert store.read(["*"]).select(F.unix_micros("at").alias("us")).first().us == 1767323045678901
    (again,) = store.write(df(spark, ROWS[:1]), token="x")
    assert again.inserted_at > t
    with pytest.raises(conf.ConfigError):
        made(inserted_at="sku")


def test_views_and_backfill(spark, made):
    v = View("by_sku", ("sku", "period", "customer"))
    store, clock = made()
    for row in ROWS:
        store.write(df(spark, [row]))
    live, _ = made(views=[v])
    live.write(df(spark, [("2026-03-17", "abc", "s9", 9)]))
    look = live.view("by_sku").lookup
    assert look(["*"]).count() == 1
    assert tuple(backfill(spark, live.config, v, ["period=2026-03-17/*"], timing=TIMING)) == (3, 3, 3)
    assert tuple(backfill(spark, live.config, v, ["*"], until=datetime(2000, 1, 1), timing=TIMING)) == (0, 0, 0)
    assert tuple(backfill(spark, live.config, v, ["*"], until=datetime(2100, 1, 1), timing=TIMING)) == (5, 5, 5)
    assert look(["*"]).count() == 5 and look(["sku=s1/period=2026-03-17/customer=*"]).count() == 1
    assert tuple(backfill(spark, live.config, v, ["period=none/*"], timing=TIMING)) == (0, 0, 0)


@pytest.mark.parametrize("timeout,skew", [("0s", "1s"), ("x", "1s"), ("1s", "-1s"), ("", "1s"), (None, "1s"), ("1s", None)])
def test_timing_rejects(spark, tmp_path, timeout, skew):
    conf.write_timing(spark, f"file://{tmp_path}", timeout or "1s", skew or "1s")
    for name, x in ((conf.COMMIT_TIMEOUT, timeout), (conf.CLOCK_SKEW, skew)):
        if x is None:
            os.remove(tmp_path / "config" / name)
        else:
            conf.Files(spark).write(f"file://{tmp_path}/config/{name}", x)
    with pytest.raises(conf.ConfigError):
        conf.load_timing(spark, f"file://{tmp_path}")


def test_timing_loads(spark, tmp_path):
    conf.write_timing(spark, f"file://{tmp_path}", " 2s\n", "100ms")
    t = conf.load_timing(spark, f"file://{tmp_path}")
    assert t.settle == timedelta(seconds=2.1) and t.advice


def test_config_rejects(made):
    for bad in ({"compression": "lzo"}, {"entity": ["sku"]}, {"entity": ["nope"], "version": "value"}, {"parts": {}}, {"views": [View("v", ("value",))]}, {"views": [View("v", ("sku",))] * 2}):
        with pytest.raises(ValueError):
            made(**bad)


def test_streaming_source(spark, made, tmp_path):
    store, _ = made(entity=["sku"], version="value")
    for k in range(3):
        store.write(df(spark, [("p", f"c{k}", "s", k), ("p", f"c{k}", "s", k)]))
    store.logs.add_refs(["refs/0-malformed.ref"])
    out = f"{tmp_path}/out"

    def each(entries, records, batch_id):
        records.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    def drain():
        # the clock of these writes lies ahead or behind: nothing waits to settle
        changes = source.read_changes(spark, store.reader, page=2)
        q = changes.writeStream.foreachBatch(source.with_records(store.reader, each)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()

    if datetime.now() < datetime(2026, 5, 2):
        pytest.skip("the source goes by the machine's clock")
    for _ in range(2):  # availableNow takes one page
        drain()
    read = lambda: sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect())
    assert read() == [0, 1, 2]
    store.write(df(spark, [("p", "c9", "s", 9)]))
    drain()
    assert read() == [0, 1, 2, 9]


def test_process_entries(spark, made):
    store, clock = made(entity=["sku"], version="value")
    for k in range(3):
        store.write(df(spark, [("p", f"c{k}", "s", k)]))
    clock.tick()
    got = []
    end = source.process_entries(spark, store.reader, "", lambda e, r: got.extend(values(r)), page=2)
    assert sorted(got) == [0, 1, 2] and source.process_entries(spark, store.reader, end, lambda e, r: got.append(None)) == end and None not in got


def test_counters(spark, made):
    store, _ = made()
    store.write(df(spark, ROWS))
    with pytest.raises(ValueError):
        store.read(["bad"])
    assert store.writer.counters["calls.write"] == 1 and store.writer.counters["records"] == 4
    assert store.reader.counters["errors.read"] == 1
    assert [r.value for r in store.read_iter(["*"], read_ahead=False)] == [1, 2, 3, 4]
