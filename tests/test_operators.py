import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import keys
from tidemark.operators import batches, stream, views
from tidemark.operators.dedup import dedup, history, latest, ordered
from tidemark.operators.projection import zero_fill

DEDUP = "p string, entity string, ver long, payload string, n long"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_latest_and_history(spark):
    df = spark.createDataFrame([("p", "a", 1, "a-1", 0), ("p", "b", 5, "b-5", 1), ("p", "a", 3, "a-3", 2), ("p", "b", 2, "b-2", 3), ("p", "c", 0, "c-0", 4), ("q", "a", 1, "q-a", 5)], DEDUP)
    assert rows(latest(df, ["p"], ["entity"], "ver", ["n"]), "payload") == [("a-3",), ("b-5",), ("c-0",), ("q-a",)]
    tie = spark.createDataFrame([("p", "a", 5, "first", 0), ("p", "a", 5, "second", 1)], DEDUP)
    assert rows(latest(tie, ["p"], ["entity"], "ver", ["n"]), "payload") == [("second",)]
    assert rows(history(tie, ["p"], ["entity"], "ver", ["n"]), "payload") == [("first",)]
    assert dedup(df, ["p"], [], None).count() == 6
    assert [r.payload for r in ordered(df, "p", ["entity"], "ver").collect()] == ["a-1", "a-3", "b-2", "b-5", "c-0", "q-a"]


def test_latest_keeps_one_row_per_group_before_the_shuffle(spark):
    df = spark.createDataFrame([("p", "a", 1, "x", 0)], DEDUP)
    assert "WindowGroupLimit" in latest(df, ["p"], ["entity"], "ver")._jdf.queryExecution().toString()


def test_zero_fill(spark):
    schema = T.StructType(
        [
            T.StructField("s", T.StringType()), T.StructField("n", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("x", T.BinaryType()), T.StructField("y", T.ByteType()),
            T.StructField("d", T.DecimalType(18, 6)), T.StructField("a", T.ArrayType(T.StructType([T.StructField("k", T.LongType())]))), T.StructField("m", T.MapType(T.StringType(), T.StringType())),
            T.StructField("z", T.StructType([T.StructField("i", T.LongType())])), T.StructField("o", T.LongType()), T.StructField("t", T.TimestampType()),
        ]
    )
    r = zero_fill(spark.createDataFrame([("v", "extra")], "s string, more string"), schema, ("o",)).withColumn("t", F.col("t").cast("string")).first()
    assert (r.s, r.n, r.f, r.b, bytes(r.x), r.y, float(r.d), r.a, r.m, r.z.i, r.o, r.t) == ("v", 0, 0.0, False, b"", 0, 0.0, [], {}, 0, None, "0001-01-01 00:00:00")


def log(spark, n, seed):
    """Random refs, some uncommitted, some of another attempt, some malformed."""
    r = random.Random(seed)
    refs, commits = [], []
    for k in range(n):
        attempt, us, key = f"{r.getrandbits(128):032x}", 1700000000000000 + r.randrange(50), f"p={r.randrange(4)}"
        token = f"t{k}"
        refs.append((f"{keys.REFS}{us:016d}-{token}-{attempt};{key}.ref",))
        if (kind := r.random()) < 0.6:
            commits.append((key, token, attempt, us, us, k))
        elif kind < 0.75:
            commits.append((key, token, "0" * 32, us, us, k))
    refs.append((f"{keys.REFS}0-malformed.ref",))
    names = stream.decode_refs(spark.createDataFrame(refs, "ref_key string"))
    return refs, commits, names, spark.createDataFrame(commits, "partition string, token string, attempt_id string, ref_micro_ts long, inserted_at_us long, row_count long")


@pytest.mark.parametrize("seed", [1, 2])
def test_poll_pages_cover_the_stream(spark, seed):
    refs, commits, names, table = log(spark, 25, seed)
    good = {(c[1], c[2]) for c in commits}
    passes = lambda k: any(f"-{t}-{a};" in k for t, a in good)
    cutoff, until = 1700000000000040, keys.offset_at(1700000000000035)
    for page in (1, 4, 100):
        at, seen = "", []
        while True:
            found = stream.poll(names, table, at, page, until, cutoff)
            visible = sorted(k for (k,) in refs if k > at and k < until and k <= keys.offset_at(cutoff))
            expected, end = [], at
            for k in visible:
                if len(expected) == page:
                    break
                end = k
                expected += [k] * passes(k)
            got = [r.offset for r in found.entries.collect()]
            assert (got, found.next_offset) == (expected, end)
            if found.next_offset == at:
                break
            at, seen = found.next_offset, seen + got
        assert sorted(seen) == sorted(r.offset for r in stream.poll_range(names, table, "", until, cutoff).collect())
    with pytest.raises(ValueError):
        stream.poll(names, table, max_entries=0)


def test_gate_takes_one_attempt(spark):
    data = spark.createDataFrame([("p", "t", "a", 1), ("p", "t", "b", 2), ("p", "u", "c", 3), ("q", "t", "d", 4)], "partition string, token string, attempt_id string, v long")
    commits = spark.createDataFrame([("p", "t", "b"), ("p", "t", "b"), ("q", "t", "x")], "partition string, token string, attempt_id string")
    assert rows(stream.gate(data, commits), "v") == [(2,)]


def test_batches(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1)], "p string, v long")
    found = batches.group_by_partition(df, keys.hive_key({"p": F.col("p")}), ["v"]).orderBy("key").collect()
    assert [(r.key, [x.v for x in r.rows]) for r in found] == [("p=a", [1]), ("p=b", [1, 2])]
    other = spark.createDataFrame([("b", 9)], "p string, v long")

    def both(left, right):
        import pyarrow as pa

        return pa.table({"n": [left.num_rows * 10 + right.num_rows]})

    assert rows(batches.zip_partitions(df, other, F.col("p"), F.col("p"), both, "n long"), "n") == [(10,), (21,)]
    assert [(k, len(v)) for k, v in batches.partitions(df.select(F.col("p").alias("hive_key"), "v").orderBy("hive_key"))] == [("a", 1), ("b", 2)]


def test_views(spark):
    df = spark.createDataFrame([("s1", "2026-03-17", "a"), ("s1", "2026-03-17", "b"), ("s1", "2026-03-18", "a"), ("s2", "2026-03-17", "a"), ("s1", "2026-03-17", "a")], "sku string, period string, customer string")
    v = views.View("v", ("sku", "period", "customer"))
    v.check(df.schema)
    t = views.distinct_tuples(df, v)
    count = lambda p: views.lookup(t, v.columns, [p]).count()
    assert [count(p) for p in ("*", "sku=s1/period=2026-03-17/customer=*", "sku=s1/period=2026-03-01..2026-04-01/customer=*", "sku=s999/*/*")] == [4, 2, 3, 0]
    lossy = views.lookup(t, v.columns, ["*"], lambda x: x.select("sku"))
    assert lossy.count() == 4
    assert views.distinct_tuples(df, views.View("w", ("sku",), where=F.col("customer") == "b")).count() == 1
    for bad in (("a/b", "p", "c"), ("", "p", "c"), ("x" * 1001, "p", "c"), (None, "p", "c")):
        with pytest.raises(Exception, match="view v"):
            views.distinct_tuples(spark.createDataFrame([bad], df.schema), v).collect()
    timed = spark.sql("SELECT timestamp'2026-03-17 01:02:03' AS at, 's' AS sku, 1 AS n")
    m = views.View("m", ("at",), layouts={"at": "yyyy-MM"})
    m.check(timed.schema)
    assert rows(views.distinct_tuples(timed, m), "at") == [("2026-03",)]
    assert str(views.lookup(views.distinct_tuples(timed, m), ("at",), ["at=2026*"], layouts=m.layouts).first().at) == "2026-03-01 00:00:00"
    for bad in (lambda: views.View("a/b", ("x",)), lambda: views.View("", ("x",)), lambda: views.View("a", ()), lambda: views.View("a", ("x",), of={"y": F.lit(1)})):
        with pytest.raises(ValueError):
            bad()
    for columns in (("at",), ("n",), ("missing",)):
        with pytest.raises(ValueError):
            views.View("a", columns).check(timed.schema)


@pytest.mark.parametrize("seed", range(4))
def test_random_reads_against_a_model(spark, seed):
    from tidemark.functions import patterns

    r = random.Random(seed)
    data = [(r.choice(["a", "ab", "b", "日"]), r.choice(["x", "y", "xy"]), f"e{r.randrange(4)}", r.randrange(5), k) for k in range(80)]
    df = spark.createDataFrame(data, "p string, c string, entity string, ver long, n long")
    segment = lambda part, v: r.choice(["*", f"{part}={v}", f"{part}={v[0]}*", f"{part}={v}..", f"{part}=..{v}"])
    found = [f"{segment('p', r.choice(['a', 'ab', 'b', '日']))}/{segment('c', r.choice(['x', 'y']))}" for _ in range(r.randint(1, 3))]
    kept = [x for x in data if any(patterns.matches(f"p={x[0]}/c={x[1]}", f, ["p", "c"]) for f in found)]
    read = df.where(patterns.predicate(found, {"p": F.col("p"), "c": F.col("c")}))
    last, first = {}, {}
    for x in sorted(kept, key=lambda x: (x[3], x[4])):
        last[x[:3]] = x
        first.setdefault(x[:4], x)
    assert rows(latest(read, ["p", "c"], ["entity"], "ver", ["n"]), "p", "c", "entity", "ver", "n") == sorted(last.values())
    assert rows(history(read, ["p", "c"], ["entity"], "ver", ["n"]), "p", "c", "entity", "ver", "n") == sorted(first.values())
