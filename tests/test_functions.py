from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import keys, patterns
from tidemark.functions.durations import parse_duration

PARTS = ["period", "customer"]
# Patterns that must be taken or turned away, and what they must match.
GOOD = ["", "*", "*/*", "period=a/customer=b", "period=a*/customer=*", "period=/customer=b", "period=a..b/*", "period=a../*", "*/customer=..b", "period=a..a/*", "period=a=b/*", "period=日本/*"]
BAD = ["period=a", "*/*/*", "customer=a/period=b", "period=a*b/*", "period=**/*", "period=a?/*", "period=[a]/*", "period={a}/*", "period=../*", "period=a..b..c/*", "period=a*..b/*", "period=b..a/*", "period=a.../*", "x/*", "period/*"]


@pytest.mark.parametrize("p", GOOD)
def test_pattern_accepted(p):
    assert len(patterns.parse(p, PARTS)) == 2


@pytest.mark.parametrize("p", BAD)
def test_pattern_rejected(p):
    with pytest.raises(patterns.PatternError):
        patterns.parse(p, PARTS)


def test_pattern_list_errors_name_place_and_text():
    with pytest.raises(patterns.PatternError, match="pattern 1 .*period=a"):
        patterns.parse_all(["*", "period=a"], PARTS)


ROWS = [("2026-03-17", "abc"), ("2026-03-17", "def"), ("2026-03-18", "abc"), ("2026-04-01", "abc")]
CASES = {
    "period=2026-03-17/customer=abc": 1, "*/customer=abc": 3, "period=2026-03-17/*": 2, "period=2026-03-*/customer=abc": 2, "period=2026-03-01..2026-04-01/*": 3,
    "period=2026-03-17..2026-03-18/*": 2, "period=2026-03-18../*": 2, "period=..2026-03-18/*": 2, "*": 4, "period=/customer=abc": 0,
}


def test_pattern_predicates(spark):
    df = spark.createDataFrame(ROWS, "period string, customer string")
    columns = {p: F.col(p) for p in PARTS}
    for p, n in CASES.items():
        assert df.where(patterns.predicate([p], columns)).count() == n, p
        assert sum(patterns.matches(f"period={a}/customer={b}", p, PARTS) for a, b in ROWS) == n
    assert df.where(patterns.predicate(["*", "period=2026-03-17/*"], columns)).count() == 4
    assert df.where(patterns.predicate([], columns)).count() == 0
    diagonal = ["period=2026-03-17/customer=def", "period=2026-03-18/customer=abc"]
    assert df.where(patterns.predicate(diagonal, columns)).count() == 2


text = st.text(st.characters(codec="utf-8", exclude_characters="/?[]{}*"), max_size=4).filter(lambda x: ".." not in x and not x.startswith(".") and not x.endswith("."))


@settings(max_examples=200, deadline=None)
@given(text, text, text)
def test_ranges_compare_bytes(v, low, high):
    if not (low or high) or low and high and low.encode() > high.encode():
        return
    s = patterns.parse(f"period={low}..{high}/*", PARTS)[0]
    assert s.matches(v) == (v.encode() >= low.encode() and (not high or v.encode() < high.encode()))


def test_parts_values_keys():
    for bad in ([], ["a", "a"], [""], ["a=b"], ["a/b"]):
        with pytest.raises(patterns.PatternError):
            patterns.check_parts(bad)
    for bad in ("", "a/b", "a..b"):
        with pytest.raises(patterns.PatternError):
            patterns.check_value(bad)
    for good in ("a=b", "日本", "x y:z", "50%off", "."):
        patterns.check_value(good)
    assert patterns.check_key("period=a=b/customer=c", PARTS) == {"period": "a=b", "customer": "c"}
    for bad in ("period=a", "period=/customer=c", "customer=c/period=a", "period=a/customer=b/x=c", "period=a/customer"):
        with pytest.raises(patterns.PatternError):
            patterns.check_key(bad, PARTS)


def test_ref_keys_round_trip(spark):
    found = ["period=a/customer=b", "a;b", "50%", "x/y?z", "日本", "a b", "a+b", "*~$&:@=", ";", "é%3B"]
    df = spark.createDataFrame([(1711111111000000 + k, f"tok-{k}", "ab" * 16, x) for k, x in enumerate(found)], "us long, token string, attempt string, key string")
    df = df.withColumn("ref", keys.ref_key(F.col("us"), F.col("token"), F.col("attempt"), F.col("key"))).withColumn("r", keys.parse_ref_key(F.col("ref")))
    rows = df.collect()
    assert all((x.r.ref_micro_ts, x.r.token, x.r.attempt_id, x.r.partition) == (x.us, x.token, x.attempt, x.key) for x in rows)
    assert sorted(x.ref for x in rows) == [x.ref for x in sorted(rows, key=lambda x: x.us)]


def test_malformed_refs(spark):
    a = "ab" * 16
    bad = ["0-malformed.ref", "", "x", f"123-t-{a};k.ref", f"1711111111000000-{a};k.ref", f"1711111111000000-t-{a}", f"1711111111000000-t-{a};.ref", f"1711111111000000-t-{a};%zz.ref", f"1711111111000000-t-{a[:-1]};k.ref", f"1711111111000000-t-{a.upper()};k.ref"]
    df = spark.createDataFrame([(x,) for x in bad], "ref string").select(keys.parse_ref_key(F.col("ref")).alias("r"))
    assert [x.r for x in df.collect()] == [None] * len(bad)


def test_tokens_and_attempts():
    for bad in ("", "a/b", "a;b", "a..b", "a b", "é", "x" * 201, "a\n"):
        with pytest.raises(ValueError):
            keys.check_token(bad)
    keys.check_token("x" * 200)
    ids = [keys.new_id() for _ in range(50)]
    assert len(set(ids)) == 50 and all(keys.ATTEMPT.fullmatch(i) and i[12] == "7" for i in ids)
    assert keys.parse_commit_name("a-b-" + ids[0]) == ("a-b", ids[0])
    for bad in ("", ids[0], "a" + ids[0], "a-" + ids[0][:-1], "a-" + ids[0].upper() + "x"):
        with pytest.raises(ValueError):
            keys.parse_commit_name(bad)


def test_offsets():
    t = datetime(2026, 3, 17, 1, 2, 3, 456789)
    assert keys.from_micros(keys.micros(t)) == t
    ref = keys.offset_at(t) + "-t"
    assert keys.offset_at(t) < ref < keys.offset_at(t + timedelta(microseconds=1))


@pytest.mark.parametrize("text,us", [("1h2m3.5s", 3723500000), ("250ms", 250000), ("10us", 10), ("1µs", 1), ("1500ns", 1), ("0", 0), ("-2s", -2000000), (".5s", 500000)])
def test_durations(text, us):
    assert parse_duration(text) == timedelta(microseconds=us)


@pytest.mark.parametrize("text", ["", "5", "s", "1 s", "1d", "1h-2m", "abc"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)
