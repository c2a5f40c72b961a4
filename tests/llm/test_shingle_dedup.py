"""Shingle near-duplicates against brute force, alone and as the pipeline's stage."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import shingle_dedup


def copies():
    """Texts with copies that change some words, copies of copies among them."""
    r = random.Random(11)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(300))
    out = []
    for _ in range(12):
        first = [word() for _ in range(r.choice((40, 120, 250)))]
        out += [first, [w.upper() for w in first]]
        for changes in (1, 1, 2, 3, 4, 6, 8):
            w = list(r.choice((first, out[-1])))
            for _ in range(changes):
                w[r.randrange(len(w))] = word()
            out.append(w)
    texts = [" ".join(w) for w in out] + ["", None, " \t", "a b", "A  b", "a b c"]
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)]


def five(t):
    w = (t or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def parts(texts):
    """The texts' groups: those that links connect."""
    left, out = {t: five(t) for t in texts}, []
    while left:
        t, s = left.popitem()
        group, todo = {t}, [s]
        while todo:
            s = todo.pop()
            near = [u for u in left if alike(s, left[u])]
            group |= set(near)
            todo += [left.pop(u) for u in near]
        out.append(group)
    return out


@pytest.mark.parametrize("limit", [1, 4, 32])
def test_similar_groups(spark, limit):
    rows = copies()
    expected = parts({t for _, t in rows})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_key = collections.defaultdict(set)
    for r in df.select(F.xxhash64("text").alias("tk"), "text").collect():
        by_key[r.tk].add(r.text)
    got = shingle_dedup.similar_groups(df, pair_limit=limit).collect()
    assert len(got) == len(rows)
    found = collections.defaultdict(set)
    for r in got:
        found[r.root] |= by_key[r.tk]
    assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in expected}


def test_pipeline_stage_leaves_one_of_each_group(spark):
    import corpus_pipeline

    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    least = lambda g: min((i for t in g for i in ids[t] if i is not None), default=None)
    expected = parts({t for _, t in rows})
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in kept), key=key) == sorted(map(least, expected), key=key)
    assert not any(alike(five(a.text), five(b.text)) for a, b in itertools.combinations(kept, 2))


def test_stage_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_dedup.deduplicate_similar(none).count() == 0


def test_long_text_has_all_shingles():
    words = [f"w{k}" for k in range(5000)]
    assert len(shingle_dedup.shingles(" ".join(words))) == 4996
    a, b = (shingle_dedup.shingles(" ".join(w)) for w in (words, words[:4000]))
    assert len(set(a.tolist()) & set(b.tolist())) == 3996


def test_simhash_is_the_majority():
    h = shingle_dedup.shingles(" ".join(f"w{k}" for k in range(100)))
    bits = [sum(int(x) >> i & 1 for x in h) for i in range(64)]
    assert shingle_dedup.simhash(h) == sum(1 << i for i in range(64) if 2 * bits[i] > len(h))


def test_rare_shingles_miss_no_pair(spark):
    r = random.Random(5)
    sets = {}
    for g in range(6):
        base = [r.randrange(1 << 40) for _ in range(40)]
        for _ in range(12):
            own = set(base) - set(r.sample(base, r.randrange(8))) | {r.randrange(1 << 40) for _ in range(r.randrange(6))}
            sets[len(sets)] = sorted(own)
    df = spark.createDataFrame(list(sets.items()), "tk long, h array<long>")
    got = {(x.a, x.b) for x in shingle_dedup._by_rare_shingles(df.select("tk", F.col("tk").alias("root")), df, 0.8).distinct().collect()}
    alike_pairs = {(a, b) for a, b in itertools.combinations(sets, 2) if alike(set(sets[a]), set(sets[b]))}
    assert alike_pairs and alike_pairs <= got
    assert len(got) < 6 * 12 * 11 / 2
