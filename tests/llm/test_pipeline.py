"""The pipeline's stages one after another, on odd rows with odd columns, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, packing, quality_rules

#: Names that the stages use themselves, with dots, and close to others.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "q__w", "q_kept", "q_n_words", "a.b", "tk", "d", "root", "whole", "spans", "size", "c0", "text2"]


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def corpus():
    r = random.Random(23)
    stop = ["the", "of", "and", "to", "in"]
    word = lambda: r.choice(stop) if r.random() < 0.3 else "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(r.randint(55, 260))) for _ in range(50)]
    near = texts[0].split()
    near[7] = "changed"
    texts += [" ".join(near), texts[1].upper(), texts[2] + " more words here", "  " + texts[3].replace(" ", "\n ") + "\t", "too few words", "", None, " \n", "## " * 80, "same same same " * 40]
    texts += [" ".join(word() for _ in range(9000)), "é日本 the of " * 3 + texts[4]]
    rows = [[k, t, "en", r.choice(["a", "b", None, "é"]), len(t or "")] for k, t in enumerate(texts)]
    rows += [rows[5][:], rows[5][:], [None, texts[6], None, None, None], [None] * 5, [8, texts[9], "de", "a", 0], [8, texts[8], "xx", "zzz", 0]]
    return [tuple([*x, *[f"{c}{k}" for c in COLUMNS[5:]]]) for k, x in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    kinds = {"doc_id": "long", "n_chars": "long"}
    return spark.createDataFrame(corpus(), ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in COLUMNS)).repartition(3)


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """What each stage was given and what it returned."""
    out, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, at, "").write.parquet(path)
        given, at = at, spark.read.parquet(path)
        out[name] = ([tuple(r) for r in given.collect()], [tuple(r) for r in at.collect()], at.columns)
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def good(t):
    w = split(t)
    if len(w) < 50:
        return False
    threes = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if split(x)]
    share = {
        "n_words": len(w),
        "repeat_ratio": len(repeated) / len(w),
        "mean_word_length": sum(map(len, w)) / len(w),
        "symbol_ratio": sum(c in "#*$%&|<>" for c in t) / len(w),
        "stop_ratio": sum(x.lower() in quality_rules.STOP for x in w) / len(w),
        "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
    }
    return all((r.low is None or share[r.measure] >= r.low) and (r.high is None or share[r.measure] <= r.high) for r in quality_rules.RULES)


def test_quality(stages):
    given, kept, columns = stages["quality_rules"]
    assert columns == COLUMNS
    assert sorted(kept, key=key) == sorted((r for r in given if good(r[1])), key=key)
    assert 40 < len(kept) < len(given)


def five(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(t)]
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_duplicates(stages):
    given, kept, columns = stages["near_dedup"]
    assert columns == COLUMNS and set(kept) <= set(given)
    texts = {r[1]: five(r[1]) for r in given}
    group = {t: t for t in texts}

    def find(t):
        while group[t] != t:
            t = group[t]
        return t

    for a in texts:
        for b in texts:
            if 5 * len(texts[a] & texts[b]) >= 4 * len(texts[a] | texts[b]):
                group[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for r in given:
        groups[find(r[1])].append(r)
    assert collections.Counter(find(r[1]) for r in kept) == collections.Counter(groups.keys())
    some = lambda i: (1 << 63) if i is None else i
    for r in kept:
        assert some(r[0]) == min(some(x[0]) for x in groups[find(r[1])])
    assert len(kept) < len(given)


def test_mixing(spark, stages):
    given, taken, columns = stages["mixing"]
    assert columns == COLUMNS
    by_id = collections.defaultdict(list)
    for r in given:
        by_id[r[0], r[3]].append(r)
    words = collections.Counter()
    for r in taken:
        own = [g for g in by_id[r[0], r[3]] if g[5:] == r[5:]]
        assert len(own) == 1 and r[2] == own[0][2] and r[4] == len(r[1])
        # the words of one pass are those of the text, in order, some left out
        rest = iter(split(own[0][1]))
        assert all(w in rest for w in split(r[1]))
        words[own[0]] += len(split(r[1]))
    assert all(n <= 2 * len(split(r[1])) for r, n in words.items())
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in given], "doc_id long, text string, source string")
    whole = mixing.taken_words(df).agg(F.sum("taken")).first()[0]
    assert sum(words.values()) == whole


def test_packing(stages):
    from tokenizers import Tokenizer
    import public_tokenizers

    given, packed, _ = stages["packing"]
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for r in given:
        ids = np.array([*full.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(r[0], k, min(2048, len(ids) - k), zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048)]
    assert sorted((p[:5] for p in packed), key=key) == sorted(expected, key=key)
    by = collections.defaultdict(list)
    for p in packed:
        by[p[5]].append((p[6], p[2]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_stages_without_rows(spark, docs):
    at = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "")
        assert at.count() == 0


def test_columns_that_differ_in_case(spark, docs):
    """Such a table can be read where names keep their case; stages take the exact names."""
    odd = docs.toDF(*[{"text2": "Text", "tk": "DOC_ID", "d": "SOURCE"}.get(c, c) for c in COLUMNS])
    few = odd.limit(5)
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.mixing):
        assert stage(spark, few, "").columns == odd.columns
    assert corpus_pipeline.packing(spark, few, "").count() >= 5
