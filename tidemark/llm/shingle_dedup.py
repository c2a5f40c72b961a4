"""Near-duplicates by five-word similarity: the SimHash operator, widened and verified.

Texts whose sets of ``shingle``-word shingles are at least ``similarity``
alike (Jaccard) are linked, and documents that links connect are one group.

Candidates are texts that meet in a table.  The first tables are the covering
masks of ``near_dedup`` over the fingerprint of the same shingles: pairs within
``radius`` bits all meet.  Similarity 0.8 lies beyond: such pairs differ in 15 %
of a fingerprint's bits on average, and covering 11 of 64 bits would take 4,095
tables.  So the other tables are MinHash bands: texts that agree in all
``rows`` minima of one of ``bands`` bands, which a pair of similarity s does
with probability 1 - (1 - s^rows)^bands, 0.999995 at 0.8 and more above.
Every candidate is verified on the whole sets of shingles, as 64-bit hashes,
so no pair is linked that is less alike.

Scale: equal texts fold into one row before the search.  A text meets the one
with the least key in each of its tables first, which links a group of copies
by one pair a member.  Where a table's texts are still in several groups, small
tables (up to ``pair_limit`` texts) compare what is apart pair by pair; the
texts of larger ones are joined by their rarest shingles, of which two sets alike
share one: passages that many texts share meet nowhere, and no link is lost.
Each pair is verified once; sets are made once, of texts that meet another.

Defined results: as in ``near_dedup``; null and empty texts and texts without
words are alike, and a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import components
from tidemark.llm.near_dedup import keyed_texts, masks, one_of_each

_M = np.uint64(0x9E3779B97F4A7C15)
#: A hub's pairs are dealt to so many tasks.
SALTS = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingles of one text, hashed, in order."""
    # bytes.lower and bytes.split know ASCII only, as in near_dedup
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashed = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return np.array([hashed(b" ".join(w), seed)], np.uint64)
    each = np.fromiter((hashed(x, seed) for x in w), np.uint64, len(w))
    n = len(w) - shingle + 1
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h = h * _M + each[k : k + n]
    return np.unique(_mixed(h))


@cache
def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 64, count, np.uint64)[:, None] for _ in range(2))
    return a | np.uint64(1), b


def simhash(h: np.ndarray) -> int:
    """The fingerprint of a set of shingles: each bit's majority."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def mask_keys(h: np.ndarray, radius: int) -> np.ndarray:
    """A key for each covering table."""
    tables = np.array(masks(radius), np.uint64)
    return _mixed((np.uint64(simhash(h)) & tables) * _M - np.arange(1, len(tables) + 1, dtype=np.uint64))


def band_keys(h: np.ndarray, bands: int, rows: int, seed: int = 42) -> np.ndarray:
    """A key for each band: the minima of its ``rows`` hash functions, folded."""
    a, b = _functions(bands * rows, seed)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 512):  # parts that stay in the cache
        np.minimum(least, (a * h[k : k + 512] + b).min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = _mixed(key * _M + column)
    return key


def _mapped(docs: DataFrame, name: str, make: Callable[[str | None], tuple[int, np.ndarray]]) -> DataFrame:
    """(doc_id, tk, text) to (doc_id, tk, size, ``name``): a number and an array of longs for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):  # arrays of long texts are large
                part = batch.slice(k, 1000)
                made = [make(t.as_py()) for t in part.column(2)]
                ends = np.cumsum([0, *(len(x) for _, x in made)]).astype(np.int32)
                values = np.concatenate([x for _, x in made]).view(np.int64) if made else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in made], pa.int64()), lists], names=["doc_id", "tk", "size", name])

    return docs.mapInArrow(run, f"doc_id long, tk long, size long, {name} array<long>")


def _alike(x: Column, y: Column, similarity: float) -> Column:
    """Sizes that allow the similarity."""
    return F.least(x, y) + 1e-9 >= similarity * F.greatest(x, y)


def _pairs(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


class _Search:
    """Verified links between texts with ``sets`` (tk, h), each pair looked at once."""

    def __init__(self, sets: DataFrame, similarity: float) -> None:
        self.sets, self.similarity = sets, similarity
        self.seen: DataFrame | None = None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that were not looked at before and are alike."""
        pairs = pairs.distinct()
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        # the text that many others are compared with is a hub: its set is given to several tasks
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        hubs = salted.select("a", "salt").distinct().join(self.sets.select(F.col("tk").alias("a"), F.col("h").alias("ha")), "a")
        both = salted.join(self.sets.select(F.col("tk").alias("b"), F.col("h").alias("hb")), "b").join(hubs, ["a", "salt"])
        both = both.select("a", "b", (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("common"))
        return cut(both.where(F.col("common") + 1e-9 >= self.similarity * (F.col("n") - F.col("common"))).select("a", "b"))


def _by_rare_shingles(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of ``texts`` (tk, root) of different roots that share one of each other's rarest shingles.

    Every pair alike is among them: the first shingle that both have, in the
    order from rare to frequent, lies among the first (1 - similarity) n + 1 of
    each, with so many behind it in both that they can be alike.
    """
    h = sets.join(texts, "tk").select("tk", "root", F.size("h").alias("n"), F.explode("h").alias("x"))
    seen = h.groupBy("x").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # shingles that one text has alone link nothing, but come first in its order
    shared = h.join(seen, "x").groupBy("tk", "root", "n").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("s"))
    first = F.floor((1 - similarity) * F.col("n") + 1e-9) + 1 - (F.col("n") - F.size("s"))
    met = shared.where(first > 0).select("tk", "root", "n", F.size("s").alias("m"), F.posexplode(F.slice("s", 1, first.cast("int"))).alias("at", "s"))
    met = cut(met.select(F.col("s.x").alias("x"), "tk", "root", "n", (F.col("m") - F.col("at")).alias("left")))
    other = met.select("x", *[F.col(c).alias(f"{c}2") for c in ("tk", "root", "n", "left")])
    enough = F.least("left", "left2") * (1 + similarity) + 1e-9 >= similarity * (F.col("n") + F.col("n2"))
    return met.join(other, "x").where((F.col("tk") < F.col("tk2")) & (F.col("root") != F.col("root2")) & enough).select(*_pairs("tk", "tk2"))


def similar_groups(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    radius: int = 2,
    bands: int = 40,
    rows: int = 6,
    pair_limit: int = 32,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, tk, root) for every row of ``docs``; ``root`` tells groups apart."""

    def make(value: str | None) -> tuple[int, np.ndarray]:
        h = shingles(value, shingle)
        return len(h), np.concatenate([mask_keys(h, radius) if radius else h[:0], band_keys(h, bands, rows)])

    def make_set(value: str | None) -> tuple[int, np.ndarray]:
        h = shingles(value, shingle)
        return len(h), h

    src = keyed_texts(docs, doc_id, text)
    own = cut(_mapped(src, "keys", make))
    keys = own.dropDuplicates(["tk"]).select("tk", "size", F.explode("keys").alias("key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "size")).alias("p")).where("n > 1")
    met = cut(keys.join(full, "key").select("key", "tk", "size", "n", "p"))
    # one row of each text that meets another, asked for by text and id: copies are many keys, not one
    some_id = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    nodes = own.groupBy("tk").agg(F.min(some_id).alias("id")).join(met.select("tk").distinct(), "tk", "left_semi")
    texts = src.withColumn("id", some_id).join(nodes, ["tk", "id"], "left_semi").select("doc_id", "tk", "text").dropDuplicates(["tk"])
    sets = cut(_mapped(texts, "h", make_set).select("tk", "h"))
    search = _Search(sets, similarity)

    first = met.where((F.col("tk") != F.col("p.tk")) & _alike(F.col("size"), F.col("p.size"), similarity))
    links = search.verified(first.select(*_pairs("tk", "p.tk")))
    roots = components(links)
    placed = met.join(roots.withColumnRenamed("node", "tk"), "tk", "left").select("key", "tk", "size", "n", F.coalesce("root", "tk").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    apart = cut(placed.join(apart, "key"))
    small, large = apart.where(F.col("n") <= pair_limit), apart.where(F.col("n") > pair_limit)
    x = small.select("key", F.col("tk").alias("x"), F.col("size").alias("xs"), F.col("root").alias("xr"))
    found = small.join(x, "key").where((F.col("x") < F.col("tk")) & (F.col("xr") != F.col("root")) & _alike(F.col("xs"), F.col("size"), similarity))
    more = _by_rare_shingles(large.select("tk", "root").distinct(), sets, similarity)
    links = search.verified(found.select(*_pairs("x", "tk")).unionByName(more))
    # what was found before is stars already
    roots = components(links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return own.join(roots.withColumnRenamed("node", "tk"), "tk", "left").select("doc_id", "tk", F.coalesce("root", "tk").alias("root"))


def deduplicate_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, pair_limit: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group, as ``one_of_each`` takes it."""
    return one_of_each(docs, similar_groups(docs, similarity, shingle, pair_limit=pair_limit, doc_id=doc_id, text=text), doc_id, text)
