"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the majority of the 64-bit hashes of its word
shingles, bit by bit.  Fingerprints within ``radius`` bits are linked, and
documents that links connect are one group.

Candidates come from structured bit masks (Pagh, "CoveringLSH").  Bit ``i``
gets a non-zero vector m(i) of radius + 1 bits; the table of mask vector v,
one for each of the 2^(radius+1) - 1 non-zero vectors, compares the bits
whose m(i) has an odd product with v.  The vectors of any ``radius`` differing
bits leave some v orthogonal to all of them, so every pair within the radius
agrees in all compared bits of some table: nothing is missed, and no
parameter trades recall for speed.

Scale: texts are read once and shuffled never; equal fingerprints fold into
one row before the search, so copies cost nothing there.  What a row gets back,
its group, comes by a join on the fingerprint, which adaptive execution splits
where one fingerprint bears a large share of all rows.  A bucket of up to
``pair_limit`` distinct fingerprints compares its pairs.  A larger one takes
an exact way that is linear in its members: two fingerprints within two bits
share a point at most one bit from both, so each member emits its neighbours
in the bits that the table leaves free and those that meet in a point are
linked.  A point has at most 65 such members, however large the bucket.

Defined results: null and empty texts and texts without words have
fingerprint zero and link like any other; a text of fewer words than a
shingle is one shingle; null identifiers are never the smallest, and a group
of null identifiers only has a null component; repeated rows stay; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Sealed, cut, pick, read, row_key
from tidemark.llm.components import components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    # bytes.lower and bytes.split know ASCII only, which is what is asked for
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return hashed(b" ".join(w), seed)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = (ends - np.fromiter(map(len, w), np.int64, len(w)) - 1)[: 1 - shingle].tolist()
    n = len(starts)
    counts = np.zeros(BITS, np.int64)
    stops = (ends[shingle - 1 :] - 1).tolist()
    step = 1 << 16  # very long texts are added up in parts
    for k in range(0, n, step):
        h = np.fromiter((hashed(line[a:b], seed) for a, b in zip(starts[k : k + step], stops[k : k + step], strict=True)), np.uint64, min(step, n - k))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tk, text); tk is a hash of the text."""
    return pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("tk"), F.col("text").cast("string"))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tk, fp): each row's text key (a hash) and fingerprint, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "tk", "fp"])

    src = keyed_texts(docs, doc_id, text)
    return src.mapInArrow(run, "doc_id long, tk long, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The compared bits of each table."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2, pair_limit: int = 32) -> DataFrame:
    """(a, b) such that distinct fingerprints within ``radius`` bits are connected.

    Every row is a true link, or two fingerprints that share a point one bit
    from each; not every link is a row.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2: larger buckets are searched through points one bit away")
    tables = masks(radius)
    keyed = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables)])
    keys = distinct.select("fp", F.explode(keyed).alias("k")).select("fp", "k.t", "k.key")
    full = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(keys.join(full, ["t", "key"]).select("t", "key", "fp", "n"))

    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    small = met.where(F.col("n") <= pair_limit).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.filter("s", lambda y, j: (j > i) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    large = met.where(F.col("n") > pair_limit)
    flips = {t: [0, *(_signed(1 << i) for i in range(BITS) if not m >> i & 1)] for t, m in enumerate(tables)}
    flip = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in flips[t]]) for t in range(len(tables))]), F.col("t").cast("int") + 1)
    points = large.select("fp", F.explode(flip).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("point"))
    meet = points.groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("s")).where(F.size("s") > 1)
    if radius == 1:  # of those around a point only the point itself is a link
        meet = meet.where(F.array_contains("s", F.col("point")))
        star = meet.select(F.col("point").alias("a"), F.explode("s").alias("b")).where("a <> b")
    else:
        star = meet.select(F.col("s")[0].alias("a"), F.explode(F.slice("s", 2, BITS + 1)).alias("b"))
    return small.unionByName(star).distinct()


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3, pair_limit: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tk, fp, root, component_id) for every row of ``docs``.

    ``root`` tells groups apart (it is the smallest fingerprint of each);
    ``component_id`` is the group's smallest id.
    """
    own = cut(fingerprints(docs, shingle, doc_id=doc_id, text=text))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, radius, pair_limit))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = known.join(least, "root").select("fp", "root", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "tk", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each of ``groups`` (doc_id, tk, root).

    It is the row with the smallest id, null ids last; of rows with one id
    that with the smallest text key; of rows equal in both that with the
    smallest hash of all columns.
    """
    last = F.lit((1 << 63) - 1)
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("_i"), F.col("tk").alias("_tk"))).alias("k")).select("k._i", "k._tk")
    table = Sealed(docs, i=doc_id, text=text)
    keyed = table.df.select("d", F.coalesce(F.col("i").cast("long"), last).alias("_i"), F.xxhash64(F.col("text").cast("string")).alias("_tk"))
    one = keyed.join(chosen, ["_i", "_tk"], "left_semi").groupBy("_i", "_tk").agg(F.min_by("d", row_key()).alias("d"))
    return one.select(*table.open())


def deduplicate(docs: DataFrame, radius: int = 2, shingle: int = 3, pair_limit: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of fingerprints, as ``one_of_each`` takes it."""
    return one_of_each(docs, near_groups(docs, radius, shingle, pair_limit, doc_id, text), doc_id, text)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every row of ``documents``."""
    df = near_groups(read(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
