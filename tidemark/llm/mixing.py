"""Mixing sources to target weights over fixed-length blocks of words.

Each source's documents, in a fixed order, are one stream of words cut into
blocks of one length (``block_words``, less for sources of few words, so that
a target is met within a small part of a source).  A source's target is a
number of slots.  Output shards of ``shard_slots`` slots draw their sources
at random, every slot of them: the counts of a shard are a multinomial draw
in which each draw takes one of the slots still left, so that shards vary as
draws do and all shards together meet every target.  It is drawn for all
shards at once, by one pseudorandom permutation of all slots.  Slot ``j`` of a
source takes block ``permutation(j mod blocks)`` of pass ``j div blocks``, and
blocks are joined to slots by index.  No pass takes a block twice and there
are at most ``max_passes`` passes, which bounds how often a document is
repeated.

Only DataFrame functions are used.  Nothing is keyed by source alone: prefix
sums run inside buckets of some ``docs_per_bucket`` documents, over the
buckets of a chunk, then over chunks; slots are made in chunks too.  Equal
rows are one row with a count until words are given out.  What is known of a
source is a row of a table, broadcast only behind a count; the driver sees
sums.  Permutations are swap-or-not networks (Hoang, Morris and Rogaway) after
an affine map: exact on any number of blocks.

Defined results: null texts have no words; a null source is a source of its
own, after all others; documents without words take nothing; null identifiers
are kept; repeated rows are streams' parts of their own; a source without
words has target 0; an empty table gives an empty table; extra columns are
ignored (``mixed_documents`` keeps them).  Equal input gives equal output.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import SPACE, Sealed, cut, pick, read, row_key, words


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)
    #: The mix's words as a multiple of all words.
    budget: float = 1.5
    #: No source's target, and no document, goes beyond this multiple of its words.
    max_passes: int = 2
    block_words: int = 64
    #: A source has so many blocks at least, if it has the words.
    least_blocks: int = 64
    shard_slots: int = 4096
    docs_per_bucket: int = 256
    #: Buckets of one chunk, sources of one chunk, and slots made in one row.
    chunk: int = 4096
    rounds: int = 6
    #: Up to so many sources their table is broadcast.
    broadcast_sources: int = 10_000
    seed: int = 20240229


def _multiplier(blocks: Column, seed: int) -> Column:
    """A prime below 2^20 that does not divide ``blocks``, so that products of it and an index fit a long."""
    turn = seed % len(PRIMES)
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES[turn:] + PRIMES[:turn]])
    return F.element_at(F.filter(primes, lambda p: blocks % p != 0), 1)


def _primes(count: int, above: int) -> tuple[int, ...]:
    out, n = [], above | 1
    while len(out) < count:
        if all(n % k for k in range(3, math.isqrt(n) + 1, 2)):
            out.append(n)
        n += 2
    return tuple(out)


#: Numbers of blocks below 2^63 have fewer than so many of these as divisors.
PRIMES = _primes(4, 600_000)


def permuted(x: Column, size: Column, seed: int, *key: Column, rounds: int = 6) -> Column:
    """Where a pseudorandom permutation of 0 .. size - 1, one for each ``key``, takes ``x``."""
    coin = lambda *more: F.xxhash64(F.lit(seed), *key, *more)

    def swap_or_not(v: Column, i: Column) -> Column:
        y = F.pmod(F.pmod(coin(i), size) - v, size)
        return F.when(coin(i, F.greatest(v, y)).bitwiseAND(1) == 1, y).otherwise(v)

    first = F.pmod(_multiplier(size, seed) * x + F.pmod(coin(F.lit(-1)), size), size)
    # a fold, so that a round's result is computed once; nested columns would double with each round
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), first, swap_or_not)


def _ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df``, whose order has no ties, with ``s``: its place in that order, from 0."""
    spark = df.sparkSession
    # the place inside a partition is in the id's lower 33 bits; partitions are counted, a number each
    placed = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return placed.join(base, "part").withColumn("s", F.col("base") + F.col("at")).drop("id", "part", "at", "base")


class Mixer:
    """The tables of one mix of ``docs`` (doc_id, text, source)."""

    def __init__(self, docs: DataFrame, mix: Mix = Mix()) -> None:
        self.mix, self.spark = mix, docs.sparkSession
        skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
        keyed = pick(docs, doc_id="doc_id", text="text", source="source").select("doc_id", _text_key().alias("tk"), F.size(words(F.col("text"))).cast("long").alias("size"), skey.alias("skey"))
        # equal rows are one with a count: partial counts before the shuffle, so a row that a third of all repeat is no hot key
        self.rows = cut(keyed.groupBy("doc_id", "tk", "size", "skey").agg(F.count(F.lit(1)).alias("copies")))
        per_source = self.rows.groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))
        per_source = _ranked(per_source.withColumn("last", F.col("skey") == "n"), "last", "skey").drop("last")
        self.n_docs, n_sources, total = per_source.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
        w = F.get(F.array(*[F.lit(float(x)) for x in mix.weights]), F.pmod("s", F.lit(len(mix.weights))).cast("int"))
        per_source = per_source.withColumn("w", w)
        level = self._level(per_source, mix.budget * total)
        cap = mix.max_passes * F.col("source_size")
        target = F.when(F.col("source_size") == 0, 0.0).when(F.lit(level) * F.col("w") > cap, cap.cast("double")).otherwise(F.lit(level) * F.col("w"))
        length = F.least(F.lit(mix.block_words).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / mix.least_blocks)))
        df = per_source.withColumn("target", target).withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
        # the last block may be short; passes are full up to the cap
        n = F.least(mix.max_passes * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1))).cast("long"))
        df = df.withColumn("n", F.coalesce(n, F.lit(0).cast("long"))).withColumn("group", F.floor(F.col("s") / mix.chunk))
        self.slots_total = df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        earlier = F.sum("n").over(Window.partitionBy("group").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("inside", F.coalesce(earlier, F.lit(0)))
        sums = df.groupBy("group").agg(F.sum("n").alias("whole"))
        sums = sums.select("group", F.coalesce(F.sum("whole").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        found = cut(df.join(sums, "group").select("skey", "s", "source_size", "target", "length", "blocks", "n", (F.col("base") + F.col("inside")).alias("first")))
        # a row for each source: broadcast while they are few, which is known here, and merged beyond
        self.sources = F.broadcast(found) if n_sources <= mix.broadcast_sources else found.hint("merge")

    def _level(self, sources: DataFrame, budget: float) -> float:
        """Words for each unit of weight: ``budget`` shared by weight, what is above a cap shared again.

        Each turn sees three sums.  The level only rises, so sources that are
        full stay full, and it ends.
        """
        sources = sources.where("source_size > 0")
        level, full = 0.0, -1
        while True:
            cap = self.mix.max_passes * F.col("source_size")
            is_full = (F.lit(level) * F.col("w") > cap) if full >= 0 else F.lit(False)
            capped, open_, now = sources.agg(F.sum(F.when(is_full, cap).otherwise(0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("w"))), F.sum(is_full.cast("int"))).first()
            if now == full or not open_:
                return level
            level, full = (budget - capped) / open_, now

    def placed(self) -> DataFrame:
        """Each row with its source and the place of its first word in the source's stream."""
        mix = self.mix
        buckets = max(1, -(-self.n_docs // mix.docs_per_bucket))
        rows = self.rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(buckets))).withColumn("chunk", F.floor(F.col("bucket") / mix.chunk))
        rows = rows.withColumn("all", F.col("size") * F.col("copies"))
        before = lambda value, by, at: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        of_bucket = rows.groupBy("skey", "chunk", "bucket").agg(F.sum("all").alias("words"))
        of_chunk = of_bucket.groupBy("skey", "chunk").agg(F.sum("words").alias("words"))
        of_chunk = of_chunk.select("skey", "chunk", before("words", ["skey"], ["chunk"]).alias("chunk_at"))
        of_bucket = of_bucket.withColumn("bucket_at", before("words", ["skey", "chunk"], ["bucket"])).join(of_chunk, ["skey", "chunk"])
        of_bucket = of_bucket.select("skey", "bucket", (F.col("chunk_at") + F.col("bucket_at")).alias("base"))
        rows = rows.withColumn("inside", before("all", ["skey", "bucket"], ["doc_id", "tk", "size"]))
        rows = rows.join(of_bucket, ["skey", "bucket"]).join(self.sources, "skey")
        return rows.select("doc_id", "tk", "s", "size", "copies", "source_size", "target", "length", (F.col("base") + F.col("inside")).alias("start"))

    def pieces(self, placed: DataFrame) -> DataFrame:
        """Rows with words, each copy once for each block it reaches into: words [lo, hi) of the document."""
        one = placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        one = one.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copy", "copies")
        n, start, end = F.col("length"), F.col("start"), F.col("start") + F.col("size")
        df = one.withColumn("block", F.explode(F.sequence(F.floor(start / n), F.floor((end - 1) / n))))
        first = F.col("block") * n
        return df.withColumn("lo", F.greatest(start, first) - start).withColumn("hi", F.least(end, first + n) - start).drop("length")

    def slots(self) -> DataFrame:
        """(s, block, pass, shard): each slot of the mix with its block.

        Spark guesses its size from the number of sources, far too small, so
        joins with it are told to merge: it must never be broadcast.
        """
        mix, at_once = self.mix, self.mix.shard_slots
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(self.slots_total / (1 << 20)))
        df = self.sources.where("n > 0").select("s", "blocks", "n", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / at_once))).alias("part"))
        df = df.repartition(tasks, "s", "part")
        df = df.select("s", "blocks", "first", F.explode(F.sequence(F.col("part") * at_once, F.least(F.col("n"), (F.col("part") + 1) * at_once) - 1)).alias("j"))
        drawn = permuted(F.col("first") + F.col("j"), F.lit(max(1, self.slots_total)).cast("long"), mix.seed, F.lit("shards"), rounds=mix.rounds)
        df = df.select("s", "blocks", F.floor(F.col("j") / F.col("blocks")).alias("pass"), F.pmod("j", "blocks").alias("x"), F.floor(drawn / mix.shard_slots).alias("shard"))
        return df.select("s", permuted(F.col("x"), F.col("blocks"), mix.seed, F.col("s"), F.col("pass"), rounds=mix.rounds).alias("block"), "pass", "shard")

    def shards(self) -> DataFrame:
        """(shard, s, n): the slots that each output shard drew from each source."""
        return self.slots().groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"))


def _text_key(doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    # hashing passes over nulls, so which columns are null counts too
    return F.xxhash64(text, source, *[F.col(c).isNull() for c in (doc_id, text, source)])


def taken_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    m = Mixer(docs, mix)
    placed = m.placed()
    uses = m.slots().groupBy("s", "block").agg(F.count(F.lit(1)).alias("uses")).hint("merge")
    taken = m.pieces(placed).join(uses, ["s", "block"], "left")
    own = ["doc_id", "tk", "s", "start", "size", "source_size", "target"]
    taken = taken.groupBy(*own).agg(F.sum((F.col("hi") - F.col("lo")) * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = placed.where("size = 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*own, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: for each document and pass, the text of the words taken.

    All columns of ``docs`` stay; ``n_chars``, where there is one, is counted
    anew.  White space between taken words is that of the text.  Of rows equal
    in id, text and source that differ elsewhere, all take the other columns of
    the one with the smallest hash of the whole row.
    """
    m = Mixer(docs, mix)
    parts = m.pieces(m.placed()).join(m.slots().select("s", "block", "pass").hint("merge"), ["s", "block"])
    spans = parts.groupBy("doc_id", "tk", "start", "pass", "size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    used = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    spans = spans.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "tk", "spans", (used == F.col("size")).alias("whole"))
    table = Sealed(docs, i="doc_id", text="text", source="source")
    full = table.df.select(F.coalesce("i", F.lit(0)).alias("id"), _text_key("i").alias("tk"), "d").groupBy("id", "tk").agg(F.min_by("d", row_key()).alias("d"))
    at = f"c{table.names.index('text')}"
    text = F.col("d")[at]
    df = full.join(spans, ["id", "tk"])
    # words with the white space behind them, where only some are taken
    body = F.regexp_replace(text, f"^[{SPACE}]+", "")
    df = df.withColumn("w", F.when(~F.col("whole"), F.split(body, f"(?<=[{SPACE}])(?=[^{SPACE}])")))
    some = F.array_join(F.transform("spans", lambda x: F.array_join(F.slice(F.col("w"), (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")), "")), "")
    # `w` is read here too, so that it stays a column: inside the lambda it would be split anew for each span
    df = df.withColumn("text", F.when(F.col("w").isNull(), text).otherwise(F.rtrim(some)))
    changed = {"text": F.col("text")}
    if "n_chars" in table.names:
        changed["n_chars"] = F.char_length("text").cast(docs.schema[table.names.index("n_chars")].dataType)
    return df.select(*table.open(**changed))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of ``documents``."""
    return taken_words(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
