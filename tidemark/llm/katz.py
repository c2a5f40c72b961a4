"""Language-model scoring with Katz backoff.

p(w | h) is the Good-Turing discounted share of w among what followed h where
``h w`` was seen, and backoff(h) * p(w | h without its first word) where not,
down to single words; what single words leave over is the probability of any
unseen word.  backoff(h) = (1 - sum of p over what followed h) / (1 - sum of
the shorter model's p over the same words), so every p(. | h) sums to one.

How it is spread.  Texts are read once and become *batches*: the batch's
distinct words as 64-bit hashes, and for each token the word's number, in one
file in the shared folder.  For each order a batch sends its distinct n-grams
with their counts, sorted and packed, to the partitions of the n-gram table (by
ranges of the hash, so that a word that makes up a third of all tokens is one
entry per batch, and no key is hot).  A partition adds them up, stores its
slice of the table and answers each batch with the counts, in the order asked.
One batch per n-gram is its owner and adds up what backoff needs for the
n-gram's context; contexts are summed and answered the same way.  So what moves
is the distinct n-grams of batches, some six bytes each, never the tokens, and
a task holds one batch or one partition, whose sizes are parameters.

A batch and a partition that share no n-gram exchange nothing: the rows that
move are at most as many as batches times partitions, and never more than the
batches' distinct n-grams.  Weights and probabilities are doubles throughout.

The driver sees counts of counts only.  N-grams are told apart by 64-bit
hashes: of 10^10 distinct ones three are expected to share theirs.

Defined results: null and empty texts are the end token alone; a null id
counts as empty text, whose remainder is 0, for training; repeated rows count
as often as they stand; extra columns are ignored; with no training text all
tokens are unseen and have probability one together; an empty table gives an
empty table.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, read, scratch
from tidemark.llm.zip_ranges import filesystem

#: Neither can be a word, as both are white space.
START, END = (xxhash.xxh64_intdigest(b) for b in (b"\t", b"\n"))
#: Counts up to this are discounted.
K = 5
#: Sums of probabilities move as whole numbers of these, so that their sum does not depend on its order.
FIXED = float(1 << 52)
BATCHES = "batch long, path string, tokens long"
ASKED = "part long, batch long, keys binary, sums binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ANSWER = "batch long, part long, first binary, second binary"


@dataclass(frozen=True)
class KatzModel:
    order: int = 2
    #: Tokens of one batch, beyond which the next one starts.
    batch_tokens: int = 1 << 20
    #: Entries of one partition of a table, about.
    part_entries: int = 1 << 19


# packed arrays ------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: equal high bytes cost nothing."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a longer n-gram from those of its first words and its last."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Sorted keys by partition, without the empty ones."""
    if not len(keys):
        return
    own = part_of(keys, parts)
    edges = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
        yield int(own[a]), slice(a, b)


# batches ------------------------------------------------------------------


class Batch:
    """Documents as numbers of distinct words; token arrays hold each document's tokens and its end."""

    def __init__(self, words: np.ndarray, index: np.ndarray, lengths: np.ndarray, train: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> None:
        self.words, self.index, self.lengths, self.train, self.ids, self.has_id = words, index, lengths, train, ids, has_id

    def save(self, fs, path: str) -> None:
        blob = io.BytesIO()
        parts = [pack(a) for a in (self.words, self.index, self.lengths, self.train, self.ids, self.has_id)]
        np.save(blob, np.array([len(p) for p in parts], np.int64))
        with fs.open_output_stream(path) as f:
            f.write(blob.getvalue() + b"".join(parts))

    @classmethod
    def load(cls, fs, path: str) -> Batch:
        with fs.open_input_file(path) as f:
            blob = io.BytesIO(f.readall())
        sizes = np.load(blob).tolist()
        kinds = (np.uint64, np.int32, np.int32, np.bool_, np.int64, np.bool_)
        return cls(*[unpack(blob.read(n), t) for n, t in zip(sizes, kinds, strict=True)])

    @property
    def tokens(self) -> np.ndarray:
        return self.words[self.index]

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.lengths)

    @property
    def in_train(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def contexts(self, order: int) -> np.ndarray:
        """For each token the hash of the ``order - 1`` tokens before it, padded at a document's start."""
        tokens, starts = self.tokens, self.ends - self.lengths
        place = np.arange(len(tokens)) - np.repeat(starts, self.lengths)
        out = None
        for back in range(order - 1, 0, -1):
            before = np.full(len(tokens), START, np.uint64)
            inside = np.flatnonzero(place >= back)
            before[inside] = tokens[inside - back]
            out = before if out is None else mix(out, before)
        return out

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, sorted, and each token's number among them."""
        keys = self.tokens if order == 1 else mix(self.contexts(order), self.tokens)
        return np.unique(keys, return_inverse=True)


def make_batches(docs: DataFrame, folder: str, model: KatzModel) -> DataFrame:
    """Files of batches for (doc_id, text, train); returns their list."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        known: dict[bytes, int] = {}
        index: list[np.ndarray] = []
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal known, index, rows, size
            words = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            tokens = np.concatenate(index)
            # frequent words get small numbers, which pack best
            rank = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            number = np.empty(len(rank), np.int32)
            number[rank] = np.arange(len(rank), dtype=np.int32)
            words, tokens = words[rank], number[tokens]
            ids, train, lengths = zip(*rows, strict=True)
            batch = Batch(words, tokens, np.array(lengths, np.int32), np.array(train, bool), np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool))
            name = uuid.uuid4()
            batch.save(fs, f"{at}/{name.hex}")
            row = (name.int & (1 << 62) - 1, f"{at}/{name.hex}", size)
            known, index, rows, size = {}, [], [], 0
            return _rows([row], BATCHES)

        for frame in frames:
            for doc, text, train in zip(*(frame.column(k) for k in range(3)), strict=True):
                # bytes.lower and bytes.split know ASCII only
                tokens = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                tokens.append(None)
                index.append(np.array([known.setdefault(t, len(known)) for t in tokens], np.int32))
                rows.append((doc.as_py(), train.as_py(), len(tokens)))
                size += len(tokens)
                if size >= model.batch_tokens:
                    yield flush()
        if rows:
            yield flush()

    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "train").mapInArrow(run, BATCHES))


# tables -------------------------------------------------------------------


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def count_table(asked: DataFrame) -> DataFrame:
    """Sums n-gram counts by partition.

    Answers each batch: its n-grams' counts, and which of them it owns.  Rows
    with batch -1 are the stored table (keys, counts); those with batch -2 hold
    counts of counts: the sum of counts, then n of 1, 2, ... K + 1, then n of all.
    """

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        order = np.argsort(np.asarray(table.column("batch")), kind="stable").tolist()
        batches = [table.column("batch")[k].as_py() for k in order]
        keys = [unpack_sorted(table.column("keys")[k].as_py()) for k in order]
        sums = [unpack(table.column("sums")[k].as_py(), np.int64) for k in order]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        here = np.concatenate(sums)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, where, here)
        first = np.full(len(every), len(where), np.int64)
        seen = np.flatnonzero(here > 0)
        np.minimum.at(first, where[seen], seen)
        own = first[where] == np.arange(len(where))
        out, at = [], 0
        for b, k in zip(batches, keys, strict=True):
            span = slice(at, at := at + len(k))
            out.append((b, part, pack(total[where[span]]), pack(own[span])))
        kept = total > 0
        counts = total[kept]
        out.append((-1, part, pack_sorted(every[kept]), pack(counts)))
        out.append((-2, part, pack(np.array([counts.sum(), *((counts == r).sum() for r in range(1, K + 2)), len(counts)], np.int64)), b""))
        return pa.Table.from_batches([_rows(out, ANSWER)])

    return cut(asked.groupBy("part").applyInArrow(run, ANSWER))


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing ratios for counts 0..K (entry 0 is unused), from n of counts 1..K+1.

    Where the counts of counts give no ratio in (0, 1], absolute discounting
    takes its place.
    """
    out = np.ones(K + 1)
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    flat = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    for r in range(1, K + 1):
        d = 0.0
        if n[r - 1] and common < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
        out[r] = d if 0 < d <= 1 else (r - min(flat, 0.9)) / r
    return out


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return r * np.where(r <= K, d[np.minimum(r, K)], 1.0)


def stats(answers: DataFrame) -> tuple[int, list[int], int]:
    """Sum of counts, n of counts 1..K+1 and n of all, over the whole table."""
    total = np.zeros(K + 3, np.int64)
    for row in answers.where("batch = -2").select("first").toLocalIterator():
        total += unpack(bytes(row[0]), np.int64)
    return int(total[0]), total[1 : K + 2].tolist(), int(total[-1])


class Answers:
    """What the partitions of several tables answered to one batch, and the batch's file."""

    def __init__(self, group: pa.Table) -> None:
        self.by: dict[int, list[tuple]] = {}
        for name, table, part, first, second in zip(*(group.column(c).to_pylist() for c in ("batch", "table", "part", "first", "second")), strict=True):
            self.name = name
            if table < 0:
                self.path = first.decode()
            else:
                self.by.setdefault(table, []).append((part, first, second))

    def get(self, table: int, first, second) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted(self.by[table], key=lambda x: x[0])
        return np.concatenate([unpack(x[1], first) for x in rows]), np.concatenate([unpack(x[2], second) for x in rows])


@dataclass(frozen=True)
class Evaluator:
    """p of each token of a batch, evaluated recursively from what the tables answered.

    ``totals`` has, for each order, the sum of counts, n of counts 1..K+1 and n of all.
    """

    totals: tuple[tuple[int, tuple[int, ...], int], ...]

    def ratios(self, order: int) -> np.ndarray:
        return discounts(list(self.totals[order - 1][1]))

    def single(self, r: np.ndarray) -> np.ndarray:
        """p of single words by count; 0 is any unseen word."""
        n, of, _ = self.totals[0]
        d = self.ratios(1)
        left = sum((1 - d[x]) * x * of[x - 1] for x in range(1, K + 1))
        total, left = (n, left) if left > 0 else (n + 1, 1.0)
        return np.where(r > 0, discounted(r, d), left) / total

    def p(self, batch: Batch, answers: Answers, order: int) -> np.ndarray:
        _, inverse = batch.grams(order)
        r = answers.get(_counts(order), np.int64, np.bool_)[0][inverse]
        if order == 1:
            return self.single(r)
        _, of = np.unique(batch.contexts(order), return_inverse=True)
        total, backoff = (x[of] for x in answers.get(_weights(order), np.int64, np.float64))
        return np.where(r > 0, discounted(r, self.ratios(order)) / np.maximum(1, total), backoff * self.p(batch, answers, order - 1))


def _counts(order: int) -> int:
    return 2 * order


def _weights(order: int) -> int:
    return 2 * order + 1


class Katz:
    """Counts, backoff weights and scores for (doc_id, text, train).

    ``tables`` has the stored tables by number: 2 m the counts of m-grams,
    2 m + 1 the backoff weights of their contexts, both by ranges of the hash.
    """

    def __init__(self, docs: DataFrame, model: KatzModel = KatzModel()) -> None:
        self.spark, self.model = docs.sparkSession, model
        self.folder = scratch(self.spark, "katz")
        self.batches = make_batches(docs, self.folder, model)
        self.n_batches, tokens = self.batches.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        self.parts = max(1, -(-tokens // model.part_entries))
        self.tables: dict[int, DataFrame] = {}
        totals = []
        for order in range(1, model.order + 1):
            self.tables[_counts(order)] = count_table(self._ask(order))
            totals.append(stats(self.tables[_counts(order)]))
            self.evaluator = Evaluator(tuple((n, tuple(of), v) for n, of, v in totals))
            if order > 1:
                self.tables[_weights(order)] = weight_table(self._contexts(order), self.evaluator, order)
    
    def _ask(self, order: int) -> DataFrame:
        """Each batch's distinct n-grams and their counts in training texts, by partition."""
        folder, parts = self.folder, self.parts

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, _ = filesystem(folder)
            for frame in frames:
                for name, path in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                    batch = Batch.load(fs, path)
                    keys, inverse = batch.grams(order)
                    n = np.bincount(inverse, weights=batch.in_train, minlength=len(keys)).astype(np.int64)
                    yield _rows([(p, name, pack_sorted(keys[s]), pack(n[s])) for p, s in slices(keys, parts)], ASKED)

        spread = self.batches.select("batch", "path").repartition(max(1, self.n_batches), "batch")
        return spread.mapInArrow(run, ASKED)

    def _answered(self):
        """All that the tables so far answered, and the batches' own rows, grouped by batch."""
        df = self.batches.select("batch", F.lit(-1).alias("table"), F.lit(-1).cast("long").alias("part"), F.col("path").cast("binary").alias("first"), F.lit(b"").alias("second"))
        for number, answers in self.tables.items():
            df = df.unionByName(answers.where("batch >= 0").withColumn("table", F.lit(number)))
        return df.groupBy("batch")

    def _contexts(self, order: int) -> DataFrame:
        """For each context of a batch, sums over the n-grams that the batch owns.

        The n-grams' counts, how many have count 1..K, and their probability
        in the shorter model.
        """
        folder, parts, evaluator = self.folder, self.parts, self.evaluator

        def run(group: pa.Table) -> pa.Table:
            answers = Answers(group)
            batch = Batch.load(filesystem(folder)[0], answers.path)
            contexts, of = np.unique(batch.contexts(order), return_inverse=True)
            grams, inverse = batch.grams(order)
            r, own = answers.get(_counts(order), np.int64, np.bool_)
            token = np.zeros(len(grams), np.int64)
            token[inverse] = np.arange(len(inverse))  # any token of each n-gram: all have one context and one shorter p
            token, r = token[own], r[own]
            where, n = of[token], len(contexts)
            shorter = evaluator.p(batch, answers, order - 1)[token]
            whole = [np.bincount(where, weights=r, minlength=n), *(np.bincount(where[r == x], minlength=n) for x in range(1, K + 1))]
            whole = [x.astype(np.int64) for x in whole] + [np.rint(np.bincount(where, weights=shorter, minlength=n) * FIXED).astype(np.int64)]
            out = [(p, answers.name, pack_sorted(contexts[s]), pack(np.concatenate([x[s] for x in whole]))) for p, s in slices(contexts, parts)]
            return pa.Table.from_batches([_rows(out, ASKED)])

        return self._answered().applyInArrow(run, ASKED)

    def scores(self) -> DataFrame:
        """One row per document; ``score`` is log10 of the model's probability of all its tokens."""
        folder, evaluator, order = self.folder, self.evaluator, self.model.order

        def run(group: pa.Table) -> pa.Table:
            answers = Answers(group)
            batch = Batch.load(filesystem(folder)[0], answers.path)
            _, inverse = batch.grams(1)
            c = answers.get(_counts(1), np.int64, np.bool_)[0][inverse]
            n, _, v = evaluator.totals[0]
            starts = batch.ends - batch.lengths
            total = lambda x: np.add.reduceat(x, starts)
            base = np.log10((c + 1) / (n + 1 * (v + 1)))  # one is added to each of v words and the unseen one
            score = np.log10(evaluator.p(batch, answers, order))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.ids, mask=~batch.has_id),
                    pa.array(~batch.train),
                    pa.array(batch.lengths.astype(np.int64)),
                    pa.array(total((c > 0).astype(np.int64))),
                    pa.array(np.full(len(starts), n, np.int64)),
                    pa.array(total(base)),
                    pa.array(total(score)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            return pa.Table.from_batches([out])

        return self._answered().applyInArrow(run, SCORED)


def weight_table(sums: DataFrame, evaluator: Evaluator, order: int) -> DataFrame:
    """Adds up contexts by partition: total count and backoff weight, answered and stored as in ``count_table``."""
    d = evaluator.ratios(order)
    unseen = float(evaluator.single(np.zeros(1, np.int64))[0])

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        keys = [unpack_sorted(x) for x in group.column("keys").to_pylist()]
        rows = [unpack(x, np.int64).reshape(K + 2, -1) for x in group.column("sums").to_pylist()]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        rows = np.concatenate(rows, axis=1)
        total, *of = (np.bincount(where, weights=x, minlength=len(every)) for x in rows[: K + 1])
        shorter = np.bincount(where, weights=rows[K + 1], minlength=len(every)) / FIXED
        left = sum((1 - d[x]) * x * of[x - 1] for x in range(1, K + 1))
        # where nothing was discounted, one is added to the total for what is unseen
        spare = (left <= 0) & (total > 0)
        total, left = total + spare, np.where(spare, 1.0, left)
        backoff = np.where(total > 0, left / np.maximum(1, total) / np.maximum(1 - shorter, unseen), 1.0)
        total = total.astype(np.int64)
        out, at = [], 0
        for b, k in zip(group.column("batch").to_pylist(), keys, strict=True):
            s = where[at : (at := at + len(k))]
            out.append((b, part, pack(total[s]), pack(backoff[s])))
        kept = total > 0
        out.append((-1, part, pack_sorted(every[kept]), pack(backoff[kept])))
        return pa.Table.from_batches([_rows(out, ANSWER)])

    return cut(sums.groupBy("part").applyInArrow(run, ANSWER))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return Katz(docs.withColumn("train", rest != 2)).scores()
