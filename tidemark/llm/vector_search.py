"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by nearest pivot and distance to it (iDistance, Jagadish et
al.), sorted by that key and cut into blocks: annuli around a pivot.  Each
annulus knows how far its vectors lie from every pivot, at least and at most.
With 2<q, v> = |q|^2 + |v|^2 - |q - v|^2 and the triangle inequality
|q - v| >= |d(q, p) - d(p, v)|, no vector of an annulus with largest squared
norm n can score more than (|q|^2 + n - gap^2) / 2, where gap is how far some
d(q, p) lies outside the annulus's distances, for the pivot that tells most.  A
query starts with the scores of its own annulus, takes annuli in its own order
of falling bound, and stops where the bound is under its k-th score.  Queries
are written by annulus too, with the same ranges; a task reads only those
blocks of queries that one of its annuli may serve by the same bound.

Pivots are fitted on a documented sample of at most ``sample`` vectors (those
whose id hashes are smallest); they only steer how much is skipped, never
what is found.  All rows are indexed and no candidate is dropped.  Sorting
breaks ties by id, so many equal vectors are many blocks in many tasks.  Each
task holds its own blocks and one block of queries at a time, read from the
folder the cluster shares.

Defined results: vectors that are null or hold null, NaN or infinite
components, and rows without an id, take no part; a shorter vector counts as
padded with zeros; rows that bear a query's id are its own row; repeated
queries give repeated results; ties go to the smaller id; an empty table
gives an empty table; extra columns are ignored.  Scores beyond a long are
its nearest end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, read, scratch
from tidemark.llm.zip_ranges import filesystem

KEYED = "vec_id long, is_query boolean, pivot int, dist double, v binary"
EXACT = float(1 << 53)


def _whole(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(256 * x) as doubles; shorter rows are padded with zeros."""
    out = np.zeros((len(vectors), dim))
    sizes = np.asarray(vectors.value_lengths(), dtype=np.int64)
    flat = np.floor(256.0 * np.asarray(vectors.flatten(), dtype=np.float64))
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    at = 0
    for k, n in enumerate(sizes.tolist()):
        out[k, :n] = flat[at : at + n]
        at += n
    return out


def _distances(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (v * v).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * v @ p.T))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where none can pass 2^53, else in integers."""
    if len(q) and len(v) and (np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]) >= EXACT:
        whole = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q]
        ends = np.iinfo(np.int64)
        return np.array([[max(ends.min, min(ends.max, s)) for s in row] for row in whole], np.int64).reshape(len(q), len(v))
    return (q @ v.T).astype(np.int64)


def fit_pivots(vectors: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means from points far apart; fixed, given its input."""
    if not len(vectors):
        return np.zeros((1, max(1, vectors.shape[1])))
    p = vectors[:1]
    while len(p) < min(count, len(vectors)):
        far = _distances(vectors, p).min(1)
        if far.max() == 0:
            break
        p = np.vstack([p, vectors[far.argmax()]])
    for _ in range(rounds):
        own = _distances(vectors, p).argmin(1)
        p = np.vstack([vectors[own == k].mean(0) if (own == k).any() else p[k] for k in range(len(p))])
    return p


class Best:
    """The k best (score, id) of each of some queries."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        #: Scores below these cannot be among the best.
        self.floor = np.full(n, np.iinfo(np.int64).min) if floor is None else floor
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Merges a matrix of scores of ``rows`` against ``ids``."""
        valid = ids[None, :] != own[:, None]
        least = self.least[rows]
        for r, row_scores, ok, low in zip(rows.tolist(), scores, valid, least, strict=True):
            good = np.flatnonzero(ok & (row_scores >= low))
            if not len(good):
                continue
            s, i = np.concatenate([self.score[r], row_scores[good]]), np.concatenate([self.id[r], ids[good]])
            order = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises and cannot overflow
            self.score[r], self.id[r] = s[order], i[order]


class Ranges:
    """Where some vectors lie: their distances to each pivot, from near to far, and their largest squared norm."""

    def __init__(self, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> None:
        self.near, self.far, self.norm = near, far, norm

    @classmethod
    def of(cls, v: np.ndarray, p: np.ndarray) -> Ranges:
        d = _distances(v, p)
        return cls(d.min(0), d.max(0), np.float64((v * v).sum(1).max()))

    def bound(self, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """No vector here scores more than this with a query at these distances (a row for each query)."""
        gap = np.maximum(0.0, np.maximum(self.near - far, near - self.far)).max(1, initial=0.0)
        # the slack covers rounding of distances, many times over
        return (norm + self.norm - gap * gap) / 2 + 1.0 + 1e-9 * (norm + self.norm)


class Block:
    def __init__(self, ids: np.ndarray, v: np.ndarray, p: np.ndarray) -> None:
        self.ids, self.v, self.ranges = ids, v, Ranges.of(v, p)


def _blocks(batches: Iterator[pa.RecordBatch], p: np.ndarray, size: int) -> Iterator[tuple[Block, np.ndarray]]:
    """Annuli of rows sorted by pivot and distance, with which rows are queries."""
    held: list[tuple] = []

    def block() -> tuple[Block, np.ndarray]:
        ids, query, _, v = zip(*held, strict=True)
        m = np.frombuffer(b"".join(v)).reshape(-1, p.shape[1])
        return Block(np.array(ids, np.int64), m, p), np.array(query, bool)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "is_query", "pivot", "v")), strict=True):
            if held and (len(held) >= size or row[2] != held[0][2]):
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


class QueryBlocks:
    """The queries as they were written: a row for each annulus that has some, read where it can matter."""

    SUMMARY = ["n", "near", "far", "norm", "least"]

    def __init__(self, folder: str, dim: int) -> None:
        self.fs, self.at = filesystem(folder)
        self.dim = dim

    def needed(self, annuli: list[Block], counts: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the first, ids, floors, vectors) of each block of queries that some annulus may serve."""
        from pyarrow.fs import FileSelector

        nth = 0
        for path in sorted(f.path for f in self.fs.get_file_info(FileSelector(self.at)) if f.path.endswith(".parquet")):
            with self.fs.open_input_file(path) as file:
                parquet = pq.ParquetFile(file)
                for group in range(parquet.num_row_groups):
                    about = parquet.read_row_group(group, self.SUMMARY).to_pydict()
                    numbers = nth + np.concatenate([[0], np.cumsum(about["n"])]).astype(np.int64)
                    nth = int(numbers[-1])
                    if not about["n"]:
                        continue
                    near, far = np.array(about["near"]), np.array(about["far"])
                    best = np.max([b.ranges.bound(near, far, np.array(about["norm"])) for b in annuli], axis=0)
                    rows = np.flatnonzero(best >= np.array(about["least"]))
                    counts["query_blocks"] += len(best)
                    counts["read_blocks"] += len(rows)
                    if len(rows):
                        payload = parquet.read_row_group(group, ["ids", "floors", "vectors"]).take(rows)
                        for k, ids, floors, v in zip(rows.tolist(), *(payload.column(c) for c in ("ids", "floors", "vectors")), strict=True):
                            yield int(numbers[k]), np.frombuffer(ids.as_py(), np.int64), np.frombuffer(floors.as_py(), np.int64), np.frombuffer(v.as_py()).reshape(-1, self.dim)


def _search(batch: tuple[np.ndarray, np.ndarray, np.ndarray], annuli: list[Block], p: np.ndarray, k: int, counts: dict[str, int]) -> Best:
    """The best of ``annuli`` for some queries: each takes annuli in its own order of falling bound, and stops."""
    ids, floors, q = batch
    best = Best(len(ids), k, floors)
    d, norm = _distances(q, p), (q * q).sum(1)
    bounds = np.stack([b.ranges.bound(d, d, norm) for b in annuli])
    order = np.argsort(-bounds, axis=0, kind="stable")
    every = np.arange(len(ids))
    counts["pairs"] += len(ids) * sum(len(b.ids) for b in annuli)
    for turn in order:
        open_ = bounds[turn, every] >= best.least
        if not open_.any():
            break
        for a in np.unique(turn[open_]).tolist():
            rows = np.flatnonzero(open_ & (turn == a))
            counts["scored"] += len(rows) * len(annuli[a].ids)
            best.add(rows, _scores(q[rows], annuli[a].v), annuli[a].ids, ids[rows])
    return best


FOUND = "query_id long, nth long, vec_id long, score long"
COUNTS = ("pairs", "scored", "query_blocks", "read_blocks")


def _found(
    vectors: DataFrame, is_query: Column, k: int, pivots: int, sample: int, block: int, rows_per_task: int, query_batch: int, counted: bool
) -> DataFrame | None:
    """Each task's best for each query, or what its search looked at; None without vectors."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    dim, count = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    if not count:
        return None
    dim = max(1, dim)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    p = fit_pivots(_whole(some, dim), pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _whole(b.column(1), dim)
            d = _distances(v, p)
            own = d.argmin(1) if len(v) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(own, pa.int32()), pa.array(d[np.arange(len(v)), own]), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "is_query", "pivot", "dist", "v"])

    tasks = max(1, -(-count // rows_per_task))
    index = rows.select("vec_id", "embedding", "is_query").mapInArrow(keyed, KEYED)
    index = cut(index.repartitionByRange(tasks, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id"))

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each annulus's queries with their k-th scores within it."""
        for b, query in _blocks(batches, p, block):
            at = np.flatnonzero(query)
            if not len(at):
                continue
            best = Best(len(at), k)
            for s in range(0, len(at), query_batch):
                part = at[s : s + query_batch]
                best.add(np.arange(s, s + len(part)), _scores(b.v[part], b.v), b.ids, b.ids[part])
            q, floors = b.v[at], best.least
            r = Ranges.of(q, p)
            row = ([len(at)], [r.near.tolist()], [r.far.tolist()], [float(r.norm)], [int(floors.min())], [b.ids[at].tobytes()], [floors.tobytes()], [q.tobytes()])
            lists = pa.list_(pa.float64())
            kinds = (pa.int64(), lists, lists, pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=[*QueryBlocks.SUMMARY, "ids", "floors", "vectors"])

    folder = scratch(spark, "queries")
    index.mapInArrow(first_look, "n long, near array<double>, far array<double>, norm double, least long, ids binary, floors binary, vectors binary").write.parquet(folder)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [b for b, _ in _blocks(batches, p, block)]
        counts = dict.fromkeys(COUNTS, 0)
        if annuli:
            for first, ids, floors, q in QueryBlocks(folder, dim).needed(annuli, counts):
                for s in range(0, len(ids), query_batch):
                    part = slice(s, s + query_batch)
                    best = _search((ids[part], floors[part], q[part]), annuli, p, k, counts)
                    r, c = np.nonzero(best.id != np.iinfo(np.int64).max)
                    if not counted:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][r]), pa.array(first + s + r), pa.array(best.id[r, c]), pa.array(best.score[r, c])], names=["query_id", "nth", "vec_id", "score"])
            if counted:
                counts["pairs"] = sum(len(b.ids) for b in annuli)
                yield pa.RecordBatch.from_arrays([pa.array([counts[c]], pa.int64()) for c in COUNTS], names=list(COUNTS))

    return index.mapInArrow(search, ", ".join(f"{c} long" for c in COUNTS) if counted else FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 32, sample: int = 2048, block: int = 256, rows_per_task: int = 16384, query_batch: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` marks, over (vec_id, embedding)."""
    found = _found(vectors, is_query, k, pivots, sample, block, rows_per_task, query_batch, False)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("nth", "query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scored_share(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 32, sample: int = 2048, block: int = 256, rows_per_task: int = 16384, query_batch: int = 512) -> tuple[float, float]:
    """Which share of (query, vector) pairs a search scores, and of query blocks its tasks read."""
    found = _found(vectors, is_query, k, pivots, sample, block, rows_per_task, query_batch, True)
    if found is None:
        return 0.0, 0.0
    rows, scored, blocks, read = found.agg(*[F.sum(c) for c in COUNTS]).first()
    queries = vectors.where(F.coalesce(is_query, F.lit(False))).count()
    return scored / max(1, rows * queries), read / max(1, blocks)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all ``embeddings`` for each whose id is divisible by 50."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
