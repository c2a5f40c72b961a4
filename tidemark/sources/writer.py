"""Partitioned, idempotent writes whose visibility a commit decides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys, patterns
from tidemark.operators import views
from tidemark.operators.batches import group_by_partition
from tidemark.operators.projection import zero_fill
from tidemark.sources.config import StoreConfig, Timing, load_timing
from tidemark.sources.files import AT_ONCE
from tidemark.sources.log import Commit, Logs, WriteResult
from tidemark.sources.observe import measured
from tidemark.sources.views import add_tuples


class CommitAfterTimeout(RuntimeError):
    """The data are written and committed, but later than consumers wait; ``results`` has them all."""

    def __init__(self, results: list[WriteResult]) -> None:
        super().__init__("committed after the commit timeout: consumers may have passed; restamp the ref")
        self.results = results


class PartialWrite(RuntimeError):
    """Some partitions failed after others were committed; ``results`` has the committed."""

    def __init__(self, results: list[WriteResult], cause: Exception) -> None:
        super().__init__(f"{len(results)} partitions were committed before: {cause}")
        self.results = results


@dataclass
class _Plan:
    key: str
    rows: int
    token: str
    attempt: str
    prior: Commit | None = None


def _by_key(results: dict[str, WriteResult]) -> list[WriteResult]:
    return [results[k] for k in sorted(results, key=str.encode)]


def ref_name(us: int, token: str, attempt: str, partition: str) -> str:
    return f"{keys.REFS}{us:016d}-{token}-{attempt};{quote(partition, safe='$&+:=@~-._')}.ref"


class Writer:
    def __init__(self, spark: SparkSession, config: StoreConfig, timing: Timing | None = None) -> None:
        self.spark, self.config = spark, config
        self.timing = timing or load_timing(spark, config.root)
        self.logs = Logs(spark, config)
        self.counters: Counter[str] = Counter()

    def partition_key(self) -> Column:
        return keys.hive_key(self.config.part_columns())

    def group_by_partition(self, df: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
        return group_by_partition(df, self.partition_key(), order).orderBy("key")

    @measured
    def lookup_commit(self, partition: str, token: str) -> WriteResult | None:
        """The result of an earlier write, without reading data."""
        patterns.check_key(partition, list(self.config.parts))
        keys.check_token(token)
        c = self.logs.find(partition, token)
        return self.logs.result(c, ref_name(c.ref_micro_ts, c.token, c.attempt_id, c.partition)) if c else None

    @measured
    def write(self, df: DataFrame, token: str | None = None, token_of: Column | Callable[[str], str] | None = None, inserted_at: datetime | None = None, optimistic: bool = False) -> list[WriteResult]:
        """Writes every partition of ``df``; results by ascending key.

        ``token_of`` is an aggregate over a partition's rows, or a function of
        its key.  One job writes all partitions; if it fails nothing is
        visible.  ``df`` is evaluated for its keys and again for its rows, so
        it must give the same rows each time.
        """
        return self._write(df, self.config.part_columns(), token, token_of, inserted_at, optimistic)

    @measured
    def write_with_key(self, key: str, df: DataFrame, token: str | None = None, token_of: Column | Callable[[str], str] | None = None, inserted_at: datetime | None = None, optimistic: bool = False) -> WriteResult | None:
        """Writes all of ``df`` to one partition, whatever its rows say."""
        values = patterns.check_key(key, list(self.config.parts))
        found = self._write(df, {p: F.lit(v) for p, v in values.items()}, token, token_of, inserted_at, optimistic)
        return found[0] if found else None

    def _write(self, df, parts, token, token_of, inserted_at, optimistic) -> list[WriteResult]:
        c = self.config
        if token is not None and token_of is not None:
            raise ValueError("token and token_of exclude each other")
        if token is not None:
            keys.check_token(token)
        key = keys.hive_key(parts)
        whole = F.count_if(F.greatest(*[F.when(x.isNull() | (x == "") | x.contains("/") | x.contains(".."), 1).otherwise(0) for x in [*parts.values(), F.lit("ok")]]) == 1).alias("bad")
        aggregates = [F.count(F.lit(1)).alias("n"), whole] + ([token_of.alias("token")] if isinstance(token_of, Column) else [])
        # one row per partition of this write: what the protocol below handles one by one
        found = df.groupBy(key.alias("key")).agg(*aggregates).orderBy("key").collect()
        if not found:
            return []
        for r in found:
            if r.bad:
                raise patterns.PatternError(f"bad partition value in key {r.key!r}")
            patterns.check_key(r.key, list(c.parts))
        with ThreadPoolExecutor(AT_ONCE) as pool:
            plans = list(pool.map(lambda r: self._plan(r, token, token_of, optimistic), found))
        fresh = [p for p in plans if p.prior is None]
        self.logs.repair([p.prior for p in plans if p.prior is not None])
        stamped_us = keys.micros(inserted_at or c.clock())
        done = {p.key: p.prior for p in plans if p.prior is not None}
        results = {k: self.logs.result(x, ref_name(x.ref_micro_ts, x.token, x.attempt_id, x.partition)) for k, x in done.items()}
        if fresh:
            rows = self._rows(df, parts, key, fresh, stamped_us)
            for v in c.views:  # before the data: any data file implies its tuples
                self._emit(v, rows)
            self._data(rows)
            late = self._commit(fresh, stamped_us, results)
        self.counters.update(records=sum(p.rows for p in fresh), partitions=len(fresh))
        if fresh and late:
            raise CommitAfterTimeout(_by_key(results))
        return _by_key(results)

    def _plan(self, r: Row, token, token_of, optimistic) -> _Plan:
        own = token
        if isinstance(token_of, Column):
            own = r.token
        elif token_of is not None:
            own = token_of(r.key)
        if token_of is not None:
            keys.check_token(own or "")
        attempt = keys.new_id()
        if own is None:
            return _Plan(r.key, r.n, attempt, attempt)
        return _Plan(r.key, r.n, own, attempt, None if optimistic else self.logs.find(r.key, own))

    def _rows(self, df, parts, key, fresh, stamped_us) -> DataFrame:
        """The rows to write, in the record's schema, with path columns."""
        c = self.config
        names = self.spark.createDataFrame([(p.key, f"{p.token}-{p.attempt}") for p in fresh], "__key string, __commit string")
        out = df.withColumns({f"__pk_{p}": x for p, x in parts.items()}).withColumn("__key", key).join(names, "__key").drop("__key")
        path = [*(f"__pk_{p}" for p in c.parts), "__commit"]
        if c.inserted_at:
            out = out.withColumn(c.inserted_at, F.timestamp_micros(F.lit(stamped_us)))
        return zero_fill(out, c.schema, c.optional, tuple(path))

    def _data(self, rows: DataFrame) -> None:
        path = [x for x in rows.columns if x.startswith("__pk_") or x == "__commit"]
        # one file for each partition, and more only where one is too large for a task
        spread = rows.hint("rebalance", *path)
        spread.write.partitionBy(*path).mode("append").option("compression", self.config.codec).parquet(self.config.path("data"))

    def _emit(self, view: views.View, rows: DataFrame) -> None:
        add_tuples(self.spark, self.config, view, views.distinct_tuples(rows, view))

    def _commit(self, fresh: list[_Plan], stamped_us: int, results: dict[str, WriteResult]) -> bool:
        """Refs, then each partition's lock, then the log rows of those locked here; whether any came too late.

        Refs and log rows are one small file each, however many partitions;
        locks are made some at a time, and each is judged by when it was made.
        """
        stamps = [keys.micros(self.config.clock()) for _ in fresh]
        names = [ref_name(us, p.token, p.attempt, p.key) for us, p in zip(stamps, fresh, strict=True)]
        self.logs.add_refs(names)
        wait = self.timing.commit_timeout.total_seconds() * 1e6

        def lock(p: _Plan, us: int) -> tuple[Commit, bool, bool] | Exception:
            """The commit that stands, whether it is ours, whether it came too late."""
            commit = Commit(p.key, p.token, p.attempt, us, stamped_us, p.rows)
            try:
                if self.logs.lock(commit):
                    return commit, True, keys.micros(self.config.clock()) - us > wait
                return self.logs.find(p.key, p.token), False, False
            except Exception as e:  # raised below, when the others are known
                return e

        with ThreadPoolExecutor(AT_ONCE) as pool:
            made = list(pool.map(lock, fresh, stamps))
        failed = [x for x in made if isinstance(x, Exception)]
        standing = [x for x in made if not isinstance(x, Exception)]
        self.logs.add_commits([c for c, ours, _ in standing if ours])
        self.logs.repair([c for c, ours, _ in standing if not ours])
        self.counters["optimistic_collisions"] += sum(not ours for _, ours, _ in standing)
        self.counters["commit_after_timeout"] += sum(late for _, _, late in standing)
        for c, _, _ in standing:
            results[c.partition] = self.logs.result(c, ref_name(c.ref_micro_ts, c.token, c.attempt_id, c.partition))
        if failed:
            raise PartialWrite(_by_key(results), failed[0]) from failed[0]
        return any(late for _, _, late in standing)

    @measured
    def restamp(self, prior: WriteResult) -> WriteResult:
        """A new ref for data that consumers may have passed."""
        base = self.config.path("data") + "/"
        if not prior.data_path.startswith(base) or not prior.ref_path.startswith(self.config.path("log", "refs") + "/"):
            raise ValueError(f"{prior.data_path} does not belong to this dataset")
        *segments, commit = prior.data_path.removeprefix(base).split("/")
        token, attempt = keys.parse_commit_name(keys.unescape_folder(commit.removeprefix("__commit=")))
        pairs = [tuple(map(keys.unescape_folder, s.split("=", 1))) for s in segments]
        key = "/".join(f"{p.removeprefix('__pk_')}={v}" for p, v in pairs)
        us = keys.micros(self.config.clock())
        name = ref_name(us, token, attempt, key)
        self.logs.add_refs([name])
        out = WriteResult(name, prior.data_path, self.config.path("log", "refs", name), keys.from_micros(us), prior.row_count)
        if keys.micros(self.config.clock()) - us > self.timing.commit_timeout.total_seconds() * 1e6:
            raise CommitAfterTimeout([out])
        return out

