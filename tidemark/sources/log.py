"""The logs of commits and refs: small append-only tables beside the data.

A commit is decided by its lock, a file that is created once; the log row is
the lock's queryable copy.  A writer that died between both is repaired by
the next one with its token.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import data_folder, from_micros, micros
from tidemark.operators.stream import decode_refs, first_commits
from tidemark.sources.config import StoreConfig
from tidemark.sources.files import Files

COMMITS = "partition string, token string, attempt_id string, ref_micro_ts long, inserted_at_us long, row_count long"
REF_NAMES = "ref_key string"


@dataclass(frozen=True)
class WriteResult:
    offset: str
    data_path: str
    ref_path: str
    inserted_at: datetime
    row_count: int


@dataclass(frozen=True)
class Commit:
    partition: str
    token: str
    attempt_id: str
    ref_micro_ts: int
    inserted_at_us: int
    row_count: int


class Logs:
    def __init__(self, spark: SparkSession, config: StoreConfig) -> None:
        self.spark, self.config, self.files = spark, config, Files(spark)

    def _table(self, name: str, ddl: str) -> DataFrame:
        path = self.config.path("log", name)
        if not self.files.exists(path):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    def _append(self, name: str, ddl: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(self.config.path("log", name))

    def commits(self, where: Column | None = None) -> DataFrame:
        found = self._table("commits", COMMITS)
        return first_commits(found if where is None else found.where(where))

    def refs(self) -> DataFrame:
        """All ref names, with their fields; malformed ones have null fields."""
        return decode_refs(self._table("refs", REF_NAMES).distinct())

    def malformed_refs(self) -> int:
        return self.refs().where(F.col("token").isNull()).count()

    def add_refs(self, keys: list[str]) -> None:
        self._append("refs", REF_NAMES, [(k,) for k in keys])

    def lock_path(self, partition: str, token: str) -> str:
        return self.config.path("log", "locks", hashlib.sha256(f"{partition}|{token}".encode()).hexdigest())

    def find(self, partition: str, token: str) -> Commit | None:
        text = self.files.read(self.lock_path(partition, token))
        return Commit(**json.loads(text)) if text else None

    def repair(self, commits: list[Commit]) -> None:
        """Log rows of locks whose writer did not get to write them."""
        if not commits:
            return
        tokens = [c.token for c in commits]
        logged = {(r.partition, r.token) for r in self.commits().where(F.col("token").isin(tokens)).select("partition", "token").collect()}
        self.add_commits([c for c in commits if (c.partition, c.token) not in logged])

    def repair_all(self, newer_than: datetime | None = None) -> list[Commit]:
        """Log rows of all locks whose writer died before it wrote them; locks stamped before ``newer_than`` are passed over.

        What is locked is committed; until this or a retry of the write it is
        not seen.  Reads no data, and the commit log once.
        """
        least = micros(newer_than) if newer_than else 0
        texts = self.files.read_all(self.config.path("log", "locks"))
        found = [c for c in (Commit(**json.loads(t)) for t in texts) if c.ref_micro_ts >= least]
        if not found:
            return []
        rows = self.spark.createDataFrame([(c.partition, c.token) for c in found], "partition string, token string")
        missing = {tuple(r) for r in rows.join(self.commits(), ["partition", "token"], "left_anti").collect()}
        lost = sorted((c for c in found if (c.partition, c.token) in missing), key=lambda c: c.ref_micro_ts)
        self.add_commits(lost)
        return lost

    def compact(self) -> None:
        """Each log's many small files become few, in order of time, so that stamps prune them.

        Rows that stand twice while files are changed over are read once:
        commits are distinct by write, refs by name.
        """
        for name, ddl, order in (("commits", COMMITS, "ref_micro_ts"), ("refs", REF_NAMES, "ref_key")):
            path = self.config.path("log", name)
            old = self.files.list(path, ".parquet")
            if len(old) < 2:
                continue
            merged = self.spark.read.schema(ddl).parquet(*old).distinct().sort(order)
            merged.write.mode("append").parquet(path)
            self.files.delete(old)

    def lock(self, commit: Commit) -> bool:
        return self.files.create(self.lock_path(commit.partition, commit.token), json.dumps(asdict(commit)))

    def add_commits(self, commits: list[Commit]) -> None:
        self._append("commits", COMMITS, [tuple(asdict(c).values()) for c in commits])

    def data_path(self, partition: str, token: str, attempt: str) -> str:
        return data_folder(self.config.path("data"), partition, token, attempt)

    def result(self, c: Commit, ref_key: str) -> WriteResult:
        return WriteResult(ref_key, self.data_path(c.partition, c.token, c.attempt_id), self.config.path("log", "refs", ref_key), from_micros(c.inserted_at_us), c.row_count)
