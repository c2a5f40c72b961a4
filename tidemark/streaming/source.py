"""The change stream as a Structured Streaming source.

The source yields entries (a row per write), a page at a time; records are
joined to them inside ``foreachBatch``, on the executors.  Its offset is the
last ref key visited, so refs that do not pass move it too, and replaying a
checkpointed interval gives the same entries, as refs are never changed.
"""

from __future__ import annotations

import heapq
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidemark.functions.durations import parse_duration
from tidemark.functions.keys import REF_NAME, REFS, data_folder
from tidemark.sources.reader import Reader

ENTRY = "offset string, key string, data_path string, ref_path string, inserted_at timestamp, row_count long, token string, attempt_id string"
FORMAT = "tidemark_changes"
EPOCH = datetime(1970, 1, 1)
#: Refs that the driver holds at a time.
AT_ONCE = 10_000


def _log(root: str, name: str) -> ds.Dataset | None:
    fs, at = (pafs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if root.startswith(("file:", "/")) else pafs.FileSystem.from_uri(root)
    path = f"{at.rstrip('/')}/log/{name}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
    return ds.dataset(files, filesystem=fs, format="parquet") if files else None


def _next_refs(root: str, since: str, until: str, count: int) -> list[str]:
    """The first ``count`` refs after ``since``, up to and with ``until``, in order.

    The scan is bounded by statistics and holds ``count`` names at a time.
    """
    log = _log(root, "refs")
    if log is None:
        return []
    bounds = (ds.field("ref_key") > since) & (ds.field("ref_key") <= until)
    least: list[str] = []
    for batch in log.to_batches(columns=["ref_key"], filter=bounds):
        least = heapq.nsmallest(count, {*least, *batch.column(0).to_pylist()})
    return least


def _commits_of(root: str, tokens: list[str]) -> dict[tuple[str, str], dict]:
    """The commits of some writes."""
    log = _log(root, "commits") if tokens else None
    if log is None:
        return {}
    found = log.to_table(columns=["partition", "token", "attempt_id", "row_count"], filter=ds.field("token").isin(tokens))
    return {(c["partition"], c["token"]): c for c in found.to_pylist()}


def decode_ref(name: str) -> tuple[int, str, str, str] | None:
    m = re.match(REF_NAME, name.removeprefix(REFS), re.S)
    if not m or not m[4] or re.search(r"%(?![0-9A-Fa-f]{2})", m[4]):
        return None
    try:
        return int(m[1]), m[2], m[3], unquote(m[4], errors="strict")
    except UnicodeDecodeError:
        return None


def read_page(root: str, since: str, until: str, cutoff_us: int, page: int) -> tuple[list[tuple], str]:
    """Entries after ``since`` up to and with ``until``, at most ``page``, and the last ref visited."""
    cutoff, out, at = f"{REFS}{cutoff_us:016d}", [], since
    end = min(until, cutoff) if until else cutoff
    while len(out) < page:
        names = _next_refs(root, at, end, min(page, AT_ONCE))
        refs = [(name, decode_ref(name)) for name in names]
        commits = _commits_of(root, sorted({r[1] for _, r in refs if r}))
        for name, ref in refs:
            if len(out) >= page:
                return out, at
            at = name
            commit = commits.get((ref[3], ref[1])) if ref else None
            if commit and commit["attempt_id"] == ref[2]:
                us, token, attempt, key = ref
                path = data_folder(f"{root.rstrip('/')}/data", key, token, attempt)
                out.append((name, key, path, name, EPOCH + timedelta(microseconds=us), commit["row_count"], token, attempt))
        if len(names) < min(page, AT_ONCE):
            break
    return out, at


class ChangeStream(DataSource):
    """Options: root, settle (a duration), page (entries of a micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType | str:
        return ENTRY

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        o = self.options
        return EntryReader(o["root"], parse_duration(o.get("settle", "0")), int(o.get("page", "1000")))


class EntryReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, settle: timedelta, page: int) -> None:
        self.root, self.settle, self.page = root, settle, page

    def initialOffset(self) -> dict:
        return {"ref_key": ""}

    def _cutoff(self) -> int:
        return time.time_ns() // 1000 - self.settle // timedelta(microseconds=1)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = read_page(self.root, start["ref_key"], "", self._cutoff(), self.page)
        return iter(rows), {"ref_key": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Given again after a restart: no cutoff, as these refs were settled then."""
        return iter(read_page(self.root, start["ref_key"], end["ref_key"], 10**16 - 1, 1 << 60)[0] if end["ref_key"] else [])


def read_changes(spark: SparkSession, reader: Reader, page: int = 1000) -> DataFrame:
    """The dataset's entries as a streaming DataFrame."""
    spark.dataSource.register(ChangeStream)
    micros = reader.timing.settle // timedelta(microseconds=1)
    return spark.readStream.format(FORMAT).option("root", reader.config.root).option("settle", f"{micros}us").option("page", str(page)).load()


def with_records(reader: Reader, each: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: joins a batch's entries to their records, every version once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        each(batch, reader.read_entries(batch, history=True), batch_id)

    return run


def process_entries(spark: SparkSession, reader: Reader, since: str, each: Callable[[DataFrame, DataFrame], None], page: int = 1000, until: str = "") -> str:
    """Drains the stream page by page, ``each(entries, records)``; returns the offset to go on from.

    Records hold every version, without replicas.  A batch that fails is
    given again on the next call with its offset: delivery is at least once.
    """
    while True:
        found = reader.poll(since, page, until)
        entries = found.entries.cache()
        try:
            if entries.head(1):
                each(entries, reader.read_entries(entries, history=True))
        finally:
            entries.unpersist()
        if found.next_offset == since:
            return since
        since = found.next_offset
