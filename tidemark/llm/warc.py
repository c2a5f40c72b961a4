"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package holds stored members: ``archive/data.warc.gz`` (one gzip member per
record, so that each can be read alone) and ``indexes/index.cdxj`` (one line
per record: key, time, JSON with offset and length).  Packages lie in the
folder the cluster shares, under names that no two attempts of a task share;
the list of packages is written down once, so what a lost or repeated attempt
left behind is never read.

Of records with equal payloads that with the smallest page_id is a response,
the others are revisits of it.  Digests, not pages, are grouped and joined,
with partial minima, so a payload that a third of all pages share makes no
hot task; a page's html moves once.

Defined results: null html is an empty payload, null urls are empty; a null
page_id counts as larger than any other; repeated rows with the smallest
page_id are all responses; smaller payloads than ``least`` bytes are always
responses; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, read, scratch
from tidemark.llm.zip_ranges import ZipRanges, filesystem

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: All records bear this date: equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
ID = "urn:page:"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        # what may not stand in a URI, white space and controls above all, is percent-encoded
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{ID}{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), the HTTP head and the payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix(f"<{ID}").removesuffix(">")
    return int(number) if number else None


class PackageWriter:
    """One ZIP package, written as a stream."""

    def __init__(self, fs: pafs.FileSystem, path: str, level: int = 6) -> None:
        self.path, self.level, self.at, self.index = path, level, 0, []
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        data = gzip.compress(record_bytes(page_id, url, payload, refers_to), self.level, mtime=0)
        self.data.write(data)
        entry = {"offset": self.at, "length": len(data), "page": page_id}
        self.index.append(f"{quote(url or '', safe='/:')} 20240101000000 {json.dumps(entry)}\n")
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.index), self.at


def write_packages(records: DataFrame, folder: str, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) rows; returns the list of packages.

    A package is closed once its records reach ``roll_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        open_: PackageWriter | None = None
        done = []
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                if open_ is None:
                    open_ = PackageWriter(fs, f"{at}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.zip")
                open_.add(page.as_py(), url.as_py(), payload.as_py() or b"", refers.as_py())
                if open_.at >= roll_bytes:
                    done.append(open_.close())
                    open_ = None
        if open_ is not None:
            done.append(open_.close())
        paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    cols = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("payload"), F.col("refers_to").cast("long")]
    return cut(records.select(*cols).mapInArrow(run, MANIFEST))


def read_packages(packages: DataFrame, folder: str, payloads: bool = True, read_bytes: int = 4 << 20, batch_bytes: int = 16 << 20) -> DataFrame:
    """The records of the listed packages, found through their indexes.

    Neighbouring records are read in one range of about ``read_bytes``; a
    response whose payload does not have its digest is an error.
    """

    def records(package: ZipRanges) -> Iterator[tuple]:
        lines = package.read(INDEX).decode("utf-8").splitlines()
        spans = sorted((e["offset"], e["length"]) for e in (json.loads(x.split(" ", 2)[2]) for x in lines))
        k = 0
        while k < len(spans):
            start, end, first = spans[k][0], spans[k][0], k
            while k < len(spans) and spans[k][0] == end and (k == first or end - start < read_bytes):
                end += spans[k][1]
                k += 1
            chunk = package.read(DATA, start, end - start)
            for offset, n in spans[first:k]:
                fields, http, payload = parse_record(zlib.decompress(chunk[offset - start : offset - start + n], 31))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                size = int(http.rpartition(b"Content-Length: ")[2])
                if not revisit and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError(f"record {fields['warc-record-id']} is damaged")
                yield _page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], digest, size, _page(fields.get("warc-refers-to")), payload if payloads and not revisit else None

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as file:
                    rows, size = [], 0
                    for r in records(ZipRanges(file)):
                        rows.append(r)
                        size += 100 + len(r[-1] or b"")
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return packages.select("path").mapInArrow(run, RECORD)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) for each row of (page_id, url, html)."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("digest", F.sha1("payload"))
    equal = page.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = page.select("page_id", "digest").join(equal, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    same = page["page_id"].eqNullSafe(later["p"]) & (page["digest"] == later["d"])
    return page.join(later, same, "left").select("page_id", "url", "payload", "refers_to")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to packages and read back."""
    folder = scratch(spark, "warc")
    packages = write_packages(with_revisits(read(spark, sf_dir, "pages")), folder)
    spread = packages.repartition(max(1, packages.count()), "path")
    return read_packages(spread, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to
FROM d
"""
