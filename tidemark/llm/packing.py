"""Packing token sequences by minimum bin slack.

Documents are cut at multiples of the capacity; full pieces are sequences of
their own and what remains of each document, under one capacity, is packed.
Windows of remainders are filled by a subset-sum search: a bitset holds which
sums the window's lengths reach (one shift and or for each power-of-two bundle
of equal lengths), the sum closest to the capacity is taken, and the count of
each length is traced back through the stored bitsets.  This is repeated
until the window is empty.  Only the last few sequences of a window have room
left; the next window starts with their pieces, so padding does not grow with
the number of windows a task reads.

Scale: texts become ids where they are read, and only (id, start, length,
checksum) moves.  Pieces are spread by a hash of their document, as many
partitions as the rows need, and a task holds one window at a time, so a key
or source with a third of the rows makes no difference.

Ids come from the byte-level BPE vocabulary at ``vocabulary``.  Texts of
printable ASCII, Latin and white space take a faster tokenizer with the same
vocabulary and the same pattern of words; tests compare both on every document
of a table, on runs around ``LONG_RUN`` and on random strings.  Any other
character, a very long run of one kind, or the name of the special token takes
the full tokenizer.

Defined results: a null or empty text is the end id alone; null identifiers
are kept; repeated rows are packed as pieces of their own; pieces of equal
length are taken in order of (doc_id, start, checksum), so equal input gives
equal sequences; extra columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, pick, read

CAPACITY = 2048
#: So many equal pieces stay together.
EQUAL_PIECES = 64
END = 1
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECE}, sequence_id long, offset long"
#: Texts of these characters only have the same ids by either tokenizer.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
#: Longer runs of one kind take the full tokenizer: the fast one's time grows with their square.
LONG_RUN = 500
BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")


def _plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None and "<|endoftext|>" not in text and max(map(len, text.split()), default=0) < LONG_RUN and not BLANKS.search(text)


@lru_cache(maxsize=2)
def _encoders(vocabulary: tuple[str, str]):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full, ranks = (public_tokenizers.path(v) for v in vocabulary)
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return Tokenizer.from_file(full), fast


def token_ids(text: str | None, vocabulary: tuple[str, str] = VOCABULARY) -> np.ndarray:
    """The ids of one text and the end id, as little-endian unsigned 32-bit numbers."""
    full, fast = _encoders(vocabulary)
    text = text or ""
    if _plain(text):
        ids = fast.encode_ordinary(text)
    else:
        ids = full.encode(text, add_special_tokens=False).ids
    return np.array([*ids, END], dtype="<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str] = VOCABULARY) -> DataFrame:
    """Every document's pieces: full ones, then what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), vocabulary)
                n = len(ids)
                rows += [(doc, k, min(capacity, n - k), zlib.crc32(ids[k : k + capacity].tobytes()), n) for k in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is closest to the capacity from below.

    A bitset of reachable sums is kept after each bundle of 1, 2, 4, ... equal
    lengths; the way back takes a bundle only where the sum needs it.
    """
    limit = (1 << (capacity + 1)) - 1
    goal = 1 << capacity
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= capacity), reverse=True):
        left, bundle = min(counts[length], capacity // length), 1
        while left:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left, bundle = left - take, bundle * 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def fill_window(lengths: list[int], capacity: int = CAPACITY, keep: float = 1.0) -> list[list[int]]:
    """Sequences of positions in ``lengths``; those filled below ``keep`` of the capacity come last."""
    by: dict[int, list[int]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        by.setdefault(lengths[k], []).append(k)
    counts = {x: len(ks) for x, ks in by.items()}
    out = []
    while counts:
        chosen = best_fill(counts, capacity)
        # the same filling serves as often as its lengths last
        times = min(counts[x] // n for x, n in chosen.items())
        for _ in range(times):
            out.append([by[x].pop() for x, n in chosen.items() for _ in range(n)])
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, window: int = 4096, per_task: int = 65536) -> DataFrame:
    """The pieces with sequence_id and offset."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []
        rows = 0

        def emit(df: pd.DataFrame, sequences: list[list[int]]) -> pd.DataFrame:
            nonlocal nth
            order = [k for s in sequences for k in s]
            out = df.iloc[order].copy()
            length = df["length"].to_numpy()
            seq, off = [], []
            for s in sequences:
                at = 0
                for k in s:
                    seq.append(nth)
                    off.append(at)
                    at += int(length[k])
                nth += 1
            out["sequence_id"], out["offset"] = np.array(seq, np.int64), np.array(off, np.int64)
            return out

        def flush(last: bool) -> pd.DataFrame:
            nonlocal held, rows
            df = pd.concat(held, ignore_index=True)
            length = df["length"].tolist()
            sequences = fill_window(length, capacity)
            held, rows = [], 0
            if not last:
                room = [s for s in sequences if sum(length[k] for k in s) < capacity]
                sequences = [s for s in sequences if sum(length[k] for k in s) == capacity]
                held, rows = [df.iloc[[k for s in room for k in s]]], sum(map(len, room))
                if rows > window // 2:  # lengths that do not add up: they are not carried for ever
                    sequences, held, rows = sequences + room, [], 0
            return emit(df, sequences)

        for frame in frames:
            full = frame["length"] == capacity
            if full.any():
                part = frame[full].reset_index(drop=True)
                yield emit(part, [[k] for k in range(len(part))])
            part = frame[~full]
            for k in range(0, len(part), window):
                held.append(part.iloc[k : k + window])
                rows += len(held[-1])
                if rows >= window:
                    yield flush(last=False)
        if rows:
            yield flush(last=True)

    # equal pieces are counted where they were cut, then dealt out in groups, so that a piece that a third of the rows repeat is many keys
    found = cut(found.groupBy(*[f.split()[0] for f in PIECE.split(", ")]).agg(F.count(F.lit(1)).alias("copies")))
    tasks = max(1, math.ceil((found.agg(F.sum("copies")).first()[0] or 0) / per_task))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    spread = each.repartition(tasks, F.xxhash64("doc_id", "start", "ids_crc32"), F.floor(F.col("copy") / EQUAL_PIECES))
    spread = spread.sortWithinPartitions("doc_id", "start", "length", "ids_crc32").drop("copies", "copy")
    return spread.mapInPandas(run, PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack(pieces(read(spark, sf_dir, "documents")))
