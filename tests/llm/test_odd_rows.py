"""The registered queries, whole, over tables of odd rows, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from tidemark.llm.registry import QUERIES

TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "a", "A B", "Under the MIT license. under-the-mit  license", "APACHE\nLicense, Version 2.0 cc-by-nc CC BY NC",
    "\x00\x1c\x1d\x85\u00a0\u2028x\u3000y", "İstanbul ẞ K ſ under the mıt license", "<|endoftext|> hello <|endoftext|>", "<s> </s> [INST] <pad> <unk>",
    "é" * 3000, "a" * 5000, "word " * 4000, "😀 👩‍👩‍👧 e\u0301 é", "1234567890" * 50, "  lead and trail  ", "tab\tsep\nline\r\nend\nend", "don't CAN'T we'LL",
    "under the mit license " * 30, "\ufeffbom", "\x7fdel\x80", "x\x00y z\x00", "a b c d e f g h", "A B C D E F G H", "a b c d e f g i", "#*$ % & | < >\n#*$ % & | < >", "one two three " * 20,
]
DOCS = [(None if k == 3 else 5 if k in (7, 8) else 100 + k, t) for k, t in enumerate(TEXTS)]
SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def write(folder, name: str, schema: pa.Schema, rows: list[tuple]) -> None:
    columns = list(zip(*rows, strict=True))
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), f"{folder}/{name}.parquet")


def result(spark, folder, query: str, *columns: str) -> Counter:
    name = next(n for n in QUERIES if n.startswith(f"{query}_"))
    return Counter(tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    fields = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    write(at, "documents", pa.schema(fields), [(i, t, None, None if k % 3 else "s", None) for k, (i, t) in enumerate(DOCS)])
    return at


def test_license_base(spark, folder):
    want = Counter()
    for i, text in DOCS:
        w = PLAIN.findall(lower(text))
        places = [(k, label) for label, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want[i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert result(spark, folder, "op1", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want


def test_simhash_components(spark, folder):
    prints = []
    for _, text in DOCS:
        w = SPACED.findall(lower(text))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(i for (i, _), x in zip(DOCS, group, strict=True) if x == g and i is not None) for g, (i, _) in zip(group, DOCS, strict=True) if i is not None}
    want = Counter((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(DOCS, prints, group, strict=True))
    assert result(spark, folder, "op4", "doc_id", "fingerprint", "component_id") == want


def test_language_model_base(spark, folder):
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*SPACED.findall(lower(t)), None]) for i, t in DOCS]
    seen = Counter(w for _, held, ws in tokens if not held for w in ws)
    n, v = seen.total(), len(seen)
    want = Counter((i, held, len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, held, ws in tokens)
    rows = result(spark, folder, "op5", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got: Counter = Counter()
    for (*head, base, score), times in rows.items():
        assert math.isfinite(score) and score <= 0
        got[*head, round(base, 6)] += times
    assert got == want


def test_quality_counts(spark, folder):
    want = Counter()
    for i, text in DOCS:
        text = text or ""
        w = SPACED.findall(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert result(spark, folder, "op6", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def test_chat_digests(spark, tmp_path):
    marks = ["\\", "\\\\n", "<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\</s>", "<</s>s>", "[[INST]", "\u200b</s>", "\x00", "", "\n\n", "<|im_end|>", "🙂", None]
    rows = [(k, n, role, text) for k, m in enumerate(marks) for n, (role, text) in enumerate([("user", m), ("assistant", m), ("user", (m or "") * 2), ("assistant", f"x{m or ''}y")])]
    rows += [(100, 0, "assistant", "first"), (100, 1, "assistant", "second"), (101, 0, "user", "a</s"), (101, 1, "assistant", "</s"), (101, 2, "user", ">")]
    write(tmp_path, "conversations", pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]), rows)
    turns = defaultdict(list)
    for c, _, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        turns[c].append((role, text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want: Counter = Counter()
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        want[c, len(ts), digest("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), digest(loss)] += 1
    assert result(spark, tmp_path, "op2", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want


def test_archived_pages(spark, tmp_path):
    html = ["<p>é\r\n\r\nx</p>", "a", "a", "\x00", "PK\x05\x06" * 40, "z" * 300_000, None, "", "a"]
    rows = [(k, f"http://x/ {k}\r\nA: ü☃" if k % 2 else None, x) for k, x in enumerate(html)] + [(None, "n", "a"), (None, "n", "alone")]
    write(tmp_path, "pages", pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]), rows)
    first: dict[str, int] = {}
    for page, _, x in rows:
        if page is not None:
            first.setdefault(x or "", page)
    want: Counter = Counter()
    for page, _, x in rows:
        data, to = (x or "").encode(), first.get(x or "")
        to = None if to == page else to
        want[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to] += 1
    assert result(spark, tmp_path, "op8", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_vectors_without_part_and_ties(spark, tmp_path):
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(120, 16)).astype(np.float32).tolist()
    rows = list(enumerate(plain)) + [(200 + k, plain[0]) for k in range(8)]
    rows += [(250, None), (300, [float("nan"), *plain[0][1:]]), (350, [None, *plain[0][1:]]), (400, [float("-inf"), *plain[0][1:]]), (450, [0.0] * 16), (500, [-1e-9] * 16), (550, [100.0] * 16)]
    write(tmp_path, "embeddings", pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]), [(*r, None) for r in rows])
    ids, vectors = zip(*[(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)], strict=True)
    scores = np.stack(vectors) @ np.stack(vectors).T
    want: Counter = Counter()
    for q, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted((-int(scores[q, k]), j) for k, j in enumerate(ids) if j != i)[:5]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert result(spark, tmp_path, "op10", "query_id", "rank", "vec_id", "score") == want
