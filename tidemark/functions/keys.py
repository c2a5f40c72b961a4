"""Keys, tokens, attempt ids, ref keys and offsets, as columns and as strings."""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

REFS = "refs/"
#: 16 digits of microseconds, token, 32 hex digits of the attempt, escaped key.
REF_NAME = r"^(\d{16})-([^;]+)-([0-9a-f]{32});(.*?)(\.ref)?$"
ATTEMPT = re.compile(r"[0-9a-f]{32}")
#: What URL form encoding does differently from path escaping.
PATH_FIXES = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"))


def hive_key(columns: dict[str, Column]) -> Column:
    """``part=value/part=value``."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{p}="), c.cast("string")) for p, c in columns.items()])


def micros(t: datetime) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def from_micros(us: int) -> datetime:
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000, tzinfo=None)


def path_escape(text: Column) -> Column:
    out = F.url_encode(text)
    for a, b in PATH_FIXES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def path_unescape(text: Column) -> Column:
    """Null where an escape is malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


# What Spark writes as % and two hex digits in the names of partition folders.
FOLDER_SPECIALS = "%" + "".join(map(chr, range(1, 32))) + "\x7f\"#'*/:=?\\{[]^"


def folder_escape(text: Column) -> Column:
    for c in FOLDER_SPECIALS:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def escape_folder(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in FOLDER_SPECIALS else c for c in text)


def unescape_folder(text: str) -> str:
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def data_folder(base: str, partition: str, token: str, attempt: str) -> str:
    """Where the rows of a write to one partition lie: Spark's folders for its path columns."""
    pairs = [s.partition("=") for s in partition.split("/")]
    return "/".join([base, *(f"{escape_folder('__pk_' + p)}={escape_folder(v)}" for p, _, v in pairs), f"__commit={escape_folder(f'{token}-{attempt}')}"])


def data_folder_of(base: str, partition: Column, token: Column, attempt: Column) -> Column:
    def folder(s: Column) -> Column:
        at = F.instr(s, "=")
        return F.concat(folder_escape(F.concat(F.lit("__pk_"), F.substr(s, F.lit(1), at - 1))), F.lit("="), folder_escape(F.substr(s, at + 1)))

    folders = F.array_join(F.transform(F.split(partition, "/"), folder), "/")
    return F.concat(F.lit(base + "/"), folders, F.lit("/__commit="), folder_escape(commit_name(token, attempt)))


def key_values(partition: Column, parts: Sequence[str]) -> dict[str, Column]:
    """The values of a partition key, by part."""
    return {p: F.substr(F.get(F.split(partition, "/"), F.lit(i)), F.lit(len(p) + 2)) for i, p in enumerate(parts)}


def stamp(us: Column) -> Column:
    return F.lpad(us.cast("string"), 16, "0")


def offset_at(t: datetime | int) -> str:
    """The offset before every ref stamped at ``t`` or later."""
    return f"{REFS}{(t if isinstance(t, int) else micros(t)):016d}"


def ref_key(us: Column, token: Column, attempt: Column, key: Column) -> Column:
    return F.concat(F.lit(REFS), stamp(us), F.lit("-"), token, F.lit("-"), attempt, F.lit(";"), path_escape(key), F.lit(".ref"))


def parse_ref_key(name: Column) -> Column:
    """(ref_micro_ts, token, attempt_id, partition), or null where malformed."""
    base = F.regexp_replace(name, f"^{REFS}", "")
    part = lambda k: F.regexp_extract(base, REF_NAME, k)
    key = path_unescape(part(4))
    ok = base.rlike(REF_NAME) & key.isNotNull() & (key != "")
    return F.when(ok, F.struct(part(1).cast("long").alias("ref_micro_ts"), part(2).alias("token"), part(3).alias("attempt_id"), key.alias("partition")))


def commit_name(token: Column, attempt: Column) -> Column:
    return F.concat(token, F.lit("-"), attempt)


def parse_commit_name(name: str) -> tuple[str, str]:
    """Token and attempt; the attempt is the last 32 hex digits, as tokens may hold dashes."""
    if len(name) < 34 or name[-33] != "-" or not ATTEMPT.fullmatch(name[-32:]):
        raise ValueError(f"{name!r} does not end in an attempt id")
    return name[:-33], name[-32:]


def new_id() -> str:
    """A time-ordered UUID (version 7) in 32 hex digits."""
    ms = time.time_ns() // 1_000_000
    bits = (ms << 80) | (7 << 76) | ((int.from_bytes(os.urandom(2), "big") & 0xFFF) << 64) | (2 << 62) | (int.from_bytes(os.urandom(8), "big") & (1 << 62) - 1)
    return uuid.UUID(int=bits).hex


def check_token(token: str) -> None:
    if not token or len(token) > 200 or set(token) & set("/;") or ".." in token or any(not 0x21 <= ord(c) <= 0x7E for c in token):
        raise ValueError(f"bad token {token!r}: 1 to 200 printable ASCII characters without '/', ';' and '..'")
