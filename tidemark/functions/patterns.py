"""Key patterns: which partitions a read addresses.

A pattern is ``*`` (or empty) for all, or one segment for each part joined by
``/``: ``*``, ``part=value``, ``part=prefix*`` or ``part=from..to`` with an
open end allowed, half-open.  Patterns become predicates on the part columns,
which Spark prunes directories by; values compare as bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = set("/?[]{}")


class PatternError(ValueError):
    """A pattern or a partition value is not well formed."""


@dataclass(frozen=True)
class Segment:
    """What one part must meet; kind is any, exact, prefix or range."""

    part: str
    kind: str = "any"
    low: str = ""
    high: str = ""

    def predicate(self, column: Column) -> Column:
        if self.kind == "exact":
            return column == self.low
        if self.kind == "prefix" and self.low:
            return column.startswith(self.low)
        if self.kind == "range":
            bounds = [column >= self.low] * bool(self.low) + [column < self.high] * bool(self.high)
            return reduce(Column.__and__, bounds)
        return F.lit(True)

    def matches(self, value: str) -> bool:
        v, low, high = (x.encode() for x in (value, self.low, self.high))
        return {"any": True, "exact": v == low, "prefix": v.startswith(low), "range": low <= v and (not high or v < high)}[self.kind]


def check_parts(parts: Sequence[str]) -> None:
    if not parts or len(set(parts)) != len(parts):
        raise PatternError("partition parts must be given, each once")
    for p in parts:
        if not p or set(p) & {"=", "/"}:
            raise PatternError(f"bad partition part {p!r}: it must be non-empty, without '=' and '/'")


def check_value(value: str) -> None:
    if not value or "/" in value or ".." in value:
        raise PatternError(f"bad partition value {value!r}: it must be non-empty, without '/' and '..'")


def check_key(key: str, parts: Sequence[str]) -> dict[str, str]:
    """The values of a partition key, by part."""
    segments = key.split("/")
    if len(segments) != len(parts):
        raise PatternError(f"key {key!r} has {len(segments)} segments, {len(parts)} are needed")
    out = {}
    for s, p in zip(segments, parts, strict=True):
        name, eq, value = s.partition("=")
        if not eq or name != p:
            raise PatternError(f"segment {s!r} of key {key!r} must start with {p + '='!r}")
        check_value(value)
        out[p] = value
    return out


def _segment(text: str, part: str) -> Segment:
    if text == "*":
        return Segment(part)
    name, eq, value = text.partition("=")
    if not eq or name != part:
        raise PatternError(f"segment {text!r} must be '*' or start with {part + '='!r}")
    if bad := set(value) & RESERVED:
        raise PatternError(f"segment {text!r} holds {''.join(sorted(bad))!r}")
    if ".." in value:
        low, _, high = value.partition("..")
        if ".." in high or high.startswith("."):
            raise PatternError(f"segment {text!r} has more than one '..'")
        if "*" in value or not (low or high):
            raise PatternError(f"range {text!r} must have an end, and no '*'")
        if low and high and low.encode() > high.encode():
            raise PatternError(f"range {text!r} is upside down")
        return Segment(part, "range", low, high)
    if "*" in value:
        if value.index("*") != len(value) - 1:
            raise PatternError(f"segment {text!r} may have '*' at its end only")
        return Segment(part, "prefix", value[:-1])
    return Segment(part, "exact", value)


def parse(pattern: str, parts: Sequence[str]) -> tuple[Segment, ...]:
    if pattern in ("", "*"):
        return tuple(Segment(p) for p in parts)
    texts = pattern.split("/")
    if len(texts) != len(parts):
        raise PatternError(f"pattern {pattern!r} has {len(texts)} segments, {len(parts)} are needed")
    return tuple(_segment(t, p) for t, p in zip(texts, parts, strict=True))


def parse_all(patterns: Sequence[str], parts: Sequence[str]) -> list[tuple[Segment, ...]]:
    """Each distinct pattern once; errors name the pattern and its place."""
    out = []
    for k, p in enumerate(patterns):
        try:
            found = parse(p, parts)
        except PatternError as e:
            raise PatternError(f"pattern {k} ({p!r}): {e}") from None
        if found not in out:
            out.append(found)
    return out


def matches(key: str, pattern: str, parts: Sequence[str]) -> bool:
    """Whether one key meets one pattern, without Spark."""
    segments = [s.partition("=") for s in key.split("/")]
    if [n for n, _, _ in segments] != list(parts) or not all(v for _, _, v in segments):
        return False
    return all(s.matches(v) for s, (_, _, v) in zip(parse(pattern, parts), segments, strict=True))


def predicate(patterns: Sequence[str], columns: dict[str, Column]) -> Column:
    """OR over patterns, AND over segments; no pattern meets nothing.

    One predicate over one scan: a row that several patterns meet comes once.
    """
    found = parse_all(patterns, list(columns))
    each = [reduce(Column.__and__, [s.predicate(columns[s.part]) for s in segments]) for segments in found]
    return reduce(Column.__or__, each) if each else F.lit(False)
