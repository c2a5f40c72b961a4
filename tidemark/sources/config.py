"""What a dataset is: where it lies, how it is keyed, how long commits may take."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import patterns
from tidemark.functions.durations import parse_duration
from tidemark.operators.views import View
from tidemark.sources.files import Files

CODECS = {"": "snappy", "snappy": "snappy", "zstd": "zstd", "gzip": "gzip", "uncompressed": "uncompressed"}
COMMIT_TIMEOUT, CLOCK_SKEW = "commit-timeout", "max-clock-skew"
TIMEOUT_FLOOR, TIMEOUT_ADVISED = timedelta(milliseconds=1), timedelta(seconds=8)


class ConfigError(ValueError):
    pass


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class StoreConfig:
    """``parts`` maps each partition part to a column of the record, or to an expression."""

    root: str
    schema: T.StructType
    parts: dict[str, str | Column]
    entity: Sequence[str] = ()
    version: str | None = None
    inserted_at: str | None = None
    compression: str = ""
    views: Sequence[View] = ()
    optional: tuple[str, ...] = ()
    clock: Callable[[], datetime] = field(default=utc_now, compare=False)

    def __post_init__(self) -> None:
        patterns.check_parts(list(self.parts))
        if bool(self.entity) != bool(self.version):
            raise ConfigError("entity and version go together")
        for c in [*self.entity, *([self.version] if self.version else [])]:
            if c not in self.schema.names:
                raise ConfigError(f"the record has no field {c}")
        if self.compression not in CODECS:
            raise ConfigError(f"unknown codec {self.compression!r}")
        if self.inserted_at is not None and (self.inserted_at not in self.schema.names or not isinstance(self.schema[self.inserted_at].dataType, (T.TimestampType, T.TimestampNTZType))):
            raise ConfigError(f"{self.inserted_at} must be a time field of the record")
        names = [v.name for v in self.views]
        if len(set(names)) != len(names):
            raise ConfigError("view names must differ")
        for v in self.views:
            v.check(self.schema)

    @property
    def codec(self) -> str:
        return CODECS[self.compression]

    def path(self, *rest: str) -> str:
        return "/".join([self.root.rstrip("/"), *rest])

    def part_columns(self) -> dict[str, Column]:
        return {p: (F.col(c) if isinstance(c, str) else c).cast("string") for p, c in self.parts.items()}

    def narrow(self, schema: T.StructType, **changes) -> StoreConfig:
        """The same dataset seen through fewer or other fields."""
        return replace(self, schema=schema, inserted_at=None, views=(), **{"parts": dict(self.parts)} | changes)


@dataclass(frozen=True)
class Timing:
    commit_timeout: timedelta
    max_clock_skew: timedelta
    advice: str = ""

    @property
    def settle(self) -> timedelta:
        return self.commit_timeout + self.max_clock_skew


def write_timing(spark: SparkSession, root: str, commit_timeout: str, max_clock_skew: str) -> None:
    files = Files(spark)
    for name, text in ((COMMIT_TIMEOUT, commit_timeout), (CLOCK_SKEW, max_clock_skew)):
        files.write(f"{root.rstrip('/')}/config/{name}", text)


def load_timing(spark: SparkSession, root: str) -> Timing:
    """Both files must be there; a short timeout is allowed, with advice."""
    files, found = Files(spark), []
    for name, floor in ((COMMIT_TIMEOUT, TIMEOUT_FLOOR), (CLOCK_SKEW, timedelta(0))):
        path = f"{root.rstrip('/')}/config/{name}"
        text = files.read(path)
        if text is None:
            raise ConfigError(f"{path} is missing")
        try:
            value = parse_duration(text.strip())
        except ValueError as e:
            raise ConfigError(f"{path}: {e}") from None
        if value < floor:
            raise ConfigError(f"{path}: {text.strip()} is below {floor}")
        found.append(value)
    advice = f"commit timeout {found[0]} is below {TIMEOUT_ADVISED}" if found[0] < TIMEOUT_ADVISED else ""
    return Timing(*found, advice)
