"""A dataset's writer and reader together."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.sources.config import StoreConfig, Timing, load_timing
from tidemark.sources.reader import Reader, ViewReader
from tidemark.sources.writer import Writer


class Store:
    def __init__(self, spark: SparkSession, config: StoreConfig, timing: Timing | None = None) -> None:
        self.spark, self.config = spark, config
        self.timing = timing or load_timing(spark, config.root)
        self.writer, self.reader = Writer(spark, config, self.timing), Reader(spark, config, self.timing)

    def __getattr__(self, name: str):
        for half in ("writer", "reader"):
            if name not in ("writer", "reader") and hasattr(self.__dict__.get(half), name):
                return getattr(self.__dict__[half], name)
        raise AttributeError(name)

    def view(self, name: str, bind=None) -> ViewReader:
        return ViewReader(self.spark, self.config, next(v for v in self.config.views if v.name == name), bind)
