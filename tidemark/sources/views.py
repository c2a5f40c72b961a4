"""A view's stored tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.operators.views import View
from tidemark.sources.config import StoreConfig
from tidemark.sources.files import Files


def tuples_of(spark: SparkSession, config: StoreConfig, view: View) -> DataFrame:
    path = config.path("views", view.name)
    ddl = T.StructType([T.StructField(c, T.StringType()) for c in view.columns])
    return spark.read.schema(ddl).parquet(path) if Files(spark).exists(path) else spark.createDataFrame([], ddl)


def add_tuples(spark: SparkSession, config: StoreConfig, view: View, tuples: DataFrame) -> None:
    """Appends the tuples that the view does not hold yet, so that a repeated tuple costs nothing.

    Two writes at once may both add one; look-ups are distinct all the same.
    """
    known = tuples_of(spark, config, view)
    tuples.join(known, list(view.columns), "left_anti").write.mode("append").parquet(config.path("views", view.name))
