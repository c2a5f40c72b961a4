"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): each step is a grouped minimum (with
partial sums before the shuffle, so a hub is one row per task) and an
equi-join with it (which adaptive execution splits where a hub is large).
After each round the edges are written to the shared folder and lineage ends
there.  Neither edges nor components reach the driver: it sees one truth value
a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") > F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours are smaller here: all point at the least of them."""
    least = _least(edges)
    out = edges.join(least, "u")
    moved = out.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    met = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return met.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node reached.

    Loops, repeated edges and either direction are allowed; rows with a null
    end are left out; no edges give an empty table.
    """
    x, y = F.col(a), F.col(b)
    e = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while not _all_stars(e):
        e = cut(_small_star(_large_star(e)))
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
