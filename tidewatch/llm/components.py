"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations (minimum neighbour of every node, partial before the shuffle) and two
equi-joins, both of which Spark can split where a node has very many neighbours, or to which minima of a small graph are sent; rounds grow
with the logarithm of the graph.  Nothing but counts and small graphs' minima reaches the driver, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.common import discard, few, stored


def _settled(star: DataFrame, n: int) -> bool:
    """Are the n edges stars already: has every v one u, and is no u a v?"""
    ends = star.select(F.col("v").alias("node"), F.lit(1).alias("below")).unionByName(star.select(F.col("u").alias("node"), F.lit(0).alias("below")))
    per = few(ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("top")), n)
    return per.filter("below > 1 OR (below = 1 AND top = 0)").count() == 0


def components(edges: DataFrame, left: str = "u", right: str = "v", rows: int | None = None) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without edges have no row.

    Null ends and loops are ignored; repeated edges are harmless.  rows: the number of edges, if known.
    """
    star = edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct()
    star = stored(star if rows is None else few(star, rows), "components")
    while not _settled(star, n := star.count()):
        small_graph = n <= common.SENT_ROWS
        minima = lambda low: F.broadcast(low) if small_graph else low
        # Large star: every larger neighbour of u is tied to the smallest of u's neighbourhood.
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = few(both.filter("v > u").join(minima(low), "u").select(F.col("m").alias("v"), F.col("v").alias("u")).filter("u <> v").distinct(), n)
        # Small star: every smaller neighbour of u, and u, is tied to the smallest of them.
        low = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(minima(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, star = star, stored(few(small.select(F.col("v").alias("u"), F.col("u").alias("v")), n), "components")
        discard(last)
    return star.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(few(star.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct(), n))
