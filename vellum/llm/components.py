"""Connected components of an edge table, by alternating large-star and small-star steps over DataFrames.

Every step is a partial aggregation and a join, so a hub with many neighbours is pre-aggregated and its join side can be
split; nothing of the graph comes to the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import cut, discard


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u"), F.least("u", "w").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _least(down)
    return found.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(found.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


#: Edges of a file of the tables between rounds.
FILE_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of any one orderable type, null-free. Returns (node, label) for every node that has an edge; label is
    the least node of its component and appears as a node too. An empty table gives an empty one."""
    count = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = count(edges)
    while True:
        # edges only become fewer, so their number bounds the files that the next round needs
        new = cut(_small_star(_large_star(edges)), "edges", files=8 + mark[0] // FILE_EDGES)
        now = count(new)
        discard(edges)
        edges = new
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
