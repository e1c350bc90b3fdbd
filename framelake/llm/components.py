"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROWS = 500_000  # links a task holds


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` as longs): the root is the smallest node that can be reached.

    Rounds of two steps: each node hangs its larger neighbours, then its smaller ones, on its smallest. They end when the links
    no longer change, after about as many rounds as the longest path has binary digits. Every round is written to the shared
    folder, in as many files as its links need. The smallest neighbours are found by a sum before the shuffle, so a node with
    very many links sends few rows.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        ways = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        lowest = ways.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = ways.join(lowest, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        hung = small.unionByName(lower.select("x", F.col("m").alias("y"))).filter("x <> y").distinct()
        edges = stored(hung.coalesce(-(-now[0] // ROWS)), "links")
    roots = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
