"""Connected components of an edge table, by alternating star steps.

Each round makes every node point to its smallest neighbour, twice; the number
of rounds grows with the logarithm of the longest chain.  Nothing is collected:
edges stay a table, written between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    # every edge points from the greater to the smaller node; one row for each
    # edge at most, repeated ones go with the small star
    back = edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.select(*by, "a", "b").unionByName(back).groupBy(*by, "a").agg(F.min("b").alias("m"))
    least = least.select(*by, "a", F.least("a", "m").alias("m"))
    return back.join(least, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    # every edge points from the greater to the smaller node
    least = edges.groupBy(*by, "a").agg(F.min("b").alias("m"))
    rest = edges.join(least, [*by, "a"]).where("b <> m").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame, *by: str) -> DataFrame:
    """(*by, node, root) for every node of an edge, from columns a and b
    (long); the root is the smallest node of the component.  Columns ``by``
    name separate graphs, whose rounds run together."""
    by = list(by)
    edges = edges.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a round reads its edges several times; what made them runs, and is planned, once
    edges = stored(edges, "component-edges")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges, by), by), "component-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*by, "a", "b") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    roots = edges.select(*by, F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(*by, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
