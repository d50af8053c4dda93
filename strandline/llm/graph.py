"""Connected components of an undirected graph given as edges (a, b) of integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _toward_least(edges: DataFrame, all_neighbours: bool) -> DataFrame:
    """One star step.  Minima are aggregated before they meet the edges again, so a hub with
    very many neighbours never gathers them in one task."""
    if all_neighbours:
        edges = edges.union(edges.select("b", "a"))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    met = edges.join(least, edges.a == least.k)
    if all_neighbours:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Large-star and small-star steps alternate until every edge is a star edge, in a number of
    rounds logarithmic in the size of a component; each round is cut to the shared folder."""
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        new = written(_toward_least(_toward_least(now, True), False))
        dropped(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        mark = seen
    raise RuntimeError("components did not settle")
