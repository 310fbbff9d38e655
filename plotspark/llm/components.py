"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotspark.llm.small import written


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free sum over the edges, to see when a round changes nothing."""
    digest = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(digest)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked to) for every node of ``links`` (a, b) but the roots themselves.

    Each round only joins and groups by node, with partial minima before the shuffle, so a node with very many links is no group that has
    to fit a task. Rounds grow with the logarithm of a chain's length. Every round is a written table.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges)
    mark = _mark(edges)
    while mark[0]:
        edges = written(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
