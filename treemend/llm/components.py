"""Connected components over joins: alternating star operations on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.session import cut_lineage


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation on edges (u, v), u > v.

    Large star: each node's larger neighbours go to the least of itself and
    its neighbours. Small star: each node and its smaller neighbours go to the
    least neighbour. Both keep the components; least values are summed up
    before the shuffle, and a node with very many edges is one row on one side
    of the join, so that its other side can be split.
    """
    if larger:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of a link, the least node it reaches.

    ``links`` are longs (u, v) in any order; loops and repeats are fine. Ends
    when a round of both stars changes nothing; each round is a written table,
    and rounds grow with the logarithm of the largest component.
    """
    edges = cut_lineage(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    # order-free sums: equal when no edge has changed
    digest = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = digest(edges)
    while True:
        edges = cut_lineage(_stars(_stars(edges, True), False))
        now = digest(edges)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = now
