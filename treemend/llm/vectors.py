"""Vectors as rows: which take part, packing, blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, every component there and finite."""
    v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def stacked(rows: list, dtype) -> np.ndarray:
    """Rows of components as a matrix; shorter rows are filled up with zeros."""
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, dtype).reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def wider(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    """query, rank, vec_id, score: the k highest of each query, ties to the smaller id.

    Lists are cut to k before and after the shuffle, so a query is never more
    than k rows per task.
    """
    best = F.expr(f"slice(array_sort(collect_list(struct(-score as s, vec_id))), 1, {k})")
    return (
        found.groupBy("query_id", "_q").agg(best.alias("_best"))
        .select("query_id", F.posexplode("_best").alias("_i", "_b"))
        .select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), "_b.vec_id", (-F.col("_b.s")).alias("score"))
    )
