"""Exact top-k inner products over an impact-ordered index, score at a time.

Components are integers. The index of a shard holds, for each dimension, its
postings (rows) ordered by component, in segments of equal component. A query
walks all segments from the highest contribution down, in levels of
quantised impact, from either end of each list by the sign of its own
component. A row's bound is what it has collected plus, for each dimension
where it has not been met, less than the level's floor. The walk stops once
few rows can still reach the k-th best score, itself a lower bound from exact
scores; those possible members are then scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import prepare
from treemend.llm.vectors import blocks_for, stacked, usable, wider
from treemend.session import cut_lineage

# Rows of an index shard and queries of a block: what one task holds.
SHARD_ROWS = 16384
QUERY_ROWS = 2048
LEVELS = 24
# The walk may stop once this share of a shard is left to be scored exactly.
FEW = 1 / 16
# Scores outside 64 bits are given as the nearest of these; their order is that of the exact scores.
MOST = (1 << 63) - 1


def quantised(v: Column) -> Column:
    """floor(256 x) of every component, each as a double first, as a double: exact, whatever its size."""
    scaled = F.transform(v.cast("array<double>"), lambda x: x * 256)
    return F.transform(scaled, lambda x: F.when(F.abs(x) < 1 << 52, F.floor(x).cast("double")).otherwise(x))


def small_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 64 bits hold inner products of rows of a and b and what the walk computes from them: ``LEVELS`` times their range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return most < 1 << 56


def whole_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as Python integers."""
    q = list(map(int, query.tolist()))
    return np.array([sum(int(x) * y for x, y in zip(r, q) if x and y) for r in rows.tolist()], object)


class ImpactIndex:
    """Postings of one shard: per dimension the rows ordered by component; equal components are a segment.

    Where 64 bits hold all inner products, components and scores are 64-bit
    integers. For the other queries of a shard the walk bounds scores in
    doubles, with their error, on components scaled by a power of two; possible
    members are scored in Python's integers.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.doubles = ids[by_id], rows[by_id]
        self.postings = np.ascontiguousarray(np.argsort(self.doubles, axis=0, kind="stable").T, np.int32)
        ordered = np.ascontiguousarray(np.take_along_axis(self.doubles.T, self.postings, axis=1))
        self.most = float(np.abs(rows).max(initial=0))
        self.scale = _below_one(self.most)
        self.scaled = ordered * self.scale if self.scale != 1 else ordered
        self.whole = self.most < 1 << 62
        self.rows, self.values = (self.doubles.astype(np.int64), ordered.astype(np.int64)) if self.whole else (None, None)
        # the least and the greatest component of each dimension
        self.scaled_ends = self.scaled[:, [0, -1]]
        self.ends = self.values[:, [0, -1]] if self.whole else None

    def search(self, query: np.ndarray, k: int, but: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of every possible member of the top k; exact scores, at least the true top k."""
        n, d = self.doubles.shape
        exact = self.whole and small_enough(query, np.array([self.most]))
        live = np.flatnonzero(query[:d])
        own = np.arange(np.searchsorted(self.ids, but), np.searchsorted(self.ids, but, "right")) if but is not None else np.zeros(0, int)
        few = 2 * k + len(own)
        if not len(live) or n <= 2 * few:
            return self._exact(np.arange(n), query, own, exact)
        shrink = 1.0 if exact else _below_one(float(np.abs(query).max()))
        unit = 1.0 if exact else shrink * self.scale
        q = query[live].astype(np.int64) if exact else query[live] * shrink
        values = self.values if exact else self.scaled
        ends = (self.ends if exact else self.scaled_ends)[live] * q[:, None]
        high, low = ends.max(1), ends.min(1)
        # no proof is possible before about half the range of impacts is walked
        steps = np.arange(LEVELS // 2, LEVELS + 1)
        floors = high.max() - (high.max() - low.min()) * steps // LEVELS if exact else high.max() - (high.max() - low.min()) * (steps / LEVELS)
        below = 1 if exact else 0  # what has not been met offers less than the floor: in whole numbers, by one at least
        slack = 1e-12 * np.abs(ends).max(1).sum()  # of sums in doubles
        # postings with at least a floor's contribution are a run at one end of each list; here are the runs' inner ends
        cut = np.empty((len(live), len(floors) + 1), np.int64)
        for at, j in enumerate(live):
            if q[at] > 0:
                cut[at] = np.r_[n, np.searchsorted(values[j], -(-floors // q[at]) if exact else floors / q[at])]
            else:
                cut[at] = np.r_[0, np.searchsorted(values[j], floors // q[at] if exact else floors / q[at], "right")]
        collected, met, kth = np.zeros(n), np.zeros(n, np.int64), None
        for level, floor in enumerate(floors, 1):
            spans = np.sort(cut[:, level - 1 : level + 1], axis=1)
            parts = [(j, a, b, w) for j, (a, b), w in zip(live, spans.tolist(), q.tolist()) if a < b]
            if parts:
                rows = np.concatenate([self.postings[j, a:b] for j, a, b, _ in parts])
                collected += np.bincount(rows, np.concatenate([values[j, a:b] * w for j, a, b, w in parts]), n)
                met += np.bincount(rows, minlength=n)
            # where a row has not been met, a list still offers at most what it began with, and less than the floor
            open_ = high >= floor
            bound = collected + high[~open_].sum() + (floor - below) * (open_.sum() - met)
            # k rows that look best, scored exactly, bound the k-th score from below
            _, scores = self._exact(np.argpartition(-collected, few)[:few], query, own, exact)
            scores = sorted(scores.tolist(), reverse=True)
            kth = max(scores[k - 1], kth if kth is not None else scores[-1])
            members = np.flatnonzero(bound >= (kth if exact else _scaled(kth, unit)) - slack)
            if len(members) <= max(4 * k, int(n * FEW)):
                break
        return self._exact(members, query, own, exact)

    def _exact(self, places: np.ndarray, query: np.ndarray, own: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        places = np.setdiff1d(places, own, assume_unique=True) if len(own) else places
        d = self.doubles.shape[1]
        return places, self.rows[places] @ query[:d].astype(np.int64) if exact else whole_scores(self.doubles[places], query[:d])


def _below_one(most: float) -> float:
    """1, or the power of two that takes numbers up to ``most`` below 2^400, where neither products nor their sums overflow."""
    return 1.0 if most < 2.0**400 else 2.0 ** (400 - np.frexp(most)[1])


def _scaled(score: int, unit: float) -> float:
    """A score in the walk's unit, a power of two."""
    return score / int(1 / unit) if unit < 1 else float(score)


def search_shard(index: ImpactIndex, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple]:
    """(place of the query, row ids, scores): at most k each, ties to the smaller id."""
    for q in range(len(ids)):
        places, scores = index.search(queries[q], k, ids[q])
        if len(places) > k:
            least = np.partition(scores, -k)[-k] if scores.dtype != object else sorted(scores)[-k]
            keep = scores >= least
            places, scores = places[keep], scores[keep]
        if scores.dtype == object:
            best = np.array(sorted(range(len(places)), key=lambda i: (-scores[i], index.ids[places[i]]))[:k], np.int64)
        else:
            best = np.lexsort((index.ids[places], -scores))[:k]
        yield q, index.ids[places[best]], scores[best]


def beyond(score: int) -> str:
    """Text that sorts scores outside 64 bits, best first; '' for all others."""
    if -MOST <= score <= MOST:
        return ""
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return key if score < 0 else "".join(chr(105 - ord(c)) for c in key)  # 9 for 0, 8 for 1


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query over all shards; lists are cut to k before and after the shuffle."""
    best = F.expr(f"slice(array_sort(collect_list(struct(-score as s, over, vec_id))), 1, {k})")
    return (
        found.groupBy("query_id", "_q").agg(best.alias("_best"))
        .select("query_id", F.posexplode("_best").alias("_i", "_b"))
        .select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), "_b.vec_id", (-F.col("_b.s")).alias("score"))
    )


def top_k(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product of each query.

    ``vectors`` are (vec_id, embedding). Rows whose vector is null, empty or
    holds null or non-finite components, and rows with a null id, take no
    part. A query never finds rows with its own id. Equal scores go to the
    smaller id. Repeated query rows are queries of their own; repeated rows are
    found as often as they are there. Vectors of different lengths meet with
    zeros for what is missing. Components of any finite size count exactly;
    ranks are by exact scores, also where a score is outside 64 bits and
    ``MOST`` stands for it. An empty table, or one without a query, gives no
    rows.
    """
    prepare(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = cut_lineage(rows.select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("_v"), is_query.alias("_is"), F.monotonically_increasing_id().alias("_q")))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_is").alias("q")).first()
    shards, groups = blocks_for(sizes["n"], shard_rows), blocks_for(sizes["q"], query_rows)
    # dealt out by row, not by value: equal vectors and equal ids spread
    mine = F.pmod(F.xxhash64("_q"), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("_q", F.lit(1)), F.lit(groups)).cast("int")
    base = rows.select(mine.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), "vec_id", "_v")
    asked = rows.where("_is").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s"), group.alias("_g"), "vec_id", "_v", "_q")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "_q": [], "vec_id": [], "score": [], "over": []}
        if len(left) and len(right):
            width = max(max(map(len, left["_v"])), max(map(len, right["_v"])))
            index = ImpactIndex(left["vec_id"].to_numpy(), wider(stacked(list(left["_v"]), np.float64), width))
            ids, numbers = right["vec_id"].to_numpy(), right["_q"].to_numpy()
            for q, found, scores in search_shard(index, ids, wider(stacked(list(right["_v"]), np.float64), width), k):
                out["query_id"] += [ids[q]] * len(found)
                out["_q"] += [numbers[q]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [max(-MOST, min(MOST, s)) for s in scores.tolist()]
                out["over"] += map(beyond, scores.tolist())
        return pd.DataFrame(out | {"over": pd.Series(out["over"], dtype=object)})

    found = base.groupBy("_s", "_g").cogroup(asked.groupBy("_s", "_g")).applyInPandas(search, "query_id long, _q long, vec_id long, score long, over string")
    return best_of(found, k)
