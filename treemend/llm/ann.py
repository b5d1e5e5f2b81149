"""Approximate nearest neighbours over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then indexed in its leaf.
A query walks the tree best bin first: a priority queue holds the branches
seen so far, the one whose centre has the largest inner product is opened
next, and leaves come out in the order in which they are to be visited. How
many leaves a query visits is calibrated: for a bounded set of rows the true
neighbours are found by brute force, and the visits widen until the wanted
share of them lies in visited leaves. Neighbouring leaves are searched
together, in blocks of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import prepare
from treemend.llm.vectors import best_per_query, blocks_for, stacked, usable, wider
from treemend.session import cut_lineage

# Rows the tree is fitted on at most, drawn by hash.
SAMPLE_ROWS = 32_768
BRANCHES, LEAF_SAMPLE = 8, 24
# Rows whose true neighbours calibrate the visits, drawn by hash.
CALIBRATION_ROWS = 192
RECALL = 0.96
# Rows and queries one task searches at a time.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
SEED = 5


class Tree:
    """Centres per node; children of inner nodes; leaves numbered from left to right, so near leaves have near numbers."""

    def __init__(self, centres: np.ndarray, children: np.ndarray, leaf: np.ndarray):
        self.centres, self.children, self.leaf = centres, children, leaf
        self.leaves = int(leaf.max()) + 1

    @classmethod
    def fit(cls, rows: np.ndarray) -> Tree:
        rng = np.random.default_rng(SEED)
        centres, children, leaf = [rows.mean(0) if len(rows) else np.zeros(rows.shape[1])], [], []
        leaves = 0

        def grow(node: int, part: np.ndarray) -> None:
            nonlocal leaves
            own = list(split(part)) if len(part) > BRANCHES * LEAF_SAMPLE else []
            children.extend([] for _ in range(node + 1 - len(children)))
            leaf.extend(-1 for _ in range(node + 1 - len(leaf)))
            if len(own) < 2:
                leaf[node], leaves = leaves, leaves + 1
                return
            first = len(centres)
            centres.extend(c for c, _ in own)
            children[node] = list(range(first, first + len(own)))
            for k, (_, p) in enumerate(own):
                grow(first + k, p)

        def split(part: np.ndarray):
            x = rows[part]
            c = np.unique(x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)], axis=0)
            for _ in range(8):
                own = nearest(x, c)
                c = np.array([x[own == k].mean(0) for k in range(len(c)) if (own == k).any()])
            own = nearest(x, c)
            for k in range(len(c)):
                if (own == k).any():
                    yield c[k], part[own == k]

        grow(0, np.arange(len(rows)))
        table = np.full((len(centres), BRANCHES), -1, np.int32)
        for node, own in enumerate(children):
            table[node, : len(own)] = own
        return cls(np.array(centres), table, np.array(leaf, np.int32))

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre, level by level."""
        at = np.zeros(len(rows), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                mine = inner[at[inner] == node]
                own = self.children[node][self.children[node] >= 0]
                at[mine] = own[nearest(rows[mine], self.centres[own])]

    def best_bins(self, query: np.ndarray, most: int, counts: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves in best-bin-first order, and further ones until they hold ``need`` rows by ``counts``."""
        value = self.centres @ query
        queue, out, held = [(-value[0], 0)], [], 0
        while queue and (len(out) < most or held < need):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                held += int(counts[out[-1]]) if counts is not None else 0
            for child in self.children[node]:
                if child >= 0:
                    heapq.heappush(queue, (-value[child], int(child)))
        return out

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, c=self.centres, k=self.children, l=self.leaf)
        return out.getvalue()


@functools.lru_cache(maxsize=2)
def unpack(data: bytes) -> Tree:
    z = np.load(io.BytesIO(data))
    return Tree(z["c"], z["k"], z["l"])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T * 2 - (centres * centres).sum(1)).argmax(1)


def best_of(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best rows; products are added component by component, so equal vectors score equally."""
    if len(rough) > k:
        # all that a rounding error of the rough product could put among the k best
        margin = 1e-9 * (1 + np.abs(rough).max())
        keep = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - margin)
        ids, rows = ids[keep], rows[keep]
    score = np.zeros(len(ids))
    for j in range(len(query)):
        score += rows[:, j] * query[j]
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query the k best rows of the block among the leaves it visits (all leaves where it names none)."""
    out: dict[str, list] = {"query_id": [], "_q": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        left = left.sort_values("_leaf", kind="stable", ignore_index=True)
        rows, queries = stacked(list(left["_v"]), np.float64), stacked(list(right["_v"]), np.float64)
        width = max(rows.shape[1], queries.shape[1])
        rows, queries, ids, leaf = wider(rows, width), wider(queries, width), left["vec_id"].to_numpy(), left["_leaf"].to_numpy()
        for at in range(0, len(queries), 256):
            rough = queries[at : at + 256] @ rows.T
            for q, products in enumerate(rough, at):
                mask = ids != right["vec_id"].iat[q]
                visits = right["_leaves"].iat[q]
                if visits is not None:
                    mask &= np.isin(leaf, visits)
                places = np.flatnonzero(mask)
                found, scores = best_of(ids[places], rows[places], queries[q], products[places], k)
                out["query_id"] += [right["vec_id"].iat[q]] * len(found)
                out["_q"] += [right["_q"].iat[q]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
    return pd.DataFrame(out)


_FOUND = "query_id long, _q long, vec_id long, score double"


def search_blocks(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from rows and queries that share a block and a query group."""
    keys = ["_b", "_g"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(functools.partial(_search_k, k=k), _FOUND)
    return best_per_query(found, k)


def _search_k(left, right, k):
    return _search(left, right, k)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each query, by inner product in doubles.

    ``vectors`` are (vec_id, embedding). Vectors that are null, empty, all zero
    or hold null or non-finite components, and rows with a null id, take no
    part. A query never finds rows with its own id. Equal scores go to the
    smaller id. Repeated query rows are queries of their own. Vectors of
    different lengths meet with zeros for what is missing. With fewer than k
    other rows a query finds all of them.
    """
    spark = prepare(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists(v, lambda x: x != 0))
    rows = cut_lineage(rows.select(F.col("vec_id").cast("long"), v.alias("_v"), is_query.alias("_is"), F.monotonically_increasing_id().alias("_q")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_is").alias("q"), F.max(F.size("_v")).alias("d")).first()
    n, width = size["n"], size["d"] or 1
    draw = lambda salt, want: F.pmod(F.xxhash64("_q", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / max(1, n)))
    sample = rows.where(draw(1, SAMPLE_ROWS)).select("_v").limit(2 * SAMPLE_ROWS).toPandas()["_v"]
    tree = Tree.fit(wider(stacked(list(sample), np.float64), width))
    data = spark.sparkContext.broadcast(tree.pack())

    @F.pandas_udf("int")
    def leaf_of(x: pd.Series) -> pd.Series:
        return pd.Series(unpack(data.value).leaf_of(wider(stacked(list(x), np.float64), width)))

    indexed = cut_lineage(rows.withColumn("_leaf", leaf_of("_v")))
    # blocks: whole leaves next to each other up to BLOCK_ROWS; a larger leaf is dealt out to several
    counts = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("_leaf").count().collect():  # as many as leaves: bound by the sample
        counts[r["_leaf"]] = r["count"]
    first, parts, block, filled = [], [], -1, BLOCK_ROWS
    for c in counts.tolist():
        if c > BLOCK_ROWS or filled + c > BLOCK_ROWS:
            block, filled = block + 1 if not parts else first[-1] + parts[-1], 0
        own = blocks_for(c, BLOCK_ROWS)
        first.append(block)
        parts.append(own)
        filled = filled + c if own == 1 else BLOCK_ROWS
    first_of, parts_of = np.array(first, np.int32), np.array(parts, np.int32)
    groups = blocks_for(size["q"], BLOCK_QUERIES)

    @F.pandas_udf("int")
    def block_of(leaf: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(first_of[leaf] + (number.to_numpy() % parts_of[leaf]).astype(np.int32))

    base = indexed.select("vec_id", "_v", "_leaf", block_of("_leaf", F.pmod(F.xxhash64("_q", F.lit(3)), F.lit(1 << 30))).alias("_b"))
    truth_of = rows.where(draw(2, CALIBRATION_ROWS)).limit(2 * CALIBRATION_ROWS)
    visits = calibrate(base, cut_lineage(truth_of), tree, first_of, parts_of, k, recall, width)

    @F.pandas_udf("array<struct<_b: int, _leaves: array<int>>>")
    def plan(x: pd.Series, own: pd.Series) -> pd.Series:
        t, out = unpack(data.value), []
        for q, same in zip(wider(stacked(list(x), np.float64), width), own.tolist()):
            by: dict[int, list[int]] = {}
            # the query's own rows do not count
            for leaf in t.best_bins(q, visits, counts, k + same):
                for b in range(first_of[leaf], first_of[leaf] + parts_of[leaf]):
                    by.setdefault(int(b), []).append(leaf)
            out.append([{"_b": b, "_leaves": leaves} for b, leaves in by.items()])
        return pd.Series(out)

    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_own")).where("_own > 1")
    asked = rows.where("_is").join(repeated, "vec_id", "left").withColumn("_own", F.coalesce("_own", F.lit(1)))
    asked = asked.select("vec_id", "_v", "_q", F.explode(plan("_v", "_own")).alias("_p"), F.pmod(F.xxhash64("_q", F.lit(4)), F.lit(groups)).cast("int").alias("_g"))
    base = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    return search_blocks(base, asked.select("vec_id", "_v", "_q", "_p._b", "_p._leaves", "_g"), k)


def calibrate(base: DataFrame, truth_of: DataFrame, tree: Tree, first_of, parts_of, k: int, recall: float, width: int) -> int:
    """The fewest visits that reach the wanted recall on the calibration rows, whose true neighbours are searched in all blocks."""
    blocks = int((first_of + parts_of).max()) if len(first_of) else 1
    asked = truth_of.select("vec_id", "_v", "_q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.lit(None).cast("array<int>").alias("_leaves"), F.lit(0).alias("_g"))
    truth = search_blocks(base.withColumn("_g", F.lit(0)), asked, k)
    near = truth.join(base.select("vec_id", "_leaf").distinct(), "vec_id").groupBy("query_id").agg(F.collect_list("_leaf").alias("leaves"))
    ranks = []
    for r in near.join(truth_of.select(F.col("vec_id").alias("query_id"), "_v"), "query_id").collect():  # bounded rows of k
        order = {leaf: i for i, leaf in enumerate(tree.best_bins(wider(np.array([r["_v"]]), width)[0], tree.leaves), 1)}
        ranks += [order[x] for x in r["leaves"]]
    return int(np.quantile(ranks, recall, method="higher")) if ranks else tree.leaves
