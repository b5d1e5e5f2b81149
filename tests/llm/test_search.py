import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from treemend.llm import ann, topk
from treemend.llm.ann import Tree, nearest_neighbours
from treemend.llm.topk import ImpactIndex, search_shard, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def odd_rows(d):
    nan, inf = float("nan"), float("inf")
    return [(900, None), (910, []), (920, [nan] * d), (930, [inf] + [0.1] * (d - 1)), (940, [None] + [0.1] * (d - 1)), (None, [0.5] * d), (950, [0.0] * d)]


def plain(rows, is_query, k, floor, zeros):
    use = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zeros or any(v))]
    part = [np.array([math.floor(256 * x) for x in v]) if floor else np.array(v, float) for _, v in use]
    out = []
    for (i, _), q in zip(use, part):
        if is_query(i):
            scores = [(float(sum(a * b for a, b in zip(q, p))), j) for (j, _), p in zip(use, part) if j != i]
            out += [(i, r, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    v = np.float32(rng.normal(0, 0.2, (n, d)))
    v[n // 2 : n // 2 + n // 6] = v[0]  # one very common vector
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("shard", [16384, 60])
def test_top_k_is_exact(spark, shard):
    rows = vectors(300, 16) + odd_rows(16) + [(960, [0.3, -0.2]), (970, [0.1] * 20)]
    got = sorted(tuple(r) for r in top_k(table(spark, rows), F.col("vec_id") % 10 == 0, 5, shard_rows=shard, query_rows=20).collect())
    assert got == plain(rows, lambda i: i % 10 == 0, 5, True, True)


def test_top_k_of_few_rows(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.1])]
    assert [tuple(r) for r in top_k(table(spark, rows), F.col("vec_id") == 0, 5).collect()] == plain(rows, lambda i: i == 0, 5, True, True)
    assert top_k(table(spark, []), F.col("vec_id") == 0, 5).count() == 0
    assert top_k(table(spark, [(0, [0.1])]), F.col("vec_id") == 0, 5).count() == 0


def test_repeated_rows_and_large_components(spark):
    rows = [(0, [3e9, -1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    got = [tuple(r) for r in top_k(table(spark, rows), F.col("vec_id") == 0, 3).collect()]
    assert [g[2] for g in got] == [2, 2, 3]


@pytest.mark.parametrize("large", [1e6, 1e9, 1e17, 1e36])
@pytest.mark.parametrize("shard", [16384, 70])
def test_components_of_any_size_are_exact(spark, large, shard):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        v = rng.normal(0, 1, 8) * (large if i % 3 == 0 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [0.0] * 8), (203, [float(np.float32(large))] + [0.0] * 7), (204, [float(np.float32(large)), 2**-8] + [0.0] * 6)]
    got = sorted(tuple(r) for r in top_k(table(spark, rows), F.col("vec_id") % 7 == 0, 5, shard_rows=shard, query_rows=9).collect())
    part = [[math.floor(256 * x) for x in v] for _, v in rows]
    want = []
    for (i, _), q in zip(rows, part):
        if i % 7 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, p)), j) for (j, _), p in zip(rows, part) if j != i)[:5]
            want += [(i, r, j, max(-topk.MOST, min(topk.MOST, -s))) for r, (s, j) in enumerate(scores, 1)]
    assert [x for x in zip(got, sorted(want)) if x[0] != x[1]] == [] and len(got) == len(want)


def test_walk_in_doubles_is_exact():
    rng = np.random.default_rng(4)
    for power in (30, 300):
        x = np.floor(rng.normal(0, 1, (400, 12)) * 2.0**power)
        ids = rng.permutation(400)
        index = ImpactIndex(ids, x)
        for q, found, scores in search_shard(index, ids[:10], x[:10], 5):
            exact = [sum(int(a) * int(b) for a, b in zip(r, x[q])) for r in x.tolist()]
            want = sorted((j for j in range(400) if j != q), key=lambda j: (-exact[j], ids[j]))[:5]
            assert found.tolist() == ids[want].tolist() and [int(s) for s in scores] == [exact[j] for j in want]
    assert sorted([-10**30, 3, 10**20, 10**25, -10**19], key=lambda s: (-max(-topk.MOST, min(topk.MOST, s)), topk.beyond(s))) == [10**25, 10**20, 3, -10**19, -10**30]


@pytest.mark.parametrize("kind", ["dense", "sparse", "skewed"])
def test_walk_stops_on_proof_only(kind):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 50, (3000, 24))
    x[rng.random(x.shape) < {"dense": 0, "sparse": 0.9, "skewed": 0.5}[kind]] = 0
    if kind == "skewed":
        x[:, 0] *= 40
    x = np.floor(x).astype(np.int64)
    ids = rng.permutation(3000)
    index = ImpactIndex(ids, x.astype(float))
    scored = []
    exact = index._exact
    index._exact = lambda places, q, own, whole: scored.append(len(places)) or exact(places, q, own, whole)
    for q, found, scores in search_shard(index, ids[:40], x[:40].astype(float), 5):
        s = x @ x[q]
        want = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        assert found.tolist() == ids[want].tolist() and scores.tolist() == s[want].tolist()
    assert np.median(scored) < 300


def test_tree_puts_every_row_in_a_leaf():
    rows = np.random.default_rng(3).normal(0, 1, (2000, 8))
    tree = Tree.fit(rows)
    leaf = tree.leaf_of(rows)
    assert tree.leaves > 8 and leaf.min() >= 0 and len(np.unique(leaf)) == tree.leaves
    assert sorted(tree.best_bins(rows[0], tree.leaves)) == list(range(tree.leaves))
    assert (ann.unpack(tree.pack()).leaf_of(rows) == leaf).all()
    assert Tree.fit(np.zeros((50, 3))).leaves == Tree.fit(np.zeros((0, 3))).leaves == 1


@pytest.mark.parametrize("block", [8192, 100])
def test_neighbours_reach_the_recall(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 30)
    rows = vectors(1200, 12, 7) + odd_rows(12)
    got = sorted(tuple(r) for r in nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    want = plain(rows, lambda i: i % 20 == 0, 20, False, False)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    near = {(w[0], w[2]): w[3] for w in want}
    assert sum((g[0], g[2]) in near for g in got) >= 0.9 * len(want)
    every = {(i, j): s for i, _, j, s in plain(rows, lambda i: i % 20 == 0, len(rows), False, False)}
    for i, rank, j, s in got:
        assert s == pytest.approx(every[i, j], abs=1e-12)
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or (-a[3], a[2]) < (-b[3], b[2])


def test_neighbours_of_few_rows(spark):
    rows = [(0, [0.1, 0.2]), (20, [0.3, 0.1]), (5, [0.3, 0.1]), (6, [1.0])]
    got = sorted(tuple(r) for r in nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    assert [g[:3] for g in got] == [w[:3] for w in plain(rows, lambda i: i % 20 == 0, 20, False, False)]
    assert nearest_neighbours(table(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_a_query_finds_k_rows_whatever_its_leaves_hold(spark, monkeypatch):
    monkeypatch.setattr(ann, "calibrate", lambda *_: 1)
    rows = vectors(1200, 12, 7) + [(5000, [0.9 * (j == 3) for j in range(12)])] * 30
    got = nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, 20).groupBy("query_id").count().collect()
    assert len(got) == 61 and {r["query_id"]: r["count"] for r in got} == {**{i: 20 for i in range(0, 1200, 20)}, 5000: 20 * 30}
    # fewer only where there are fewer
    few = [(0, [0.1, 0.2])] * 3 + [(i, [float(i), -1.0]) for i in range(1, 9)]
    assert {r["count"] for r in nearest_neighbours(table(spark, few), F.col("vec_id") == 0, 20).groupBy("query_id").count().collect()} == {24}


def test_recall_on_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {(r["query_id"], r["vec_id"]) for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20).collect()}
    want = {(w[0], w[2]) for w in plain(rows, lambda i: i % 20 == 0, 20, False, False)}
    assert len(got & want) >= 0.9 * len(want)
    assert topk.LEVELS % 2 == 0
