"""The paths for hot groups give what the plain paths give."""

import math
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import treemend.operators.curves as C
import treemend.scale as S
from treemend.functions.arrays import pack_curves
from treemend.operators.curve_rules import spike_samples
from treemend.operators.neighbors import idw, nearest


def test_ordinals_over_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", f"k{i:05d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k string, v int").repartition(5)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    split = S.ordinal_in_group(df, ["g"], ["k"], "n")
    key = lambda d: sorted(map(tuple, d.select("g", "k", "v", "n").collect()))
    assert key(plain) == key(split)
    whole = S.ordinal_in_group(df, [], ["k"], "n")
    assert [r["n"] for r in whole.orderBy("k").select("n").collect()] == list(range(1, 3001))


def test_running_sum_carries_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    df = spark.createDataFrame([("a" if i % 3 else "b", i // 3 * 2 + i % 3 if i % 3 else i // 3, i % 5) for i in range(600)], "s string, p int, v int")
    df = df.dropDuplicates(["s", "p"])
    got = {(r["s"], r["p"]): r["c"] for r in S.running_sum(df, ["s"], "p", "v", "c").collect()}
    want = {}
    for s in ("a", "b"):
        total = 0
        for r in df.filter(F.col("s") == s).orderBy("p").collect():
            total += r["v"]
            want[s, r["p"]] = total
    assert got == want


def test_first_by(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    got = sorted(map(tuple, S.first_by(df, ["k"], F.col("o")).collect()))
    assert got == [("a", 1, "y"), ("b", 3, "z")]
    assert sorted(map(tuple, S.first_by(df, ["k"], F.col("o"), last=True).collect())) == [("a", 2, "x"), ("b", 3, "z")]


def curve(spark, values, name="c"):
    return spark.createDataFrame([(name, i, None if v is None else float(v)) for i, v in enumerate(values)], "s string, p int, v double")


def spikes(spark, values, window, severity):
    out = spike_samples(curve(spark, values), ["s"], "p", "v", window, severity)
    return sorted(r["p"] for r in out.filter("is_spike").collect())


def test_spikes(spark):
    values = [10 + (-1) ** i for i in range(21)]
    values[10] = 100
    assert spikes(spark, values, 5, 2.5) == [10]
    # with eleven samples no value can lie four deviations off
    assert spikes(spark, values, 5, 4.0) == []
    assert spikes(spark, [5.1] * 30, 5, 2.5) == []
    assert spikes(spark, [None] * 10, 5, 1.0) == []
    assert spikes(spark, [1, 100], 5, 0.1) == []


def brute_hat(values, window=25):
    n = len(values)

    def stats(lo, hi):
        part = [v for v in values[max(0, lo):max(0, min(hi, n - 1))] if v is not None]
        mean = sum(part) / len(part) if part else None
        std = math.sqrt(sum((v - mean) ** 2 for v in part) / (len(part) - 1)) if len(part) > 1 else None
        return mean, std

    return [(stats(i - window, i), stats(i - window // 2, i + window // 2), stats(i, i + window)) for i in range(n)]


@pytest.fixture
def long_values():
    rng = random.Random(5)
    values = [10 + rng.random() for _ in range(150)] + [100 + rng.random() for _ in range(150)] + [40 + 5 * rng.random() for _ in range(100)]
    values[33] = None
    return values


def test_hat_stats_in_blocks(spark, long_values):
    for size in (4096, 64):
        S.BLOCK_ROWS, old = size, S.BLOCK_ROWS
        try:
            out = C.hat_stats(curve(spark, long_values), ["s"], "p", "v").orderBy("p").collect()
        finally:
            S.BLOCK_ROWS = old
        for row, want in zip(out, brute_hat(long_values)):
            for name, (mean, std) in zip(("trailing", "centred", "leading"), want):
                for got, value in ((row[f"{name}_avg"], mean), (row[f"{name}_std"], std)):
                    assert (got is None) == (value is None)
                    assert got is None or got == pytest.approx(value, abs=1e-9)


def test_smooth_steps(spark, long_values, monkeypatch):
    stats = brute_hat(long_values)
    ratios = [None if le[1] is None or ce[1] is None else le[1] / ce[1] for _, ce, le in stats]
    known = [r for r in ratios if r is not None]
    mean = sum(known) / len(known)
    limit = mean + 2 * math.sqrt(sum((r - mean) ** 2 for r in known) / (len(known) - 1))
    segment, segments = 0, []
    for r in ratios:
        segment += r is not None and r > limit
        segments.append(segment)
    assert segments[-1] > 0
    want = []
    for i, s in enumerate(segments):
        part = [v for v, t in list(zip(long_values, segments))[:-1] if t == s and v is not None]
        want.append(None if i == len(segments) - 1 else sum(part) / len(part))
    monkeypatch.setattr(S, "BLOCK_ROWS", 64)
    out = C.smooth(curve(spark, long_values), ["s"], "p", "v").orderBy("p").collect()
    assert [r["segment"] for r in out] == segments
    for row, value in zip(out, want):
        assert (row["smoothed"] is None) == (value is None)
        assert value is None or row["smoothed"] == pytest.approx(value)


def test_constant_curve_is_one_segment(spark):
    values = [7.0] * 60 + [9.0] * 60
    out = C.segments(curve(spark, values), ["s"], "p", "v").collect()
    assert {r["segment"] for r in out} == {0}


@pytest.mark.parametrize("outlier", [None, 1e9])
def test_sample_lookup_against_scan(spark, outlier):
    rng = random.Random(3)
    index = sorted(round(rng.uniform(0, 50), 1) for _ in range(200)) + ([outlier] if outlier else [])
    assert len(set(index)) < len(index)
    samples = spark.createDataFrame([("w", i, v) for i, v in enumerate(index)], "u string, pos int, idx double")
    depths = [round(rng.uniform(-2, 52), 1) for _ in range(300)] + [index[-1], index[0], index[57]] + [index[9]] * 50
    picks = spark.createDataFrame([(i, "w" if i % 10 else "x", d) for i, d in enumerate(depths)], "k int, u string, d double")
    got = {r["k"]: r["pos"] for r in C.sample_lookup(picks, samples, ["u"], "d", "idx", "pos").collect()}

    def scan(d):
        for j in range(len(index) - 1):
            if index[j] <= d < index[j + 1]:
                return j
        return len(index) - 1 if d == index[-1] else None

    assert got == {i: scan(d) if i % 10 else None for i, d in enumerate(depths)}


def test_sample_lookup_takes_any_index(spark):
    rng = random.Random(4)
    curves = {
        "falling": [50.0 - i / 2 for i in range(100)], "again": [float(i % 25) for i in range(200)], "zigzag": [round(rng.uniform(0, 50), 1) for _ in range(400)],
        "wide": [x for i in range(150) for x in (25 - i / 10, 25 + i / 10)], "flat": [3.0] * 5, "one": [7.0], "gaps": [1.0, None, 3.0, float("nan"), 5.0, 9.0, 6.0],
    }
    samples = spark.createDataFrame([(u, i, v) for u, c in curves.items() for i, v in enumerate(c)], "u string, pos int, idx double").repartition(5)
    asks = [(u, d) for u, c in curves.items() for d in [round(rng.uniform(-2, 52), 1) for _ in range(150)] + [x for x in c[-3:] if x == x]] + [("zigzag", None), ("none", 1.0), (None, 1.0)]
    picks = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(asks)], "k int, u string, d double")
    got = {r["k"]: r["pos"] for r in C.sample_lookup(picks, samples, ["u"], "d", "idx", "pos").collect()}

    def walk(c, d):
        if d is None or not c:
            return None
        for j in range(len(c) - 1):
            if c[j] is not None and c[j + 1] is not None and c[j] <= d < c[j + 1]:
                return j
        return len(c) - 1 if d == c[-1] else None

    assert got == {i: walk(curves.get(u, []), d) for i, (u, d) in enumerate(asks)}


def test_packed_curves_with_dense_and_missing_indexes(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([0.0, 1e-9, 1e9, 3.5, None]), float(i)) for i in range(300)]
    out = pack_curves(spark.createDataFrame(rows, "u string, INDEX_VALUE double, MEASURED_VALUE double"), ["u"]).first()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
    assert [float(v) for v in out["MEASURED_VALUE"].split(", ")] == [r[2] for r in want]


def brute_nearest(targets, candidates, k):
    def dist(a, b):
        la, lo, lb, lp = map(math.radians, (a[2], a[3], b[2], b[3]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(min(h, 1)))

    out = {}
    for t in targets:
        near = sorted((round(dist(t, c), 6), c[0]) for c in candidates if c[1] == t[1] and c[0] != t[0])
        out[t[0]] = [c for _, c in near[:k]]
    return out


@pytest.mark.parametrize("shape", ["spread", "hot spot", "cluster", "date line", "few"])
def test_nearest_against_all_pairs(spark, shape):
    rng = random.Random(11)
    n = 15 if shape == "few" else 1200
    rows = []
    for i in range(n):
        lat, lon = rng.uniform(-60, 60), rng.uniform(-170, 170)
        if shape == "hot spot" and i % 3 == 0:
            lat, lon = 10.0, 20.0
        if shape == "cluster" and i % 3 == 0:
            lat, lon = 10 + rng.random() * 1e-4, 20 + rng.random() * 1e-4
        if shape == "date line":
            lon = rng.choice([rng.uniform(178, 180), rng.uniform(-180, -178)])
        rows.append((i, "a" if i % 4 else "b", lat, lon))
    targets = [r for r in rows if r[0] % 9 == 0]
    candidates = [r for r in rows if r[0] % 9 != 0 or r[0] % 2 == 0]
    schema = "grp string, lat double, lon double"
    got = nearest(
        spark.createDataFrame(targets, "tid int, " + schema), spark.createDataFrame(candidates, "cid int, " + schema), k=24, leaf=8
    )
    found = {}
    for r in got.orderBy("tid", "rank").collect():
        found.setdefault(r["tid"], []).append(r["cid"])
    assert found == {t: c for t, c in brute_nearest(targets, candidates, 24).items() if c}


def test_targets_on_one_spot_are_sought_once(spark, monkeypatch):
    from treemend.operators import neighbors

    rng = random.Random(12)
    rows = [(i, "a", 10.0, 20.0) if i % 2 else (i, "a", rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(400)]
    targets = [r for r in rows if r[0] % 20 in (1, 3, 4)]
    searches, prune = [], neighbors._prune

    def counted(frontier, k, metric):
        searches.append(frontier.select("tid").distinct().count())
        return prune(frontier, k, metric)

    monkeypatch.setattr(neighbors, "_prune", counted)
    schema = "grp string, lat double, lon double"
    frames = spark.createDataFrame(targets + targets[:1], "tid int, " + schema), spark.createDataFrame(rows, "cid int, " + schema)
    found = {}
    for r in nearest(*frames, k=24, leaf=8).orderBy("tid", "rank").collect():
        found.setdefault(r["tid"], []).append(r["cid"])
    want = brute_nearest(targets, rows, 24)
    # a row that is given twice finds its neighbours twice, and still 24 in all
    want[targets[0][0]] = [c for c in want[targets[0][0]][:12] for _ in "ab"]
    assert found == want
    assert max(searches) == len({r[2:] for r in targets}) < len(targets)


def near(spark, rows):
    return spark.createDataFrame([(1, i, *r, i + 1) for i, r in enumerate(rows)], "tid int, cid int, n_lat double, n_lon double, distance double, depth double, rank int")


def test_idw(spark):
    two = [(1.0, 1.0, 10.0, 5.0), (2.0, 2.0, 20.0, 6.0)]
    assert idw(near(spark, two)).count() == 0
    three = two + [(3.0, 3.0, 40.0, 7.0)]
    weights = [1 / d**4 for d in (10, 20, 40)]
    want = sum(w * z for w, z in zip(weights, (5, 6, 7))) / sum(weights)
    assert idw(near(spark, three)).first()["value"] == pytest.approx(want)
    # at no distance, a twin of the row before, without depth, without location: none counts
    noise = [(0.5, 0.5, 0.0, 1.0)] + three + [(3.00005, 3.0, 41.0, 9.0), (4.0, 4.0, 50.0, -99999.0), (5.0, 5.0, 60.0, None), (-99999.0, -99999.0, 70.0, 1.0)]
    row = idw(near(spark, noise)).first()
    assert row["n_used"] == 3 and row["value"] == pytest.approx(want)


def test_partitioned_writes_do_not_sort(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from treemend.operators.index import load_projects, save_projects
    from treemend.model import INDEX_SCHEMA
    from treemend.session import cut_lineage

    keys = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.optimizer.plannedWrite.enabled")
    before, seen, parquet = [spark.conf.get(k) for k in keys], [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: seen.append([spark.conf.get(k) for k in keys]) or parquet(self, path, *a, **b))
    # more folders than a task writes at once, one of them null
    rows = spark.range(0, 400, 1, 2).selectExpr("nullif(concat('t', id % 40), 't7') AS kind", "id")
    assert sorted(cut_lineage(rows, "kind").collect(), key=str) == sorted(rows.collect(), key=str)
    idx = spark.createDataFrame([([1, i], 2, [1], f"n{i}", f"t{i % 3}", f"k{i}", "{}", None, None, [], p) for i in range(60) for p in ("", "007")], INDEX_SCHEMA)
    with tempfile.TemporaryDirectory() as folder:
        save_projects(idx, folder)
        assert sorted(load_projects(spark, folder).collect(), key=str) == sorted(idx.collect(), key=str)
    assert seen and all(int(n) > 0 and planned == "false" for n, planned in seen)
    assert [spark.conf.get(k) for k in keys] == before


def test_lithology_parses_records_once(spark):
    from treemend.operators.repair import lithology_values

    log = '{"UWI": "w", "NULL_REPRESENTATION": -999.25, "INDEX_VALUE": "0.0, 1.0, 2.0", "MEASURED_VALUE": "5.0, 40.0, 90.0"}'
    pick = '{"UWI": "%s", "PICK_DEPTH": %s}'
    rows = [([1, 1], "Log", "GR", log), ([1, 2], "MarkerPick", "a", pick % ("w", 0.5)), ([1, 3], "MarkerPick", "b", pick % ("w", 9)), ([1, 4], "MarkerPick", "c", pick % ("x", 1)), ([1, 5], "MarkerPick", "d", pick % ("w", -99999))]
    idx = spark.createDataFrame(rows, "node_path array<int>, data_type string, data_name string, doc string")
    out = lithology_values(idx, idx.filter("data_type = 'MarkerPick'"))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["node_path"][1]: r["rock"] for r in out.collect()}
    assert sorted(got) == [2, 3] and got[3].upper() == "UNKNOWN" != got[2].upper()
