import glob
import os

import pytest
from pyspark.sql import functions as F

from treemend.functions.docs import attr_number, attributes
from treemend.model import INDEX_COLUMNS, AccessDef, Taxonomy, TypeNode
from treemend.operators import index as X
from treemend.operators.edits import apply_edits
from treemend.operators.store import IndexStore, key_of, path_key
from treemend.session import cut_lineage

ACCESS = {
    "Well": AccessDef("Well", "W", ("ID",), {"ID": "string", "ELEV": "number", "REMARK": "string"}),
    "Pick": AccessDef("Pick", "P", ("ID", "UNIT"), {"ID": "string", "UNIT": "string", "REMARK": "string"}),
}
PICK = TypeNode("Pick", "UNIT", parent_key="ID = [ID]")
TREE = Taxonomy((TypeNode("Well", "ID", children=(PICK,)),))


@pytest.fixture(scope="module")
def idx(spark):
    tables = {
        "W": spark.createDataFrame([(f"w{i:03d}", float(i), "") for i in range(300)], "ID string, ELEV double, REMARK string"),
        "P": spark.createDataFrame([(f"w{i:03d}", f"u{j}", "") for i in range(300) for j in range(i % 4)], "ID string, UNIT string, REMARK string"),
    }
    return cut_lineage(X.build_index(spark, TREE, tables, ACCESS))


@pytest.fixture
def store(spark, idx, tmp_path):
    out = IndexStore(spark, str(tmp_path / "index"))
    out.create(idx, files=8)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(*[c for c in INDEX_COLUMNS]).collect()), key=lambda r: r[0])


def read_files(df):
    return {os.path.basename(r["f"]) for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def edits_of(idx, names):
    return idx.filter(F.col("data_name").isin(names)).select(
        "node_path", F.lit("ELEV").alias("column_name"), F.lit("number").alias("column_type"), F.lit(-5.0).alias("number_value"), F.lit(None).cast("string").alias("text_value"),
        F.lit(None).cast("string").alias("rule_key"),
    )


def test_keys_sort_like_paths(spark):
    paths = [[], [1], [1, 2], [1, 2, 9], [1, 10], [2], [2**31 - 1], [10, 1]]
    df = spark.createDataFrame([(p,) for p in paths], "p array<int>").select("p", path_key(F.col("p")).alias("k"))
    got = {tuple(r["p"]): r["k"] for r in df.collect()}
    assert got == {tuple(p): key_of(p) for p in paths}
    assert sorted(paths) == sorted(paths, key=key_of)


def test_subtrees_are_read_from_few_files(spark, idx, store):
    assert rows(store.read()) == rows(idx)
    path = idx.filter("data_name = 'w003'").first()["node_path"]
    for include in (False, True):
        assert rows(store.subtree(path, include)) == rows(X.descendants(idx, path, include)) != []
    assert rows(store.subtree([])) == rows(X.descendants(idx, []))
    assert rows(store.children(path)) == rows(X.children_of(idx, path))
    assert rows(store.children_with_name(path, "u1")) == rows(X.children_with_name(idx, path, "u1")) != []
    for at in ([], [1], path):
        got = sorted((r["node_path"], r["n_children"]) for r in store.child_counts(at).collect())
        assert got == sorted((r["node_path"], r["n_children"]) for r in X.child_counts(idx, at).collect()) != []
    plan = store.subtree(path)._jdf.queryExecution().toString()
    assert "GreaterThan(path_key," in plan and "LessThan(path_key," in plan
    files = glob.glob(f"{store.path}/base-*/*.parquet")
    assert len(files) > 3 and len(read_files(store.subtree(path))) == 1


def test_an_edit_writes_the_edited_rows(spark, idx, store):
    names = [f"w{i:03d}" for i in range(0, 100, 10)]
    edits = cut_lineage(edits_of(idx, names))
    assert store.edit(edits, "first") and not store.edit(edits, "first")
    layers = glob.glob(f"{store.path}/layer-*")
    assert len(layers) == 1 and spark.read.parquet(layers[0]).count() == 10
    want = rows(apply_edits(idx, edits))
    assert rows(store.read()) == want
    path = idx.filter("data_name = 'w010'").first()["node_path"]
    assert rows(store.subtree(path, True)) == [r for r in want if r[0][: len(path)] == path]
    # a second change of one record: the newest counts
    again = edits_of(idx, ["w010"]).withColumn("number_value", F.lit(7.0))
    store.edit(again)
    want = rows(apply_edits(apply_edits(idx, edits), again))
    assert rows(store.read()) == want
    store.compact()
    assert rows(store.read()) == want and store._parts()[1] == []
    store.clean()
    assert rows(store.read()) == want and store.commits() == {"first"} and len(glob.glob(f"{store.path}/base-*")) == 1


def test_updates_clears_and_inserts_are_layers(spark, idx, store):
    updates = idx.filter("data_name = 'w007'").select("node_path", F.lit('{"ID": "w007"}').alias("doc"), F.array(F.lit("C1")).alias("qc"))
    store.update(updates)
    want = X.apply_updates(idx, updates)
    path = idx.filter("data_name = 'w011'").first()["node_path"]
    store.clear(path)
    want = X.delete_subtree(want, spark.createDataFrame([(path,)], "node_path array<int>"))
    assert rows(store.read()) == rows(want)
    new = [("w000", "u5"), ("w007", "u9"), ("w007", "u8")]
    at = {r["data_name"]: r["node_path"] for r in idx.filter("data_type = 'Well'").collect()}
    inserts = spark.createDataFrame([(at[w], f'{{"ID": "{w}", "UNIT": "{u}", "REMARK": ""}}') for w, u in new], "parent_path array<int>, doc string")
    assert store.insert(inserts, PICK, ACCESS["Pick"], "picks") and not store.insert(inserts, PICK, ACCESS["Pick"], "picks")
    assert rows(store.read()) == rows(X.insert_docs(cut_lineage(want), inserts, PICK, ACCESS["Pick"]))
    # three records and the group node that one parent lacked
    assert spark.read.parquet(f"{store.path}/layer-000003-picks").count() == 4


def test_unfinished_layers_do_not_exist(spark, idx, store):
    store.edit(edits_of(idx, ["w001"]))
    os.remove(glob.glob(f"{store.path}/layer-*/_SUCCESS")[0])
    assert rows(store.read()) == rows(idx)
    store.edit(edits_of(idx, ["w002"]))
    changed = [r for r, o in zip(rows(store.read()), rows(idx)) if r != o]
    assert len(changed) == 1 and changed[0][3] == "w002"
    with pytest.raises(ValueError, match="no index"):
        IndexStore(spark, store.path + "-nowhere").read()


def test_many_paths_are_joined(spark, idx, store, monkeypatch):
    from treemend.operators import store as module

    monkeypatch.setattr(module, "FEW_PATHS", 5)
    monkeypatch.setattr(module, "FEW_RANGES", 2)
    at = {r["data_name"]: r["node_path"] for r in idx.filter("data_type = 'Well'").collect()}
    inserts = spark.createDataFrame([(at[f"w{i:03d}"], f'{{"ID": "w{i:03d}", "UNIT": "u9", "REMARK": ""}}') for i in range(20, 30)], "parent_path array<int>, doc string")
    store.insert(inserts, PICK, ACCESS["Pick"])
    idx = cut_lineage(X.insert_docs(idx, inserts, PICK, ACCESS["Pick"]))
    assert rows(store.read()) == rows(idx)
    edits = cut_lineage(edits_of(idx, [f"w{i:03d}" for i in range(40)]))
    store.edit(edits)
    assert rows(store.read()) == rows(apply_edits(idx, edits))
    a = attributes(F.col("doc"))
    assert store.read().filter(attr_number(a, "ELEV") == -5).count() == 40


def test_batches_are_placed_once(spark, tmp_path):
    from treemend.streaming.ingest import load_into_index

    access = {**ACCESS, "Well": AccessDef("Well", "W", ("ID",), {"ID": "string", "LAT": "number", "LON": "number"})}
    tree = Taxonomy((TypeNode("Well", "ID", "LAT", "LON", children=(PICK,)),))
    wells = [(f"w{i}", 10.0 + i, 20.0) for i in range(9)]
    picks = [(f"w{i}", f"u{j}", f"{i}{j}") for i in range(9) for j in range(i % 3)]
    make = lambda rows, t: spark.createDataFrame(rows, t)
    W, P = "ID string, LAT double, LON double", "ID string, UNIT string, REMARK string"
    store = IndexStore(spark, str(tmp_path / "stream"))
    store.create(X.build_index(spark, tree, {"W": make(wells[:1], W), "P": make([], P)}, access))
    well, pick = load_into_index(store, tree, access, "Well"), load_into_index(store, tree, access, "Pick")
    # the second batch corrects a record of the first; a batch comes again; a key stands in a batch twice
    well(make([(*wells[1][:1], 0.0, 0.0), *wells[2:5]], W), 0)
    well(make([*wells[5:], wells[1], wells[1]], W), 1)
    before = rows(store.read())
    well(make([("w77", 1.0, 1.0)], W), 1)
    assert rows(store.read()) == before
    pick(make(picks[:4], P), 0)
    pick(make([(a, b, "old") if i % 2 else (a, b, c) for i, (a, b, c) in enumerate(picks[4:])], P), 1)
    pick(make(picks[3:], P), 2)
    with pytest.raises(Exception, match="no parent in the index"):
        pick(make([("nowhere", "u1", "")], P), 3)
    whole = X.build_index(spark, tree, {"W": make(wells, W), "P": make(picks, P)}, access)

    def meaning(df):
        got = {tuple(r["node_path"]): r for r in df.collect()}
        return sorted((r["data_type"], r["data_key"] or "", r["doc"] or "", r["latitude"] or 0.0, got[p[:-2]]["data_key"] or "" if len(p) > 1 else "") for p, r in got.items())

    assert meaning(store.read().select(*INDEX_COLUMNS)) == meaning(whole)
    store.compact()
    store.clean()
    well(make([("w78", 1.0, 1.0)], W), 0)
    assert meaning(store.read().select(*INDEX_COLUMNS)) == meaning(whole)


def test_layers_are_read_without_records(spark, idx, store, monkeypatch):
    """Paths and keys of a store with layers come from scans without documents; a batch replaces records unread."""
    from treemend.streaming import ingest

    store.edit(edits_of(idx, ["w001", "w002"]), "one")
    store.edit(edits_of(idx, ["w002", "w003"]), "two")
    assert rows(store.read()) == rows(apply_edits(apply_edits(idx, edits_of(idx, ["w001", "w002"])), edits_of(idx, ["w002", "w003"])))
    narrow = store.read().select("node_path", "data_key")
    narrow.collect()
    plan = narrow._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scanned = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scanned and not any("doc:" in line for line in scanned)

    # records that a batch replaces are not looked up
    monkeypatch.setattr(store, "named", None)
    batch = spark.createDataFrame([("w004", 1.5), ("w004", 0.5), ("w005", None)], "ID string, ELEV double")
    ingest.load_into_index(store, TREE, ACCESS, "Well")(batch, 7)
    got = {r["data_name"]: r["doc"] for r in store.read().filter("data_type = 'Well'").collect()}
    elev = lambda name: '"ELEV":1.5' in got[name]
    assert len(got) == 300 and elev("w004") and not elev("w005")
