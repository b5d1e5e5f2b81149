import pytest
from pyspark.sql import functions as F

from treemend.functions.docs import attr_number, attr_text, attributes
from treemend.model import AccessDef, Rule, Taxonomy, TypeNode
from treemend.operators import index as X
from treemend.operators.edits import apply_edits, insert_children
from treemend.operators.merge import merge_duplicates
from treemend.operators.repair import Context, mark_repaired
from treemend.operators.reports import failure_counts
from treemend.plans.predictions import prediction_order, run_predictions
from treemend.plans.qc import close_qc, flag_index, run_qc
from treemend.session import cut_lineage
from treemend.standard import ACCESS as STANDARD_ACCESS
from treemend.standard import WELL_TREE, rules

ACCESS = {
    "Well": AccessDef("Well", "W", ("ID",), {"ID": "string", "LAT": "number", "LON": "number", "ELEV": "number", "REMARK": "string"}),
    "Pick": AccessDef("Pick", "P", ("ID", "UNIT"), {"ID": "string", "UNIT": "string", "DEPTH": "number", "REMARK": "string"}, constants={"REMARK": "new"}),
    "Note": AccessDef("Note", "N", ("ID", "TXT"), {"ID": "string", "TXT": "string"}),
    "Core": AccessDef("Core", "C", ("ID", "UNIT", "NO"), {"ID": "string", "UNIT": "string", "NO": "string"}),
}
CORE = TypeNode("Core", "NO", parent_key="ID = [ID], UNIT = [UNIT]")
PICK = TypeNode("Pick", "UNIT", parent_key="ID = [ID]", use_parent_location=True, children=(CORE,))
TREE = Taxonomy((TypeNode("Well", "ID", "LAT", "LON", children=(TypeNode("Note", "TXT", parent_key="ID = [ID]"), PICK)),))


@pytest.fixture(scope="module")
def tables(spark):
    wells = [(f"w{i:02d}", 10.0 + i, 20.0, float(i), "") for i in range(12)]
    picks = [("w00", f"u{i:02d}", float(i), "") for i in range(12)] + [("w01", "u00", -99999.0, "")]
    return {
        "W": spark.createDataFrame(wells, "ID string, LAT double, LON double, ELEV double, REMARK string"),
        "P": spark.createDataFrame(picks, "ID string, UNIT string, DEPTH double, REMARK string"),
        "N": spark.createDataFrame([("w01", "hello")], "ID string, TXT string"),
        "C": spark.createDataFrame([("w00", "u01", "c1"), ("w00", "u01", "c2")], "ID string, UNIT string, NO string"),
    }


@pytest.fixture(scope="module")
def idx(spark, tables):
    return cut_lineage(X.build_index(spark, TREE, tables, ACCESS))


def paths(df):
    return sorted(r["p"] for r in df.select(X.path_text(F.col("node_path")).alias("p")).collect())


def test_shape(idx):
    rows = {r["p"]: r for r in idx.select(X.path_text(F.col("node_path")).alias("p"), "*").collect()}
    assert rows["/"]["data_type"] == "QCPROJECT" and rows["/1/"]["data_name"] == "Wells"
    # twelve children keep numeric order
    assert rows["/1/1/1/10/"]["data_name"] == "u09" and rows["/1/1/1/2/"]["data_name"] == "u01"
    # an empty child type takes no ordinal
    assert rows["/1/1/1/"]["data_type"] == "Picks" and rows["/1/2/1/"]["data_type"] == "Notes" and rows["/1/2/2/"]["data_type"] == "Picks"
    assert rows["/1/1/1/2/1/2/"]["data_name"] == "c2"
    assert rows["/1/1/1/2/"]["data_key"] == "ID = 'w00' AND UNIT = 'u01'"
    assert (rows["/1/1/1/2/"]["latitude"], rows["/1/1/1/2/1/2/"]["latitude"]) == (10.0, None)
    assert len(rows) == 1 + 1 + 12 + 2 + 13 + 1 + 1 + 1 + 2


def test_where_keeps_only_matching_branches(spark, tables):
    out = X.build_index(spark, TREE, tables, ACCESS, where="ID = 'w01'")
    assert paths(out) == ["/", "/1/", "/1/1/", "/1/1/1/", "/1/1/1/1/", "/1/1/2/", "/1/1/2/1/"]
    assert paths(X.build_index(spark, TREE, tables, ACCESS, where="ID = 'none'")) == ["/"]


def test_siblings_are_numbered_within_their_group(spark):
    """Two parents of one key: each has all the children, numbered from 1."""
    tables = {
        "W": spark.createDataFrame([("a", 1.0, 1.0, 1.0, "x"), ("a", 2.0, 2.0, 2.0, "y")], "ID string, LAT double, LON double, ELEV double, REMARK string"),
        "P": spark.createDataFrame([("a", f"u{i}", 1.0, "") for i in range(3)], "ID string, UNIT string, DEPTH double, REMARK string"),
        "N": spark.createDataFrame([], "ID string, TXT string"), "C": spark.createDataFrame([], "ID string, UNIT string, NO string"),
    }
    out = X.build_index(spark, TREE, tables, ACCESS).filter("data_type = 'Pick'")
    assert sorted(r["node_path"][-1] for r in out.collect()) == [1, 1, 2, 2, 3, 3]
    assert out.select("node_path").distinct().count() == 6


def test_reading(idx):
    assert paths(X.descendants(idx, [1, 1, 1, 2])) == ["/1/1/1/2/1/", "/1/1/1/2/1/1/", "/1/1/1/2/1/2/"]
    assert len(paths(X.descendants(idx, [1, 1, 1, 2], include_self=True))) == 4
    assert X.descendants(idx, []).count() == idx.count() - 1
    counts = {r["data_name"]: r["n_children"] for r in X.child_counts(idx, [1]).collect()}
    assert counts["w00"] == 1 and counts["w01"] == 2 and counts["w05"] == 0
    sizes = {r["data_name"]: r["n_descendants"] for r in X.descendant_counts(idx, 2).collect()}
    # the subtrees of a level and the levels above make up the whole tree
    assert sum(sizes.values()) + 12 + 2 == idx.count()
    assert paths(X.by_ids(idx, "/1/2/;/;")) == ["/", "/1/2/"]
    assert paths(X.search_index(idx, data_name="u00", data_type="Pick")) == ["/1/1/1/1/", "/1/2/2/1/"]
    assert paths(X.entirety_parents(idx, "Pick", "u00", "Well", 2)) == ["/1/1/", "/1/2/"]


C1 = Rule("C1", "Pick", "Completeness", "Completeness", "DEPTH")
C10 = Rule("C10", "Well", "Completeness", "Completeness", "ELEV")
E1 = Rule("E1", "Well", "Entirety", "Entirety", "ID", '{"DataType": "Pick", "Name": "u00"}')


def test_qc_is_idempotent_and_ordered(idx):
    rules = [E1, C1, C10]
    once = cut_lineage(close_qc(idx, run_qc(idx, rules, TREE, ACCESS)))
    twice = close_qc(once, run_qc(once, rules, TREE, ACCESS))
    fused = flag_index(once, rules, TREE, ACCESS)
    key = lambda d: sorted((str(r["node_path"]), tuple(r["qc"])) for r in d.collect())
    assert key(once) == key(twice) == key(fused)
    counts = {r["rule_key"]: r["n_failed"] for r in failure_counts(once, rules).collect()}
    assert counts == {"E1": 10, "C1": 1, "C10": 0}
    with pytest.raises(ValueError, match="not allowed"):
        run_qc(idx, [Rule("P1", "Well", "DeleteDataObject", "Predictions")])
    inactive = Rule("C1", "Pick", "Completeness", "Completeness", "DEPTH", active=False)
    assert run_qc(idx, [inactive]).isEmpty() and run_qc(idx, [inactive], active_only=False).count() == 1


def test_insert_delete_update(idx):
    parents = idx.filter(F.col("data_name").isin("w00", "w05")).select("node_path")
    docs = parents.select(F.col("node_path").alias("parent_path"), F.lit('{"ID":"q","UNIT":"new"}').alias("doc"))
    out = X.insert_docs(idx, docs, PICK, ACCESS["Pick"])
    assert set(paths(out)) - set(paths(idx)) == {"/1/1/1/13/", "/1/6/1/", "/1/6/1/1/"}
    gone = X.delete_subtree(idx, idx.filter("data_name = 'w00'"), 2)
    live = lambda d: d.filter(X.has_doc()).count()
    assert live(idx) - live(gone) == 1 + 12 + 2 and gone.count() == idx.count()
    upd = parents.select("node_path", F.lit("{}").alias("doc"), F.array(F.lit("X")).alias("qc"))
    assert X.search_index(X.apply_updates(idx, upd), flag="X").count() == 2


def test_marking_touches_the_exact_flag(idx):
    flagged = idx.withColumn("qc", F.array(F.lit("C1"), F.lit("C10")))
    rule = Rule("P1", "Well", "PredictDepthUsingIDW", "Predictions", fail_rule="C1")
    out = mark_repaired(flagged, rule, flagged.filter("data_name = 'w00'"))
    assert {tuple(r["qc"]) for r in out.filter("data_name = 'w00'").collect()} == {("P1", "C10")}
    assert X.search_index(out, flag="C1").count() == idx.count() - 1


def test_predictions_run_in_order(idx):
    rules = [
        Rule("P2", "Pick", "DeleteDataObject", "Predictions", fail_rule="C1", order=5),
        Rule("P1", "Well", "PredictMissingDataObjects", "Predictions", "ID",
             '{"DataType": "Pick", "Keys": [{"Key": "ID", "Value": "!ID"}, {"Key": "UNIT", "Value": "u00"}], "Defaults": [{"Default": "REMARK", "Value": "d"}]}',
             fail_rule="E1", order=1),
        Rule("P3", "Pick", "DeleteDataObject", "Predictions", fail_rule="C1", order=2, active=False),
    ]
    assert [r.key for r in prediction_order(rules)] == ["P1", "P2"]
    flagged = cut_lineage(flag_index(idx, [C1, E1], TREE, ACCESS))
    out, corrected = run_predictions(flagged, rules, Context(TREE, ACCESS, "2024-01-01"))
    assert not X.search_index(out, flag="E1").count() and not X.search_index(out, flag="C1").count()
    done = {r["rule_key"]: r["count"] for r in corrected.groupBy("rule_key").count().collect()}
    assert done == {"P1": 10, "P2": 1}
    a = attributes(F.col("doc"))
    made = out.filter((F.col("data_type") == "Pick") & (attr_text(a, "REMARK") == "d"))
    assert made.count() == 10 and made.filter(attr_number(a, "DEPTH") == -99999).count() == 10


def test_edits(idx):
    flagged = cut_lineage(flag_index(idx, [C1, E1], TREE, ACCESS))
    pick = X.search_index(flagged, flag="C1").select(
        "node_path", F.lit("DEPTH").alias("column_name"), F.lit("number").alias("column_type"), F.lit(7.5).alias("number_value"),
        F.lit(None).cast("string").alias("text_value"), F.lit("C1").alias("rule_key"),
    )
    row = apply_edits(flagged, pick).filter("data_name = 'u00' and level = 4").orderBy("node_path").collect()[1]
    assert '"DEPTH":7.5' in row["doc"] and ";DEPTH has been manually edited;" in row["doc"] and row["qc"] == []
    bad = pick.withColumn("column_type", F.lit("blob"))
    with pytest.raises(Exception, match="not supported"):
        apply_edits(flagged, bad).collect()
    out = insert_children(flagged, flagged.filter("data_name = 'w05'"), E1, TREE, ACCESS["Pick"], "2024-01-01")
    assert X.search_index(out, data_key="ID = 'w05' AND UNIT = 'u00'").count() == 1
    assert X.search_index(out, flag="E1").count() == 9


def test_several_edits_of_one_record(idx):
    flagged = idx.withColumn("qc", F.array(F.lit("C1"), F.lit("V1"), F.lit("C10")))
    at = flagged.filter("data_name = 'w00' AND data_type = 'Well'").select("node_path")
    edit = lambda no, column, number, text, key: at.select(
        "node_path", F.lit(no).alias("edit_no"), F.lit(column).alias("column_name"), F.lit("text" if text else "number").alias("column_type"),
        F.lit(number).cast("double").alias("number_value"), F.lit(text).cast("string").alias("text_value"), F.lit(key).cast("string").alias("rule_key"),
    )
    edits = edit(2, "ELEV", 9.0, None, "C1").unionByName(edit(1, "ELEV", 8.0, None, "V1")).unionByName(edit(3, "NEW", None, "x", None))
    out = apply_edits(flagged, edits)
    assert out.count() == flagged.count()
    row = out.filter("data_name = 'w00' AND data_type = 'Well'").collect()
    assert len(row) == 1 and row[0]["qc"] == ["C10"] and '"ELEV":9' in row[0]["doc"] and '"NEW":"x"' in row[0]["doc"]
    assert row[0]["doc"].count("manually edited") == 3


def test_updates_of_one_node_must_be_one(idx):
    twice = idx.filter("data_name = 'w00'").select("node_path", F.lit("{}").alias("doc"), F.array(F.lit("X")).alias("qc"))
    with pytest.raises(ValueError, match="repeated"):
        X.apply_updates(idx, twice.unionByName(twice))


def test_deletes_on_any_level(idx):
    well = idx.filter("data_type = 'Well' AND data_name = 'w01'").select("node_path").first()["node_path"]
    pick = idx.filter((F.col("data_type") == "Pick") & (F.slice("node_path", 1, 2) != F.array(*map(F.lit, well)))).orderBy("node_path").first()["node_path"]
    ids = idx.filter(F.col("node_path").isin(F.array(*map(F.lit, well)), F.array(*map(F.lit, pick)))).select("node_path")
    before, after = ({tuple(r["node_path"]) for r in d.filter(X.has_doc()).collect()} for d in (idx, X.delete_subtree(idx, ids)))
    assert before - after == {p for p in before if p[: len(well)] == tuple(well) or p[: len(pick)] == tuple(pick)} and len(before - after) > 1


def test_inserts_below_nothing_fail(spark, idx):
    docs = spark.createDataFrame([([1, 999], '{"ID": "q", "UNIT": "u"}')], "parent_path array<int>, doc string")
    with pytest.raises(Exception, match="no such parent"):
        X.insert_docs(idx, docs, PICK, ACCESS["Pick"]).collect()


def test_stored_projects(spark, idx, tmp_path):
    path = str(tmp_path / "store")
    X.save_projects(idx.unionByName(X.copy_project(idx, "007")), path)
    X.save_projects(X.copy_project(idx, "a/b=c"), path)
    n = idx.count()
    stored = X.load_projects(spark, path)
    assert stored.columns == idx.columns
    assert {r["project"]: r["n_nodes"] for r in X.list_projects(stored).collect()} == {"": n, "007": n, "a/b=c": n}
    assert X.drop_project(stored, "007").count() == 2 * n and X.load_projects(spark, path, "").count() == n
    assert X.drop_stored_project(spark, path, "007") and not X.drop_stored_project(spark, path, "none")
    assert {r["project"] for r in X.list_projects(X.load_projects(spark, path)).collect()} == {"", "a/b=c"}


def test_merge_moves_whole_subtrees(spark):
    one, two, three = (AccessDef(t, t, k, {c: "string" for c in (*k, "NAME")}) for t, k in (("A", ("A",)), ("B", ("A", "B")), ("C", ("A", "B", "C"))))
    tree = Taxonomy((TypeNode("A", "A", children=(TypeNode("B", "B", parent_key="A = [A]", children=(TypeNode("C", "C", parent_key="A = [A], B = [B]"),)),)),))
    tables = {
        "A": spark.createDataFrame([("a1", "x"), ("a2", "x"), ("a3", "y")], "A string, NAME string"),
        "B": spark.createDataFrame([("a1", "b1", ""), ("a2", "b1", ""), ("a2", "b2", ""), ("a3", "b9", "")], "A string, B string, NAME string"),
        "C": spark.createDataFrame([("a2", "b2", "c1", ""), ("a2", "b2", "c2", ""), ("a1", "b1", "c0", ""), ("a2", "b1", "c9", "")], "A string, B string, C string, NAME string"),
    }
    access = {"A": one, "B": two, "C": three}
    rule = Rule("U1", "A", "Uniqueness", "Uniqueness", "NAME", "NAME")
    flagged = cut_lineage(flag_index(X.build_index(spark, tree, tables, access), [rule], tree, access))
    out = merge_duplicates(flagged, flagged.filter("data_name = 'a1'"), rule, tree, access)
    live = {X_["data_key"]: X_["node_path"] for X_ in out.filter(X.has_doc() & F.col("data_type").isin("A", "B", "C")).collect()}
    key = lambda **k: " AND ".join(f"{n} = '{v}'" for n, v in k.items())
    assert set(live) == {
        key(A="a1"), key(A="a3"), key(A="a1", B="b1"), key(A="a3", B="b9"), key(A="a1", B="b2"), key(A="a1", B="b1", C="c0"),
        key(A="a1", B="b2", C="c1"), key(A="a1", B="b2", C="c2"), key(A="a1", B="b1", C="c9"),
    }
    assert live[key(A="a1", B="b2", C="c1")][:-2] == live[key(A="a1", B="b2")] and live[key(A="a1", B="b2")][:-2] == live[key(A="a1")]


def test_merge_duplicates(spark):
    wells = spark.createDataFrame(
        [("a", 1.0, 1.0, 1.0, "x-1"), ("b", 1.0, 1.0, 1.0, "x1"), ("c", 1.0, 1.0, 1.0, "X 1"), ("d", 1.0, 1.0, 1.0, "y")],
        "ID string, LAT double, LON double, ELEV double, REMARK string",
    )
    picks = spark.createDataFrame(
        [("a", "u1", 1.0, ""), ("b", "u1", 2.0, ""), ("b", "u2", 3.0, ""), ("c", "u2", 4.0, ""), ("c", "u3", 5.0, "")],
        "ID string, UNIT string, DEPTH double, REMARK string",
    )
    none = spark.createDataFrame([], "ID string, TXT string")
    cores = spark.createDataFrame([], "ID string, UNIT string, NO string")
    idx = X.build_index(spark, TREE, {"W": wells, "P": picks, "N": none, "C": cores}, ACCESS)
    rule = Rule("U1", "Well", "Uniqueness", "Uniqueness", "REMARK", "*NORMALIZE(REMARK)")
    flagged = cut_lineage(flag_index(idx, [rule], TREE, ACCESS))
    out = merge_duplicates(flagged, flagged.filter("data_name = 'a'"), rule, TREE, ACCESS)
    a = attributes(F.col("doc"))
    live = out.filter(X.has_doc() & F.col("data_type").isin("Well", "Pick"))
    got = sorted((r["data_type"], r["id"], r["data_name"]) for r in live.select("data_type", attr_text(a, "ID").alias("id"), "data_name").collect())
    # u2 is on both twins: one copy
    assert got == [("Pick", "a", "u1"), ("Pick", "a", "u2"), ("Pick", "a", "u3"), ("Well", "a", "a"), ("Well", "d", "d")]
    assert X.search_index(out, flag="U1").count() == 0


def test_merge_writes_records_once(spark, monkeypatch):
    """Only the table of the merge's region holds documents and only rows of the rule's type meet its failures, however the joins run."""
    from treemend.operators import merge

    tables = {
        "W": spark.createDataFrame([("a", 1.0, 1.0, 1.0, "x"), ("b", 1.0, 1.0, 1.0, "x")], "ID string, LAT double, LON double, ELEV double, REMARK string"),
        "P": spark.createDataFrame([("a", "u1", 1.0, ""), ("b", "u1", 2.0, ""), ("b", "u2", 3.0, "")], "ID string, UNIT string, DEPTH double, REMARK string"),
        "N": spark.createDataFrame([], "ID string, TXT string"),
        "C": spark.createDataFrame([("b", "u1", "c1"), ("b", "u2", "c2")], "ID string, UNIT string, NO string"),
    }
    rule = Rule("U1", "Well", "Uniqueness", "Uniqueness", "REMARK", "REMARK")
    flagged = cut_lineage(flag_index(cut_lineage(X.build_index(spark, TREE, tables, ACCESS)), [rule], TREE, ACCESS))
    written = []
    monkeypatch.setattr(merge, "cut_lineage", lambda df, *a: written.append(df.columns) or cut_lineage(df, *a))
    out = merge_duplicates(flagged, flagged.filter("data_name = 'a'"), rule, TREE, ACCESS)
    live = {r["data_key"] for r in out.filter(X.has_doc() & F.col("data_type").isin("Well", "Pick", "Core")).collect()}
    key = lambda **k: " AND ".join(f"{n} = '{v}'" for n, v in k.items())
    cores = {key(ID="a", UNIT="u1", NO="c1"), key(ID="a", UNIT="u2", NO="c2")}
    assert live == {key(ID="a"), key(ID="a", UNIT="u1"), key(ID="a", UNIT="u2"), *cores}
    assert len([c for c in written if "doc" in c]) == 1


def merged_by_hand(records, survivors):
    """{root: members} and records as (path of names, payload): trees of one root folded into the survivor's, name by name."""
    out = {}
    for path, payload, order in sorted(records, key=lambda r: (r[0][0] != survivors.get(r[0][0], r[0][0]), r[2])):
        home = (survivors.get(path[0], path[0]), *path[1:])
        out.setdefault(home, payload)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_keeps_every_name_on_every_level(spark, seed):
    import random

    rng = random.Random(seed)
    kinds = ("A", "B", "X", "C", "D")
    keys = {"A": ("A",), "B": ("A", "B"), "X": ("A", "X"), "C": ("A", "B", "C"), "D": ("A", "B", "C", "D")}
    access = {t: AccessDef(t, t, k, {c: "string" for c in (*k, "NOTE")}) for t, k in keys.items()}
    access["A"] = AccessDef("A", "A", ("A",), {"A": "string", "NOTE": "string", "LAT": "number", "LON": "number"})
    tie = lambda k: ", ".join(f"{c} = [{c}]" for c in k[:-1])
    d = TypeNode("D", "D", parent_key=tie(keys["D"]), use_parent_location=True)
    c = TypeNode("C", "C", parent_key=tie(keys["C"]), use_parent_location=True, children=(d,))
    b = TypeNode("B", "B", parent_key=tie(keys["B"]), use_parent_location=True, children=(c,))
    tree = Taxonomy((TypeNode("A", "A", "LAT", "LON", children=(TypeNode("X", "X", parent_key="A = [A]"), b)),))
    rows = {t: {} for t in kinds}
    for i in range(7):
        rows["A"][f"a{i}",] = f"key{i % 3}"
    for t in kinds[1:]:
        parents = rows["A"] if t in "BX" else rows["B"] if t == "C" else rows["C"]
        for parent in parents:
            for name in rng.sample("pqrs", rng.randint(0, 3)):
                rows[t][*parent, name] = f"{t}:{'/'.join(parent)}/{name}"
    tables = {
        t: spark.createDataFrame(
            [(*k, n, 10.0 + int(k[0][1]), 20.0) if t == "A" else (*k, n) for k, n in found.items()],
            ", ".join(f"{c} string" for c in (*keys[t], "NOTE")) + (", LAT double, LON double" if t == "A" else ""))
        for t, found in rows.items()
    }
    rule = Rule("U1", "A", "Uniqueness", "Uniqueness", "NOTE", "NOTE")
    flagged = cut_lineage(flag_index(X.build_index(spark, tree, tables, access), [rule], tree, access))
    chosen = {f"key{k}": rng.choice([f"a{i}" for i in range(7) if i % 3 == k]) for k in (0, 1)}
    out = cut_lineage(merge_duplicates(flagged, flagged.filter(F.col("data_name").isin(*chosen.values()) & (F.col("data_type") == "A")), rule, tree, access))
    survivors = {k[0]: chosen[n] for k, n in rows["A"].items() if n in chosen}
    a = attributes(F.col("doc"))
    live = out.filter(X.has_doc() & F.col("data_type").isin(*kinds)).select("*", attr_text(a, "NOTE").alias("note"), *[attr_text(a, t).alias(f"k_{t}") for t in kinds]).collect()
    for t in kinds:
        want = merged_by_hand([(k, n, k) for k, n in rows[t].items()], survivors)
        got = {tuple(r[f"k_{c}"] for c in keys[t]): r for r in live if r["data_type"] == t}
        assert len(got) == sum(r["data_type"] == t for r in live)
        assert {k: r["note"] for k, r in got.items()} == want
        for k, r in got.items():
            assert r["data_name"] == k[-1] and r["data_key"] == " AND ".join(f"{c} = '{v}'" for c, v in zip(keys[t], k))
            assert r["latitude"] == (None if t == "X" else 10.0 + int(k[0][1]))
    # a tree: unique paths, every node's parent is there and is its group, records stand below the record their key names
    nodes = {tuple(r["node_path"]): r for r in out.collect()}
    assert len(nodes) == out.count()
    by_key = {(r["data_type"], r["data_key"]): tuple(r["node_path"]) for r in live}
    for r in live:
        path = tuple(r["node_path"])
        assert r["level"] == len(path) and tuple(r["parent_path"]) == path[:-1] and nodes[path[:-1]]["data_type"] == r["data_type"] + "s"
        if r["data_type"] != "A":
            above = {"B": "A", "X": "A", "C": "B", "D": "C"}[r["data_type"]]
            assert path[:-2] == by_key[above, " AND ".join(f"{c} = '{r[f'k_{c}']}'" for c in keys[above])]
    # the duplicates that no survivor was named for keep their flags
    assert {r["data_name"] for r in nodes.values() if r["qc"]} == {k[0] for k, n in rows["A"].items() if n not in chosen} == {"a2", "a5"}


def test_standard_definitions():
    assert [r.key for r in prediction_order(rules("Top"))] == ["P1", "P2", "P9", "P6", "P5", "P3", "P4", "P8", "P7"]
    assert WELL_TREE.level_of("MarkerPick") == 4 and WELL_TREE.depth == 4
    assert STANDARD_ACCESS["WellBore"].schema["FINAL_TD"].dataType.simpleString() == "double"
