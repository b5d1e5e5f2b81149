import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from treemend.model import AccessDef, ReferenceDef
from treemend.operators import duplicates as DU
from treemend.operators import sync as S
from treemend.sources import csv_files as K
from treemend.sources import las as L
from treemend.sources.tables import scan_jdbc
from treemend.streaming.ingest import append_to, stream_ingest

LAS = """~Version Information
 VERS.  2.0 : CWLS
 WRAP.  NO : one line
~Well
# comment
 UWI .  : UNIQUE WELL ID
 API .  {api} : API
 WELL.  Big One : WELL
 LEAS.  {leas} : LEASE
 no colon and no dot
~Curve
 DEPT.M : Depth
 GR.API 1 2 : Gamma
 RT.OHMM : Resistivity
 GR.API : Gamma again
~Params
 MUD.  GEL : Mud
~A DEPT GR RT GR
 1.0  10 20 30
 1.5  11
 2.0  x 1e16 -1,000

 2.5  -999.25 5 6
"""


@pytest.fixture(scope="module")
def las_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("las")
    (folder / "api.las").write_text(LAS.format(api="A1", leas=""))
    (folder / "both.las").write_text(LAS.format(api="", leas="Lee").replace("\n", "\r\n"))
    (folder / "well.las").write_text(LAS.format(api="", leas=""))
    (folder / "old.las").write_text(LAS.format(api="A2", leas="").replace("VERS.  2.0", "VERS.  1.2"))
    (folder / "wrap.las").write_text(LAS.format(api="A3", leas="").replace("WRAP.  NO", "WRAP.  YES"))
    (folder / "none.las").write_text("~Well\n UWI. X : u\n")
    return str(folder)


def name(column="file"):
    return F.substring_index(column, "/", -1)


def test_las_batch(spark, las_folder):
    batch = L.load_las(spark, las_folder)
    verdict = {r["f"]: r["reason"] for r in batch.verdict.select(name().alias("f"), "reason").collect()}
    assert verdict == {
        "api.las": None, "both.las": None, "well.las": None, "old.las": "version not supported",
        "wrap.las": "wrap not supported", "none.las": "version missing",
    }
    keys = {r["f"]: r["UWI"] for r in batch.wells().select(name().alias("f"), "UWI").collect()}
    # a fallback of two mnemonics keeps the last one, with a dash if the first is filled
    assert keys == {"api.las": "A1", "both.las": "-Big One", "well.las": "Big One"}
    well = batch.wells().filter("UWI = 'A1'").first()
    assert well["OPERATOR"] == "UNKNOWN" and well["WELL_NAME"] == "Big One"
    logs = [(r["curve_id"], r["reported_desc"], r["source"]) for r in batch.logs().filter("uwi = 'A1'").orderBy("curve_id").collect()]
    assert logs == [("GR", "Gamma", "api.las"), ("RT", "Resistivity", "api.las")]
    rows = batch.values().filter("uwi = 'A1'").orderBy("curve_id", "sample_id").collect()
    got = [(r["curve_id"], r["sample_id"], r["index_value"], r["measured_value"]) for r in rows]
    assert got == [
        ("GR", 0, 1.0, 10.0), ("GR", 1, 1.5, 11.0), ("GR", 2, 2.0, -999.25), ("GR", 3, -999.25, -999.25), ("GR", 4, 2.5, -999.25),
        ("RT", 0, 1.0, 20.0), ("RT", 1, 1.5, 11.0), ("RT", 2, 2.0, -999.25), ("RT", 3, -999.25, -999.25), ("RT", 4, 2.5, 5.0),
    ]
    assert [tuple(r) for r in batch.parameters().filter("uwi = 'A1'").collect()] == [("A1", 1, "MUD", "GEL", "Mud")]


def plain_las_lines(folder):
    """Sections by splitting the whole text at ~; the last section of a letter counts; a line break ends a line."""
    out = []
    for file in Path(folder).rglob("*.las"):
        last = {s[0]: s for s in file.read_bytes().decode().split("~") if s and s[0] in "VWCPA"}
        for letter, text in last.items():
            lines = re.split("\r\n|\r|\n", text)
            lines = lines[:-1] if lines[-1] == "" and len(lines) > 1 else lines
            out += [(file.name, letter, i, x) for i, x in enumerate(lines)]
    return out


@pytest.mark.parametrize("tail", ["", "\n", "\n\n", "\r\n", "\r\n\r\n\r\n", "\n\n\n\n"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_ends_and_blank_tails(spark, tmp_path, tail, end):
    body = end.join(["~V", " VERS. 2.0 : v", "~~W x", " UWI. W1 : w", "~C", "~P", "~C again", " GR. : g", "~A", "1 2", "", "3 4"])
    (tmp_path / "a.las").write_bytes((body + tail).encode())
    got = sorted((r["f"], r["section"], r["line_no"], r["line"]) for r in L.scan_las(spark, str(tmp_path)).select(name().alias("f"), "*").collect())
    assert got == sorted(plain_las_lines(tmp_path))


def test_large_files_read_in_splits_give_the_same_lines(spark, las_folder):
    key = lambda df: sorted((r["f"], r["section"], r["line_no"], r["line"]) for r in df.select(name().alias("f"), "*").collect())
    whole = key(L.scan_las(spark, las_folder))
    assert whole == sorted(plain_las_lines(las_folder))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        split = key(L.scan_las(spark, las_folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert split == whole


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X,KEY,NAME\n1,a,first\n2,,nokey\n3,A,longer name\n4,b,\n")
    rows = K.scan_csv(spark, str(tmp_path), "KEY=1; NAME=2; NO=0", {"NAME": 6}, with_order=True, multiline=False)
    out = {r["KEY"]: (r["NAME"], r["NO"], r["SET"]) for r in K.dedupe_last(rows, ["KEY", "SET"]).collect()}
    # the hash ignores case, the last row wins, an absent key column is UNKNOWN
    assert out == {"UNKNOWN": ("nokey", "2", "UNKNOWN"), "A": ("longer", "3", "UNKNOWN"), "b": (None, "4", "UNKNOWN")}


def test_quoted_line_breaks_in_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice('ab,"\n é;') for _ in range(rng.randint(0, 12)))
    want = []
    for f in range(3):
        rows = [(str(i), word(), "x\n" * rng.choice([0, 0, 0, 90]) + word()) for i in range(60)]
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["ID", 'A "quoted"\nname', "B"])
            writer.writerows(rows)
        want += rows
    one_task = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"').toDF("ID", "A", "B")
    key = lambda df: sorted(tuple(x or "" for x in r) for r in df.select("ID", "A", "B").collect())
    assert key(one_task) == sorted(want)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "64b", "333b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = K.scan_csv(spark, str(tmp_path), "ID=0; A=1; B=2", with_order=True, multiline=True)
            assert key(got) == sorted(want)
            ids = [r["ID"] for r in got.filter(F.col("_order.file").endswith("0.csv")).orderBy("_order").select("ID").collect()]
            assert ids == [str(i) for i in range(60)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "crlf").mkdir()
    (tmp_path / "crlf" / "a.csv").write_bytes(b'ID,A\r\n1,"x"\r\n\r\n2,y\r\n3,"a\nb"')
    assert [tuple(r) for r in K.scan_csv(spark, str(tmp_path / "crlf"), "ID=0; A=1", multiline=True).orderBy("ID").collect()] == [("1", "x"), ("2", "y"), ("3", "a\nb")]


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,NAME,X\n1,"say ""hi"" x",a\n2,"path\\",b\n3,"a,b",c\n4,back\\slash,d\n')
    rows = K.scan_csv(spark, str(tmp_path), "ID=0; NAME=1; X=2", multiline=False)
    assert sorted(map(tuple, rows.collect())) == [("1", 'say "hi" x', "a"), ("2", "path\\", "b"), ("3", "a,b", "c"), ("4", "back\\slash", "d")]
    (tmp_path / "a.csv").write_text('ID,NAME\n1,"two\nlines"\n2,one\n')
    rows = K.scan_csv(spark, str(tmp_path), "ID=0; NAME=1", multiline=True)
    assert sorted(map(tuple, rows.collect())) == [("1", "two\nlines"), ("2", "one")]


def test_upsert_refuses_unknown_columns(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(2, "b", 5)], "k int, v string, extra int")
    with pytest.raises(ValueError, match="extra"):
        S.upsert(target, source, ["k"])
    assert sorted(map(tuple, S.upsert(target, source, ["k"], ignore_unknown=True).collect())) == [(1, "a"), (2, "b")]


def test_jdbc_needs_bounds(spark):
    with pytest.raises(ValueError, match="single_task"):
        scan_jdbc(spark, "jdbc:none:", AccessDef("A", "A", ("k",), {"k": "string"}))


def test_parents(spark):
    child = spark.createDataFrame([("abc'def",), ("abc'xyz",), ("ab",), ("",), (None,), ("abcdef",)], "U string")
    ref = ReferenceDef("Pick", "UNIT", "ID", "LONG", "U", "SET=ALL")
    rows = sorted(map(tuple, K.derive_parents(child, ref, 4).collect()))
    assert rows == [("ab", "ab", "ALL"), ("abc", "abc'def", "ALL"), ("abcd", "abcdef", "ALL")]
    cut = sorted(r["U"] or "" for r in K.cut_references(child, ref, 4).collect())
    assert cut == ["", "", "ab", "abc", "abc", "abcd"]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, ROW_CHANGED_BY string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = S.upsert(target, source, ["k"], {"ROW_CHANGED_BY": F.lit("me")})
    want = [(1, "a", "t0"), (2, "B", "me"), (3, "C", "me")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, S.upsert(once, source, ["k"], {"ROW_CHANGED_BY": F.lit("me")}).collect())) == want
    with pytest.raises(ValueError, match="repeated keys"):
        S.upsert(target, source.unionByName(source), ["k"])


def test_doc_upsert(spark):
    access = AccessDef("T", "T", ("k",), {"k": "string", "n": "number", "d": "date"})
    target = spark.createDataFrame([("a", 1.0, None)], "k string, n double, d date")
    docs = spark.createDataFrame([('{"k":"a","n":"bad"}',), ('{"k":"b","d":"2020-05-06T00:00:00"}',)], "doc string")
    out = sorted((r["k"], r["n"], str(r["d"])) for r in S.upsert_docs(target, docs, access).collect())
    assert out == [("a", None, "None"), ("b", None, "2020-05-06")]


def test_deleted_keys(spark):
    access = AccessDef("T", "T", ("A", "B"), {"A": "string", "B": "string"})
    rows = [("T", None, "A = 'o'neil' AND B = 'x = 1'"), ("T", "{}", "A = 'q' AND B = 'q'"), ("S", None, "A = 'z' AND B = 'z'")]
    idx = spark.createDataFrame(rows, "data_type string, doc string, data_key string")
    assert [tuple(r) for r in S.cleared_keys(idx, access).collect()] == [("o'neil", "x = 1")]
    target = spark.createDataFrame([("o'neil", "x = 1"), ("q", "q")], "A string, B string")
    assert [tuple(r) for r in S.propagate_deletes(target, idx, access).collect()] == [("q", "q")]


def test_references(spark):
    ref = ReferenceDef("T", "R", "ID", "NAME", "V", "KIND=K", insert=False)
    table = spark.createDataFrame([("a", "a", "K"), ("b", "b", "OTHER")], "ID string, NAME string, KIND string")
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "V string")
    assert [tuple(r) for r in S.new_references(df, ref, table).collect()] == [("b", "b", "K")]
    rows, same = S.check_foreign_keys(spark.createDataFrame([("a",), ("zz",)], "V string"), ref, table)
    assert sorted(r["V"] for r in rows.collect()) == ["UNKNOWN", "a"] and same.count() == 2


def test_duplicate_curves(spark):
    wells = spark.createDataFrame([("k", "good", "Y"), ("k", "bad", "N"), ("z", "solo", "N")], "ukey string, uwi string, valid string")
    curves = spark.createDataFrame([("good", "GR"), ("bad", "GR"), ("bad", "RT"), ("solo", "GR"), ("other", "GR")], "uwi string, curve_id string")
    values = curves.crossJoin(spark.range(2))
    fixed, moved = DU.fix_duplicate_curves(curves, values, wells)
    assert sorted(map(tuple, fixed.collect())) == [("good", "GR"), ("good", "RT"), ("other", "GR"), ("solo", "GR")]
    assert moved.count() == 8
    assert sorted(r["uwi"] for r in DU.delete_duplicate_wells(wells, DU.mark_duplicates(wells, "ukey")).collect()) == ["good", "solo"]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    df = spark.range(10).withColumn("v", F.lit("a"))
    seen = []
    load = append_to(out)

    def loader(batch, batch_id):
        seen.append(batch_id)
        load(batch, batch_id)

    for part in (df.filter("id < 4"), df.filter("id >= 4")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream_ingest(spark, source, df.schema, state, loader)
    stream_ingest(spark, source, df.schema, state, loader)
    assert seen == [0, 1] and spark.read.parquet(out).count() == 10
    # a repeated batch replaces itself
    load(df.filter("id >= 4"), 1)
    assert spark.read.parquet(out).count() == 10 and os.path.isdir(state)


def test_write_version(spark, tmp_path):
    root = str(tmp_path / "t")
    S.write_version(spark.range(3).toDF("k"), root, 1)
    new = S.upsert(spark.read.parquet(root + "/v000001"), spark.range(5).toDF("k"), ["k"])
    assert spark.read.parquet(S.write_version(new, root, 2)).count() == 5


def test_driver_files_are_written_line_by_line(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from treemend.catalog.files import _las_folder, _rfc_csv
    from treemend.fixtures import Fixtures

    longest, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, *a, **b: longest.append(self._df.agg(F.max(F.length("value"))).first()[0] or 0) or text(self, path, *a, **b))
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    rows = spark.range(0, 3000, 1, 20).select("id", F.concat(F.lit('say "'), F.col("id").cast("string"), F.lit('", \\')).alias("name"))
    path = _rfc_csv(fx, rows.where("id < 2990 OR id > 5000"), "rows")
    files = [f.read_text().splitlines() for f in Path(path.removeprefix("file:")).glob("part-*")]
    assert len(files) == 20 and all(f[0] == "id,name" and len(f) > 1 for f in files)
    assert {(r[0], r[1]) for r in K.scan_csv(spark, path, "id=0; name=1", multiline=False).collect()} == {(str(i), f'say "{i}", \\') for i in range(2990)}
    assert _rfc_csv(fx, rows.where("id < 0"), "none")
    folder = _las_folder(fx)
    users = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    las = [f.read_text() for f in Path(folder.removeprefix("file:")).rglob("part-*")]
    assert len(las) == users and all(t.startswith("~Version") and t.count("~A ") == 1 and "\n\n" not in t for t in las)
    index = [[float(x.split()[0]) for x in t.split("~A ")[1].splitlines()[1:]] for t in las]
    assert all(i == sorted(i) and i for i in index)
    # no value holds more than a header or a row, however many rows a user has
    assert max(longest) < 1000 < max(map(len, las))


def test_las_files_are_many_to_a_task(spark, tmp_path):
    from treemend.catalog.files import _las_folder
    from treemend.fixtures import Fixtures

    events = ["id AS event_id", "id % 40 AS user_id", "timestamp_seconds(id) AS ts", "if(id % 3 = 0, 'view', 'click') AS event_type", "cast(id AS double) AS value"]
    spark.range(400).selectExpr(*events).write.parquet(str(tmp_path / "events.parquet"))
    las = list(Path(_las_folder(Fixtures(spark, str(tmp_path))).removeprefix("file:")).rglob("part-*"))
    texts = [f.read_text() for f in las]
    assert len(las) == 40 and all(t.startswith("~Version") and t.count("~A ") == 1 for t in texts)
    # tasks follow the rows, not the files or the users' ids
    assert len({f.name.split("-")[1] for f in las}) <= spark.sparkContext.defaultParallelism


def test_las_files_read_whole_and_in_splits_give_the_same_lines(spark, tmp_path, monkeypatch):
    import gzip

    texts = {
        "odd.las": b"\xef\xbb\xbflost\n~V\n VERS. 2.0 : \xe9\n\n~~W x~C\r\n GR. : g\rtail~Q\nlost~W \xff\n UWI. W1 : w\n~A\n1 2\n\n",
        "empty.las": b"", "bare.las": b"no section\n", "blanks.las": b"\n~A\n\n\n", "a b%.las": b"~V\n VERS. 2.0 : v\n~A 1 2",
        "p.las.gz": gzip.compress(b"~V\n VERS. 2.0 : v\n"),
    }
    for file, text in texts.items():
        (tmp_path / file).write_bytes(text)
    rows = lambda: sorted(tuple(map(str, r)) for r in L.scan_las(spark, str(tmp_path)).select("file", "section", "line_no", F.hex("line")).collect())
    whole = rows()
    monkeypatch.setattr(L, "WHOLE_BYTES", -1)
    assert whole == rows() and len(whole) == 19
    # some files either way
    monkeypatch.setattr(L, "WHOLE_BYTES", 20)
    assert whole == rows()
    assert L.load_las(spark, str(tmp_path)).verdict.filter("reason IS NULL").count() == 3


def test_many_las_files_are_read_once_in_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(400):
        (tmp_path / f"{i}.las").write_text(f"~V\n VERS. 2.0 : v\n~W\n UWI. W{i} : w\n~C\n D. : d\n GR. : g\n~A\n1 {i}\n")
    batch = L.load_las(spark, str(tmp_path))
    # opened once: what follows does not need them any more
    for i in range(400):
        (tmp_path / f"{i}.las").write_text("~V\n")
    assert batch.values().filter("uwi = concat('W', cast(measured_value AS int))").count() == 400
    monkeypatch.setattr(L, "PARTS_PER_TASK", 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        files = L._listing(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() == 400 and L._many_to_a_task(files).rdd.getNumPartitions() == 80
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_las_fixture_is_the_same_on_any_file_system(spark, tmp_path, monkeypatch):
    import treemend.catalog.files as C
    from treemend.fixtures import Fixtures

    events = ["id AS event_id", "if(id % 7 = 0, NULL, id % 40) AS user_id", "timestamp_seconds(id) AS ts", "if(id % 3 = 0, 'view', 'click') AS event_type", "cast(id AS double) AS value"]
    spark.range(400).selectExpr(*events).write.parquet(str(tmp_path / "events.parquet"))
    texts = lambda: sorted(f.read_text() for f in Path(C._las_folder(Fixtures(spark, str(tmp_path))).removeprefix("file:")).rglob("part-*"))
    own = texts()
    monkeypatch.setattr(C, "mounted_path", lambda spark, path: None)
    assert own == texts() and len(own) == 41


def test_tables_from_files_read_each_file_once(spark, tmp_path):
    from treemend.fixtures import ACCESS
    from treemend.plans.files import tables_from_files

    (tmp_path / "csv").mkdir()
    (tmp_path / "las").mkdir()
    wells = tmp_path / "csv" / "wells.csv"
    wells.write_text("UWI,NAME\nW1,first\nW2,\nw1,last\n")
    (tmp_path / "las" / "a.las").write_text(LAS.format(api="A1", leas=""))
    tables = tables_from_files(spark, ACCESS, {"WellBore": (str(tmp_path / "csv"), "UWI=0; WELL_NAME=1")}, str(tmp_path / "las"))
    # what came later into the folders is not read
    wells.write_text("UWI,NAME\nX1,other\n")
    (tmp_path / "las" / "a.las").write_text("~V\n")
    assert sorted((r["UWI"], r["WELL_NAME"]) for r in tables["WELL"].collect()) == [("W2", None), ("w1", "last")]
    assert sorted((r["UWI"], r["CURVE_ID"]) for r in tables["WELL_LOG_CURVE"].collect()) == [("A1", "GR"), ("A1", "RT")]
    assert tables["WELL_LOG_CURVE_VALUE"].count() == 10
