"""CSV and LAS sources: S keys. The files are written from the driver tables first."""

import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from treemend.catalog.registry import query
from treemend.fixtures import VIEWS, Fixtures, duck_with
from treemend.model import ReferenceDef
from treemend.session import mounted_path, scratch_path
from treemend.sources import csv_files as K
from treemend.sources import las as L

BIG = "bigint"
# Events whose LAS files one task writes, about a thousand files.
EVENTS_PER_TASK = 65_536


def _csv(fx: Fixtures, df, label: str) -> str:
    path = scratch_path(fx.spark, label)
    df.write.csv(path, header=True, escape='"')
    return path


def _rfc_csv(fx: Fixtures, df, label: str) -> str:
    """Files of quoted values, quotes doubled, written as plain text."""
    path = scratch_path(fx.spark, label)
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    header = ",".join(df.columns)

    def with_header(batches):
        started = False
        for batch in batches:
            if batch.num_rows and not started:
                started = True
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    # each partition writes its own file, line by line
    df.select(F.concat_ws(",", *cells).alias("value")).mapInArrow(with_header, "value string").write.text(path)
    return path


@query(
    "csv_scan_mapped",
    duck_with("f_well") + "SELECT uwi AS \"UWI\", substr(concat(well_name, CASE wkey % 5 WHEN 0 THEN ' \"a\" b' WHEN 1 THEN ',c' WHEN 2 THEN '\\' WHEN 3 THEN '\\\"' ELSE '' END), 1, 22) AS \"WELL_NAME\","
    " cast(round(elev, 2) AS double) AS \"ELEV\" FROM f_well",
)
def csv_scan_mapped(fx):
    # names with doubled quotes, delimiters and backslashes in quotes
    tail = F.get(F.array(*map(F.lit, (' "a" b', ",c", "\\", '\\"', ""))), F.col("wkey") % 5)
    w = fx["f_well"].select("wkey", "status", "uwi", "lat", "elev", F.concat("well_name", tail).alias("well_name"))
    rows = K.scan_csv(fx.spark, _rfc_csv(fx, w, "wells"), "UWI=2; WELL_NAME=5; ELEV=4", {"WELL_NAME": 22}, multiline=False)
    return rows.select("UWI", "WELL_NAME", F.round(F.col("ELEV").cast("double"), 2).alias("ELEV"))


@query(
    "csv_quoted_breaks",
    duck_with("f_well") + "SELECT uwi AS \"UWI\", concat(well_name, CASE wkey % 3 WHEN 0 THEN chr(10) || '\"a\"' || chr(10) || chr(10) || 'b' WHEN 1 THEN ',' || chr(10) ELSE '' END) AS \"WELL_NAME\" FROM f_well",
)
def csv_quoted_breaks(fx):
    """Names with line breaks, quotes and delimiters in quotes, read in splits."""
    tail = F.get(F.array(*map(F.lit, ('\n"a"\n\nb', ",\n", ""))), F.col("wkey") % 3)
    w = fx["f_well"].select("wkey", "uwi", F.concat("well_name", tail).alias("well_name"))
    return K.scan_csv(fx.spark, _rfc_csv(fx, w, "names"), "UWI=1; WELL_NAME=2", multiline=True)


# picks of one (unit, status) pair repeat within a well; empty units when the key divides by 9
_KEYED = """SELECT pkey, uwi, CASE WHEN pkey % 9 = 0 THEN NULL ELSE unit END AS unit, depth FROM {0}"""


@query(
    "csv_key_fix_dedupe",
    duck_with("f_pick", more=f"k AS ({_KEYED.format('f_pick')}), r AS (SELECT *, coalesce(unit, 'UNKNOWN') AS u,"
              " row_number() OVER (PARTITION BY upper(uwi || coalesce(unit, 'UNKNOWN')) ORDER BY pkey DESC) AS rn FROM k)")
    + "SELECT uwi AS \"UWI\", u AS \"UNIT\", 'UNKNOWN' AS \"INTERP\", pkey, round(depth, 6) AS depth, sha256(upper(uwi || u || 'UNKNOWN')) AS \"KeyHash\" FROM r WHERE rn = 1",
)
def csv_key_fix_dedupe(fx):
    picks = fx.spark.sql(_KEYED.format("{f_pick}"), f_pick=fx["f_pick"]).orderBy("pkey")
    path = _csv(fx, picks, "picks")
    rows = K.scan_csv(fx.spark, path, {"pkey": 0, "UWI": 1, "UNIT": 2, "depth": 3}, with_order=True, multiline=False)
    # part files are written in key order, so the file name sorts as the rows did
    out = K.dedupe_last(rows, ["UWI", "UNIT", "INTERP"])
    return out.select(
        "UWI", "UNIT", "INTERP", F.col("pkey").cast(BIG).alias("pkey"), F.round(F.col("depth").cast("double"), 6).alias("depth"), "KeyHash"
    )


@query(
    "csv_parent_rows",
    "SELECT k AS \"UNIT_ID\", min(v) AS \"LONG_NAME\", 'UNKNOWN' AS \"SET_ID\" FROM (SELECT v, CASE WHEN length(v) > 12 THEN regexp_replace(substr(v, 1, 12), '''$', '') ELSE v END AS k"
    " FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE replace(p_name, ' ', '''') || p_brand END AS v FROM part) WHERE v <> '') GROUP BY k",
)
def csv_parent_rows(fx):
    name = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("'")), "p_brand"))
    path = _csv(fx, fx["part"].select("p_partkey", name.alias("unit")), "units")
    child = K.scan_csv(fx.spark, path, "ID=0; UNIT=1", multiline=False)
    ref = ReferenceDef("MarkerPick", "STRAT_UNIT", "UNIT_ID", "LONG_NAME", "UNIT", "SET_ID=UNKNOWN")
    return K.derive_parents(child, ref, 12)


# ---------------------------------------------------------------- LAS

# one file per user: a row per sample number, a column per event type. Every
# 13th user has an old version, every 17th is wrapped, every 19th has no version;
# every 7th lacks the UWI but has an API, every 11th only lease and well.
_GRID = """
    SELECT wkey, sample_id, sample_id / 2 AS idx,
           max(CASE WHEN curve_id = 'click' THEN t END) AS c1, max(CASE WHEN curve_id = 'view' THEN t END) AS c2,
           max(CASE WHEN curve_id = 'purchase' THEN t END) AS c3, max(CASE WHEN curve_id = 'signup' THEN t END) AS c4,
           max(CASE WHEN curve_id = 'error' THEN t END) AS c5
    FROM (SELECT wkey, sample_id, curve_id,
                 CASE WHEN event_id % 29 = 0 THEN 'bad' WHEN event_id % 31 = 0 THEN '1e16' ELSE cast(measured_value AS string) END AS t FROM {f_curve}) s
    GROUP BY wkey, sample_id"""


def _write_folders(folder: str):
    """A task's rows (wkey, value) in order -> a file per key in a folder of its own; yields how many.

    The rows of a key may span batches. A file gets its name once it is whole,
    so an attempt that failed leaves none.
    """

    def write(batches):
        task = TaskContext.get().partitionId()
        home, n, at, file = f"{folder}/task={task:05d}", 0, None, None
        held = f"{home}/_{TaskContext.get().taskAttemptId()}"

        def close():
            file.close()
            os.replace(held, f"{home}/part-{task:05d}-{'null' if at is None else at}.las")

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file is None or key != at:
                    if file is not None:
                        close()
                    os.makedirs(home, exist_ok=True)
                    at, file, n = key, open(held, "w", encoding="utf-8", newline=""), n + 1
                file.write(f"{value}\n")
        if file is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return write


def _las_folder(fx: Fixtures) -> str:
    # a user's events meet in one task, for all of what follows; tasks follow the rows, not the files
    events = fx["events"]
    tasks = max(fx.spark.sparkContext.defaultParallelism, events.count() // EVENTS_PER_TASK + 1)
    curves = fx.spark.sql(VIEWS["f_curve"], events=events.repartition(tasks, "user_id"))
    grid = fx.spark.sql(_GRID, f_curve=curves)
    token = lambda c: F.coalesce(F.col(c), F.lit("-999.25"))
    # rows divisible by 10 stop after the first curve: the missing columns repeat it
    row = F.concat(
        F.lit("  "), F.col("idx").cast("string"), F.lit("   "), token("c1"),
        F.when(F.col("sample_id") % 10 > 0, F.concat(F.lit("  "), token("c2"), F.lit(" "), token("c3"), F.lit("  "), token("c4"), F.lit("   "), token("c5"))).otherwise(""),
    )
    k = F.col("wkey")
    ks = k.cast("string")
    uwi = F.concat(F.lit("W"), F.lpad(ks, 8, "0"))
    version = F.when(k % 19 == 0, "").otherwise(
        F.concat(F.lit(" VERS.  "), F.when(k % 13 == 0, "1.2").otherwise("2.0"), F.lit(" : CWLS LOG ASCII STANDARD\n"))
    )
    header = F.concat(
        F.lit("~Version Information\n"), version,
        F.lit(" WRAP.  "), F.when(k % 17 == 0, "YES").otherwise("NO"), F.lit(" : One line per depth step\n"),
        F.lit("~Well Information\n#MNEM.UNIT  DATA : DESCRIPTION\n UWI .  "), F.when((k % 7 > 0) & (k % 11 > 0), uwi).otherwise(""),
        F.lit(" : UNIQUE WELL ID\n API .  "), F.when(k % 7 == 0, F.concat(F.lit("A"), ks)).otherwise(""), F.lit(" : API NUMBER\n"),
        F.lit(" WELL .  Well "), ks, F.lit(" : WELL: NAME\n LEAS .  Lease "), ks, F.lit(" : LEASE\n LAT .DEG  "), (k * 0.5).cast("string"), F.lit(" : LATITUDE\n"),
        F.lit("~Curve Information\n DEPT.M : Depth\n CLICK.API 07 : Clicks\n VIEW.API : Views\n BUY.V/V : Purchases\n SIGN.API : Signups\n ERR.API : Errors\n"),
        F.lit("~Parameter Information\n MUD .  GEL : Mud: type\n# no parameter\n BHT .DEGC  "), ks, F.lit(" : Bottom hole\n"),
        F.lit("~A DEPT CLICK VIEW BUY SIGN ERR"),
    )
    # one file per user: its lines in order, a row each; the header stands before the first sample
    value = F.when(F.col("sample_id") == 0, F.concat(F.coalesce(header, F.lit("")), F.lit("\n"), row)).otherwise(row)
    lines = grid.select("wkey", "sample_id", value.alias("value")).sortWithinPartitions("wkey", "sample_id").select("wkey", "value")
    path = scratch_path(fx.spark, "las")
    if mounted := mounted_path(fx.spark, path):
        # Hadoop starts processes for the mode of every file it makes on such a file system
        lines.mapInArrow(_write_folders(mounted), "n bigint").agg(F.sum("n")).collect()
    else:
        lines.write.partitionBy("wkey").text(path)
    return path


def _las(fx: Fixtures) -> L.LasBatch:
    return L.load_las(fx.spark, _las_folder(fx))


def _user(headers):
    """(file, k): the user a file was written for stands in its BHT parameter."""
    return headers.filter(F.col("mnemonic") == "BHT").select("file", F.col("data").cast(BIG).alias("k"))


_USERS = "u AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id % 13 > 0 AND user_id % 17 > 0 AND user_id % 19 > 0)"
_UWI = "CASE WHEN k % 7 = 0 THEN concat('A', k) WHEN k % 11 = 0 THEN concat('-Well ', k, ' : WELL') ELSE concat('W', lpad(cast(k AS string), 8, '0')) END"


@query(
    "las_sections",
    "SELECT k, CASE WHEN k % 19 = 0 AND k % 17 > 0 THEN 'version missing' WHEN k % 19 > 0 AND k % 13 = 0 THEN 'version not supported' WHEN k % 17 = 0 THEN 'wrap not supported' END AS reason,"
    " 5::BIGINT AS n_sections FROM (SELECT DISTINCT user_id AS k FROM events)",
)
def las_sections(fx):
    batch = _las(fx)
    counts = batch.lines.groupBy("file").agg(F.countDistinct("section").alias("n_sections"))
    rows = batch.verdict.join(counts, "file")
    return rows.join(_user(batch.headers), "file").select("k", "reason", "n_sections")


@query(
    "las_header_lines",
    f"WITH {_USERS} SELECT k, m[1] AS section, m[2] AS mnemonic, m[3] AS unit, m[4] AS data, m[5] AS description FROM (SELECT k, unnest(["
    "['V', 'VERS', '', '2.0', 'CWLS LOG ASCII STANDARD'], ['V', 'WRAP', '', 'NO', 'One line per depth step'],"
    " ['W', 'UWI', '', CASE WHEN k % 7 > 0 AND k % 11 > 0 THEN concat('W', lpad(cast(k AS string), 8, '0')) ELSE '' END, 'UNIQUE WELL ID'],"
    " ['W', 'API', '', CASE WHEN k % 7 = 0 THEN concat('A', k) ELSE '' END, 'API NUMBER'], ['W', 'WELL', '', concat('Well ', k, ' : WELL'), 'NAME'],"
    " ['W', 'LEAS', '', concat('Lease ', k), 'LEASE'], ['W', 'LAT', 'DEG', cast(k * 0.5::DOUBLE AS string), 'LATITUDE'],"
    " ['C', 'DEPT', 'M', '', 'Depth'], ['C', 'CLICK', 'API', '07', 'Clicks'], ['C', 'VIEW', 'API', '', 'Views'], ['C', 'BUY', 'V/V', '', 'Purchases'], ['C', 'SIGN', 'API', '', 'Signups'], ['C', 'ERR', 'API', '', 'Errors'],"
    " ['P', 'MUD', '', 'GEL : Mud', 'type'], ['P', 'BHT', 'DEGC', cast(k AS string), 'Bottom hole']]) AS m FROM u)",
)
def las_header_lines(fx):
    batch = _las(fx)
    rows = batch.good_headers.join(_user(batch.headers), "file")
    return rows.select("k", "section", "mnemonic", "unit", "data", "description")


@query(
    "las_wells",
    f"WITH {_USERS} SELECT {_UWI} AS \"UWI\", concat('Well ', k, ' : WELL') AS \"WELL_NAME\", concat('Lease ', k) AS \"LEASE_NAME\","
    " cast(k * 0.5::DOUBLE AS string) AS \"SURFACE_LATITUDE\", '' AS \"SURFACE_LONGITUDE\", 'UNKNOWN' AS \"OPERATOR\", 'UNKNOWN' AS \"CURRENT_STATUS\", 'UNKNOWN' AS \"DEPTH_DATUM\","
    " 'UNKNOWN' AS \"ASSIGNED_FIELD\" FROM u",
)
def las_wells(fx):
    return _las(fx).wells().drop("file")


@query(
    "las_curve_headers",
    f"WITH {_USERS} SELECT {_UWI} AS uwi, m[1] AS curve_id, m[2] AS reported_desc, -999.25::DOUBLE AS null_representation, -99999::DOUBLE AS min_index FROM"
    " (SELECT k, unnest([['CLICK', 'Clicks'], ['VIEW', 'Views'], ['BUY', 'Purchases'], ['SIGN', 'Signups'], ['ERR', 'Errors']]) AS m FROM u)",
)
def las_curve_headers(fx):
    return _las(fx).logs().select("uwi", "curve_id", "reported_desc", "null_representation", "min_index")


_NUM = "CASE WHEN {0} IN ('bad', '1e16') THEN -999.25 ELSE coalesce(try_cast({0} AS double), -999.25) END"


@query(
    "las_curve_values",
    duck_with("f_curve", more=f"{_USERS}, g AS ({_GRID.format(f_curve='f_curve')}), v AS (SELECT k, sample_id, idx, c1, CASE WHEN sample_id % 10 = 0 THEN c1 ELSE c2 END AS c2,"
              " CASE WHEN sample_id % 10 = 0 THEN c1 ELSE c3 END AS c3, CASE WHEN sample_id % 10 = 0 THEN c1 ELSE c4 END AS c4,"
              " CASE WHEN sample_id % 10 = 0 THEN c1 ELSE c5 END AS c5 FROM g JOIN u ON wkey = k)")
    + " UNION ALL ".join(
        f"SELECT {_UWI} AS uwi, '{n}' AS curve_id, sample_id, idx::DOUBLE AS index_value, round({_NUM.format(c)}, 4) AS measured_value FROM v"
        for n, c in (("CLICK", "c1"), ("VIEW", "c2"), ("BUY", "c3"), ("SIGN", "c4"), ("ERR", "c5"))
    ),
)
def las_curve_values(fx):
    return _las(fx).values().withColumn("measured_value", F.round("measured_value", 4))


@query(
    "las_parameters",
    f"WITH {_USERS} SELECT {_UWI} AS uwi, m[1]::INT AS seq_no, m[2] AS mnemonic, m[3] AS text_value, m[4] AS description FROM"
    " (SELECT k, unnest([['1', 'MUD', 'GEL : Mud', 'type'], ['2', 'BHT', cast(k AS string), 'Bottom hole']]) AS m FROM u)",
)
def las_parameters(fx):
    return _las(fx).parameters()
