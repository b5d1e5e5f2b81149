"""Hierarchical index: H keys."""

from pyspark.sql import functions as F

from treemend.catalog.registry import query
from treemend.fixtures import ACCESS, REGION_TREE, WELL_TREE, Fixtures, duck_with, tree_tables
from treemend.functions.docs import attr_number, attr_text, attributes, to_doc
from treemend.functions.geo import resolve_location
from treemend.operators import index as X
from treemend.plans.qc import flag_index
from treemend.model import Rule

BIG = "bigint"


def region_index(fx: Fixtures):
    return X.build_index(fx.spark, REGION_TREE, tree_tables(fx), ACCESS)


def well_index(fx: Fixtures, where: str | None = None):
    return X.build_index(fx.spark, WELL_TREE, tree_tables(fx), ACCESS, where)


def shape(df, *more):
    """Index columns in comparable form."""
    return df.select(
        X.path_text(F.col("node_path")).alias("path"), F.col("level").cast(BIG).alias("level"), "data_name", "data_type", "data_key",
        F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), *more,
    )


# The same tree by plain row numbers. {top} rows: wkey-less parents are written out per level.
_LEAVES = """
    logs AS (SELECT uwi, curve_id, count(*) AS n FROM f_curve GROUP BY uwi, curve_id),
    has_log AS (SELECT DISTINCT uwi FROM f_curve), has_pick AS (SELECT DISTINCT uwi FROM f_pick),
    well_nodes AS (
        SELECT w.*, CASE WHEN w.lat = -99999 THEN NULL ELSE w.lat END AS la, CASE WHEN w.lon = -99999 THEN NULL ELSE w.lon END AS lo,
               (hl.uwi IS NOT NULL) AS hl, (hp.uwi IS NOT NULL) AS hp
        FROM placed w LEFT JOIN has_log hl ON w.uwi = hl.uwi LEFT JOIN has_pick hp ON w.uwi = hp.uwi),
    log_groups AS (SELECT path || '1/' AS path, uwi FROM well_nodes WHERE hl),
    pick_groups AS (SELECT path || CASE WHEN hl THEN '2/' ELSE '1/' END AS path, uwi, la, lo FROM well_nodes WHERE hp),
    log_nodes AS (SELECT g.path || row_number() OVER (PARTITION BY l.uwi ORDER BY curve_id) || '/' AS path, l.* FROM logs l JOIN log_groups g ON l.uwi = g.uwi),
    pick_nodes AS (SELECT g.path || row_number() OVER (PARTITION BY p.uwi ORDER BY unit, interp) || '/' AS path, g.la, g.lo, p.*
                   FROM f_pick p JOIN pick_groups g ON p.uwi = g.uwi),
    leaf_rows AS (
        SELECT path, uwi AS data_name, 'WellBore' AS data_type, 'UWI = ''' || uwi || '''' AS data_key, la AS latitude, lo AS longitude, elev AS num FROM well_nodes
        UNION ALL SELECT path, 'Logs', 'Logs', NULL, NULL, NULL, NULL FROM log_groups
        UNION ALL SELECT path, 'MarkerPicks', 'MarkerPicks', NULL, NULL, NULL, NULL FROM pick_groups
        UNION ALL SELECT path, curve_id, 'Log', 'UWI = ''' || uwi || ''' AND CURVE_ID = ''' || curve_id || '''', NULL, NULL, n FROM log_nodes
        UNION ALL SELECT path, unit, 'MarkerPick', 'UWI = ''' || uwi || ''' AND STRAT_UNIT_ID = ''' || unit || ''' AND INTERP_ID = ''' || interp || '''', la, lo, depth FROM pick_nodes)"""
_IDX = """
    idx AS (SELECT path, CAST(length(path) - length(replace(path, '/', '')) - 1 AS BIGINT) AS level, data_name, data_type, data_key,
                   round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, num,
                   regexp_replace(path, '[0-9]+/$', '') AS parent FROM all_rows)"""
WELL_IDX = duck_with(
    "f_well", "f_pick", "f_curve",
    more=f"""
    placed AS (SELECT *, '/1/' || row_number() OVER (ORDER BY uwi) || '/' AS path FROM f_well), {_LEAVES},
    all_rows AS (SELECT '/' AS path, 'QCPROJECT' AS data_name, 'QCPROJECT' AS data_type, NULL AS data_key, NULL AS latitude, NULL AS longitude, NULL AS num
        UNION ALL SELECT '/1/', 'WellBores', 'WellBores', NULL, NULL, NULL, NULL
        UNION ALL SELECT * FROM leaf_rows), {_IDX}""",
)
REGION_IDX = duck_with(
    "f_well", "f_pick", "f_curve",
    more=f"""
    r AS (SELECT *, '/1/' || row_number() OVER (ORDER BY r_regionkey) || '/' AS path FROM region),
    n AS (SELECT nation.*, r.path || '1/' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || '/' AS path FROM nation JOIN r ON n_regionkey = r_regionkey),
    placed AS (SELECT w.*, n.path || '1/' || row_number() OVER (PARTITION BY nkey ORDER BY uwi) || '/' AS path FROM f_well w JOIN n ON nkey = n_nationkey), {_LEAVES},
    all_rows AS (SELECT '/' AS path, 'QCPROJECT' AS data_name, 'QCPROJECT' AS data_type, NULL AS data_key, NULL AS latitude, NULL AS longitude, NULL AS num
        UNION ALL SELECT '/1/', 'Regions', 'Regions', NULL, NULL, NULL, NULL
        UNION ALL SELECT path, r_name, 'Region', 'R_KEY = ''' || r_regionkey || '''', NULL, NULL, NULL FROM r
        UNION ALL SELECT path || '1/', 'Nations', 'Nations', NULL, NULL, NULL, NULL FROM r WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
        UNION ALL SELECT path, n_name, 'Nation', 'N_KEY = ''' || n_nationkey || '''', NULL, NULL, NULL FROM n
        UNION ALL SELECT path || '1/', 'WellBores', 'WellBores', NULL, NULL, NULL, NULL FROM n WHERE n_nationkey IN (SELECT nkey FROM f_well)
        UNION ALL SELECT * FROM leaf_rows), {_IDX}""",
)
COLS = "path, level, data_name, data_type, data_key, latitude, longitude"


def _payload():
    a = F.col("_a")
    return (
        F.when(F.col("data_type") == "MarkerPick", attr_number(a, "PICK_DEPTH"))
        .when(F.col("data_type") == "WellBore", attr_number(a, "DEPTH_DATUM_ELEV"))
        .when(F.col("data_type") == "Log", F.size(F.split(attr_text(a, "MEASURED_VALUE"), ",")).cast("double"))
    )


@query("build_index", REGION_IDX + f"SELECT {COLS}, round(CAST(num AS DOUBLE), 4) AS num FROM idx")
def build_index(fx):
    return shape(region_index(fx).withColumn("_a", attributes(F.col("doc"))), F.round(_payload(), 4).alias("num"))


@query(
    "build_index_filtered",
    WELL_IDX + ", keep AS (SELECT path AS old, '/1/' || row_number() OVER (ORDER BY data_name) || '/' AS top FROM idx"
    " WHERE data_type = 'WellBore' AND latitude >= 35)"
    " SELECT top || substr(path, length(old) + 1) AS path, data_name, data_type FROM idx JOIN keep ON starts_with(path, old)"
    " UNION ALL SELECT path, data_name, data_type FROM idx WHERE level < 2",
)
def build_index_filtered(fx):
    idx = well_index(fx, "SURFACE_LATITUDE >= 35")
    return idx.select(X.path_text(F.col("node_path")).alias("path"), "data_name", "data_type")


@query(
    "parent_key_join",
    duck_with("f_well", "f_pick") + "SELECT pkey, p.uwi, well_name FROM f_pick p JOIN f_well w ON p.uwi = w.uwi",
)
def parent_key_join(fx):
    wells = fx["f_well"].select(F.col("uwi").alias("UWI"), "well_name")
    picks = fx["f_pick"].select("pkey", F.col("uwi").alias("P_UWI"))
    node = REGION_TREE.find("MarkerPick")
    joined = X.join_children(wells, picks.withColumnRenamed("P_UWI", "UWI"), node)
    return joined.select("pkey", wells["UWI"].alias("uwi"), "well_name")


_PLACE = """
    SELECT c_custkey AS k,
           CASE c_custkey % 7 WHEN 0 THEN '-99999' WHEN 1 THEN '90' WHEN 2 THEN 'north' WHEN 3 THEN '-89.5' ELSE cast(c_custkey % 90 AS string) END AS lat,
           CASE c_custkey % 5 WHEN 0 THEN '-99999.0' WHEN 1 THEN '' ELSE cast(c_custkey % 400 AS string) END AS lon
    FROM {customer}"""


@query(
    "resolve_location",
    "SELECT c_custkey AS k, CASE WHEN ok THEN CASE WHEN c_custkey % 7 = 3 THEN -89.5 ELSE c_custkey % 90 END END::DOUBLE AS lat,"
    " CASE WHEN ok THEN c_custkey % 400 END::DOUBLE AS lon FROM (SELECT c_custkey, c_custkey % 7 NOT IN (0, 1, 2) AND c_custkey % 5 NOT IN (0, 1) AS ok FROM customer)",
)
def resolve_location_query(fx):
    lat, lon = resolve_location(F.col("lat"), F.col("lon"))
    return fx.spark.sql(_PLACE, customer=fx["customer"]).select("k", lat.alias("lat"), lon.alias("lon"))


@query(
    "descendants",
    REGION_IDX.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", tree AS (SELECT path, level FROM idx WHERE parent = '/1/2/' UNION ALL SELECT idx.path, idx.level FROM idx JOIN tree ON idx.parent = tree.path)"
    " SELECT path, level FROM tree",
)
def descendants(fx):
    below = X.descendants(region_index(fx), [1, 2])
    return below.select(X.path_text(F.col("node_path")).alias("path"), F.col("level").cast(BIG).alias("level"))


@query(
    "child_counts",
    REGION_IDX + "SELECT p.path, p.data_name, count(c.path) AS n_children FROM idx p LEFT JOIN idx c ON c.parent = p.path"
    " WHERE p.parent = '/1/1/1/' GROUP BY p.path, p.data_name",
)
def child_counts(fx):
    kids = X.child_counts(region_index(fx), [1, 1, 1])
    return kids.select(X.path_text(F.col("node_path")).alias("path"), "data_name", "n_children")


@query(
    "descendant_counts",
    REGION_IDX + "SELECT p.path, p.data_name, count(c.path) AS n_descendants FROM idx p LEFT JOIN idx c ON c.level > 4 AND"
    " array_to_string(list_slice(string_split(c.path, '/'), 1, 5), '/') || '/' = p.path WHERE p.level = 4 GROUP BY p.path, p.data_name",
)
def descendant_counts(fx):
    nodes = X.descendant_counts(region_index(fx), 4)
    return nodes.select(X.path_text(F.col("node_path")).alias("path"), "data_name", "n_descendants")


@query("index_by_ids", WELL_IDX + f"SELECT {COLS} FROM idx WHERE path IN ('/', '/1/', '/1/3/', '/1/10/1/', '/1/12/2/3/')")
def index_by_ids(fx):
    return shape(X.by_ids(well_index(fx), "/;/1/;/1/3/;/1/10/1/;/1/12/2/3/"))


C1 = Rule("C1", "WellBore", "Completeness", "Completeness", "DEPTH_DATUM_ELEV")
V1 = Rule("V1", "WellBore", "ValidityRange", "Validity", "DEPTH_DATUM_ELEV", "{MinRange:0, MaxRange:5000}")
C4 = Rule("C4", "MarkerPick", "Completeness", "Completeness", "PICK_DEPTH")
_FAILS_C1 = "data_type = 'WellBore' AND (num IS NULL OR num = -99999)"


def flagged_index(fx):
    return flag_index(well_index(fx), [C1, V1, C4])


@query("query_index", WELL_IDX + f"SELECT {COLS} FROM idx WHERE {_FAILS_C1}")
def query_index(fx):
    return shape(X.query_index(flagged_index(fx), "WellBore", "C1"))


@query("search_index", WELL_IDX + f"SELECT {COLS} FROM idx WHERE data_type = 'MarkerPick' AND data_name = '1-URGENT' AND num = -99999")
def search_index(fx):
    return shape(X.search_index(flagged_index(fx), data_name="1-URGENT", data_type="MarkerPick", flag="C4"))


@query("children_with_name", REGION_IDX + f"SELECT {COLS} FROM idx WHERE starts_with(path, '/1/2/') AND level > 2 AND data_name = '2-HIGH'")
def children_with_name(fx):
    return shape(X.children_with_name(region_index(fx), [1, 2], "2-HIGH"))


@query(
    "entirety_parents",
    WELL_IDX + "SELECT DISTINCT p.path, p.data_name FROM idx p JOIN idx c ON c.data_type = 'MarkerPick' AND c.data_name = '3-MEDIUM'"
    " AND '/' || split_part(c.path, '/', 2) || '/' || split_part(c.path, '/', 3) || '/' = p.path WHERE p.data_type = 'WellBore'",
)
def entirety_parents(fx):
    found = X.entirety_parents(well_index(fx), "MarkerPick", "3-MEDIUM", "WellBore", 2)
    return found.select(X.path_text(F.col("node_path")).alias("path"), "data_name")


# a new pick for every well without picks, and a second one for wells whose key is divisible by 4
_NEW = "(SELECT path, uwi, wkey, hl, hp FROM well_nodes WHERE NOT hp OR wkey % 4 = 0)"


@query(
    "insert_node",
    WELL_IDX + f""", picks AS (SELECT uwi, count(*) AS n FROM f_pick GROUP BY uwi),
    home AS (SELECT w.*, w.path || CASE WHEN hl THEN '2/' ELSE '1/' END AS grp, coalesce(n, 0) AS n FROM {_NEW} w LEFT JOIN picks USING (uwi)),
    added AS (SELECT grp || (n + 1) || '/' AS path, 'NEW-A' AS data_name, 'MarkerPick' AS data_type, uwi FROM home
              UNION ALL SELECT grp || (n + 2) || '/', 'NEW-B', 'MarkerPick', uwi FROM home WHERE wkey % 4 = 0
              UNION ALL SELECT grp, 'MarkerPicks', 'MarkerPicks', NULL FROM home WHERE NOT hp)
    SELECT path, data_name, data_type, CASE WHEN uwi IS NOT NULL THEN 'UWI = ''' || uwi || ''' AND STRAT_UNIT_ID = ''' || data_name || ''' AND INTERP_ID = ''I''' END AS data_key FROM added
    UNION ALL SELECT path, data_name, data_type, data_key FROM idx""",
)
def insert_node(fx):
    idx = well_index(fx)
    wells = idx.filter(F.col("data_type") == "WellBore").select("node_path", F.col("data_name").alias("uwi"))
    wells = wells.withColumn("wkey", F.substring("uwi", 2, 8).try_cast(BIG))
    picks = fx["f_pick"].select("uwi").distinct().withColumn("has", F.lit(True))
    wells = wells.join(picks, "uwi", "left").filter(F.col("has").isNull() | (F.col("wkey") % 4 == 0))

    def docs(rows, unit):
        doc = to_doc(F.col("uwi").alias("UWI"), F.lit(unit).alias("STRAT_UNIT_ID"), F.lit("I").alias("INTERP_ID"), F.lit(1.5).alias("PICK_DEPTH"))
        return rows.select(F.col("node_path").alias("parent_path"), doc.alias("doc"))

    inserts = docs(wells, "NEW-A").unionByName(docs(wells.filter(F.col("wkey") % 4 == 0), "NEW-B"))
    added = X.insert_docs(idx, inserts, WELL_TREE.find("MarkerPick"), ACCESS["MarkerPick"])
    return added.select(X.path_text(F.col("node_path")).alias("path"), "data_name", "data_type", "data_key")


@query(
    "delete_subtree",
    WELL_IDX + ", gone AS (SELECT path AS g FROM idx WHERE data_type = 'WellBore' AND latitude IS NULL),"
    " keyed AS (SELECT path, data_type, data_name, CASE WHEN level >= 2 THEN '/1/' || split_part(path, '/', 3) || '/' END AS w FROM idx)"
    " SELECT path, CASE WHEN g IS NULL AND data_type NOT IN ('WellBores', 'Logs', 'MarkerPicks') AND NOT (data_type = 'MarkerPick' AND data_name = '5-LOW') THEN 1 ELSE 0 END::BIGINT AS has_doc"
    " FROM keyed LEFT JOIN gone ON w = g",
)
def delete_subtree(fx):
    idx = well_index(fx)
    # ids on two levels: wells and picks
    wells = (F.col("data_type") == "WellBore") & F.col("latitude").isNull()
    ids = idx.filter(wells | ((F.col("data_type") == "MarkerPick") & (F.col("data_name") == "5-LOW")))
    out = X.delete_subtree(idx, ids)
    return out.select(X.path_text(F.col("node_path")).alias("path"), X.has_doc().cast(BIG).alias("has_doc"))


@query(
    "update_index",
    WELL_IDX + "SELECT path, data_name, data_type, data_key, CASE WHEN u THEN 'P7;P8' ELSE '' END AS qc, CASE WHEN data_type = 'MarkerPick' THEN CASE WHEN u THEN num * 2 ELSE num END END AS num FROM"
    " (SELECT *, data_type = 'MarkerPick' AND data_name = '5-LOW' AS u FROM idx)",
)
def update_index(fx):
    idx = well_index(fx)
    low = idx.filter((F.col("data_type") == "MarkerPick") & (F.col("data_name") == "5-LOW"))
    doc = to_doc((attr_number(attributes(F.col("doc")), "PICK_DEPTH") * 2).alias("PICK_DEPTH"))
    updates = low.select("node_path", doc.alias("doc"), F.array(F.lit("P7"), F.lit("P8")).alias("qc"))
    out = X.apply_updates(idx, updates)
    depth = F.when(F.col("data_type") == "MarkerPick", attr_number(attributes(F.col("doc")), "PICK_DEPTH"))
    return out.select(
        X.path_text(F.col("node_path")).alias("path"), "data_name", "data_type", "data_key", F.concat_ws(";", "qc").alias("qc"), depth.alias("num")
    )


@query("clear_flags", WELL_IDX + "SELECT data_type, count(*) AS n_nodes, 0::BIGINT AS n_flags FROM idx GROUP BY data_type")
def clear_flags(fx):
    out = X.clear_flags(flagged_index(fx))
    return out.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum(F.size("qc")), F.lit(0)).cast(BIG).alias("n_flags"))


@query(
    "project_split",
    WELL_IDX + "SELECT project, count(*) AS n_nodes FROM idx, (SELECT unnest(['', 'south', '007']) AS project) GROUP BY project",
)
def project_split(fx):
    from treemend.session import scratch_path

    idx = well_index(fx)
    path = scratch_path(fx.spark, "projects")
    # the default project, a name like a number, and two that go: one from the files, one from what is read
    X.save_projects(idx.unionByName(X.copy_project(idx, "old")), path)
    X.save_projects(X.copy_project(idx, "south").unionByName(X.copy_project(idx, "007")).unionByName(X.copy_project(idx, "north")), path)
    X.drop_stored_project(fx.spark, path, "old")
    return X.list_projects(X.drop_project(X.load_projects(fx.spark, path), "north"))
