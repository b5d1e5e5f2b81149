"""Predictions, curves and geometry: P keys."""

from pyspark.sql import functions as F

from treemend.catalog.registry import query
from treemend.catalog.rules import _FAILED, _FLAGS, ALL_RULES
from treemend.catalog.tree import C1, C4, V1, WELL_IDX, well_index
from treemend.fixtures import ACCESS, WELL_TREE, duck_with, flat_wells, pick_table, tree_tables
from treemend.functions.docs import attr_number, attr_text, attributes
from treemend.functions.values import lithology
from treemend.model import Rule
from treemend.operators import curves as C
from treemend.operators import index as X
from treemend.operators import repair as R
from treemend.operators.neighbors import idw
from treemend.operators.surface import map_points, surface_grid, surface_idw
from treemend.plans.predictions import run_predictions
from treemend.plans.qc import flag_index
from treemend.session import cut_lineage

BIG = "bigint"
TODAY = "2024-01-01"


def context():
    return R.Context(WELL_TREE, ACCESS, TODAY)


def predict(key, kind, function, fail, order=0, attribute="", params=""):
    return Rule(key, kind, function, "Predictions", attribute, params, fail_rule=fail, order=order)


def path():
    return X.path_text(F.col("node_path")).alias("path")


def flags():
    return F.concat_ws(";", "qc").alias("qc")


def flagged(fx):
    # as between the stages of a run
    return cut_lineage(flag_index(cut_lineage(well_index(fx), "data_type"), ALL_RULES, WELL_TREE, ACCESS), "data_type")


P_DELETE = predict("P1", "WellBore", "DeleteDataObject", "C2", 1)
P_ELEV = predict("P3", "WellBore", "PredictDepthUsingIDW", "C1", 10, "DEPTH_DATUM_ELEV")
P_RANGE = predict("P4", "WellBore", "PredictDepthUsingIDW", "V1", 12, "DEPTH_DATUM_ELEV")
P_CHILD = predict(
    "P9", "WellBore", "PredictMissingDataObjects", "E1", 4, "INDEXID",
    '{"DataType": "MarkerPick", "Keys": [{"Key": "UWI", "Value": "!UWI"}, {"Key": "STRAT_UNIT_ID", "Value": "3-MEDIUM"},'
    ' {"Key": "INTERP_ID", "Value": "UNKNOWN"}], "Defaults": [{"Default": "DOMINANT_LITHOLOGY", "Value": "UNKNOWN"}]}',
)


@query("select_failed", WELL_IDX + _FAILED + " SELECT path FROM fails WHERE rule_key = 'V1'")
def select_failed(fx):
    return R.select_failed(flagged(fx), P_RANGE).select(path())


_QC = _FAILED + ", qc AS (" + _FLAGS + ")"


@query(
    "predict_delete",
    WELL_IDX + _QC + ", gone AS (SELECT path AS g FROM fails WHERE rule_key = 'C2')"
    " SELECT qc.path, CASE WHEN g IS NULL THEN qc ELSE 'P1' END AS qc, CASE WHEN g IS NULL AND path NOT IN"
    " (SELECT path FROM idx WHERE data_type IN ('WellBores', 'Logs', 'MarkerPicks')) THEN 1 ELSE 0 END::BIGINT AS has_doc"
    " FROM qc LEFT JOIN gone ON '/1/' || split_part(path, '/', 3) || '/' = g AND path <> '/1/'",
)
def predict_delete(fx):
    out = R.predict_delete(flagged(fx), P_DELETE, context())
    return out.select(path(), flags(), X.has_doc().cast(BIG).alias("has_doc"))


_ORDER = "SELECT unit AS name, min(depth) AS min_depth, max(depth) AS max_depth, row_number() OVER (ORDER BY min(depth), unit) AS age FROM f_pick GROUP BY unit"


@query("formation_order", duck_with("f_pick") + f"SELECT name, round(min_depth, 4) AS min_depth, round(max_depth, 4) AS max_depth, age FROM ({_ORDER})")
def formation_order(fx):
    out = R.formation_order(well_index(fx), "MarkerPick")
    return out.select("name", F.round("min_depth", 4).alias("min_depth"), F.round("max_depth", 4).alias("max_depth"), F.col("age").cast(BIG).alias("age"))


@query(
    "predict_formation_order",
    WELL_IDX + f", o AS ({_ORDER}) SELECT path, CASE WHEN num = -99999 THEN age END AS age, CASE WHEN num = -99999 THEN"
    " ';ORDINAL_AGE_CODE predicted by QCEngine;' ELSE '' END AS remark, CASE WHEN num = -99999 THEN 'P2' ELSE '' END AS qc"
    " FROM idx JOIN o ON data_name = name WHERE data_type = 'MarkerPick'",
)
def predict_formation_order(fx):
    idx = cut_lineage(flag_index(well_index(fx), [C4]))
    rule = predict("P2", "MarkerPick", "PredictFormationOrder", "C4", 1, "ORDINAL_AGE_CODE", '{"DataType": "MarkerPick"}')
    out = R.predict_formation_order(idx, rule, context()).filter(F.col("data_type") == "MarkerPick")
    a = attributes(F.col("doc"))
    return out.select(path(), attr_number(a, "ORDINAL_AGE_CODE").cast(BIG).alias("age"), attr_text(a, "REMARK").alias("remark"), flags())


# ---------------------------------------------------------------- neighbours


def knn_sql(name, targets, candidates, k=24):
    """CTE ``name`` (tid, cid, n_lat, n_lon, depth, d, rn) by comparing every pair."""
    h = (
        "pow(sin(radians(c.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - t.lon) / 2), 2)"
    )
    return (
        f"{name}_p AS (SELECT t.wkey AS tid, c.wkey AS cid, c.lat AS n_lat, c.lon AS n_lon, c.elev AS depth,"
        f" 2 * 6371008.8 * asin(sqrt(least({h}, 1.0))) AS d FROM ({targets}) t JOIN ({candidates}) c ON t.wkey <> c.wkey),"
        f" {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY round(d, 6), cid) AS rn FROM {name}_p) WHERE rn <= {k})"
    )


def idw_sql(name, knn):
    return (
        f"{name} AS (SELECT tid, sum(depth / pow(d, 4)) / sum(1 / pow(d, 4)) AS value, count(*) AS n_used FROM (SELECT *,"
        f" abs(n_lat - lag(n_lat) OVER (PARTITION BY tid ORDER BY rn)) < 0.0001 AND abs(n_lon - lag(n_lon) OVER (PARTITION BY tid ORDER BY rn)) < 0.0001 AS twin"
        f" FROM {knn}) WHERE NOT coalesce(twin, false) AND d >= 0.1 AND depth IS NOT NULL AND depth <> -99999 GROUP BY tid HAVING count(*) > 2)"
    )


_LOCATED = "SELECT * FROM f_well WHERE lat <> -99999"
_C1 = "elev_state IN ('null', 'sentinel')"
_KNN = duck_with("f_well", more=knn_sql("k", f"{_LOCATED} AND {_C1}", f"{_LOCATED} AND NOT {_C1}"))


def flagged_wells(fx):
    return cut_lineage(flag_index(flat_wells(fx), [C1, V1]))


def wkey(column):
    return (F.element_at(column, 2) - 1).cast(BIG)


@query("knn_neighbors", _KNN + "SELECT tid, cid, rn AS rank, round(d, 2) AS distance FROM k")
def knn_neighbors(fx):
    near = R.knn_neighbors(flagged_wells(fx), P_ELEV)
    return near.select(wkey("tid").alias("tid"), wkey("cid").alias("cid"), F.col("rank").cast(BIG).alias("rank"), F.round("distance", 2).alias("distance"))


@query("idw_depth", _KNN + ", " + idw_sql("i", "k") + " SELECT tid, round(value, 3) AS value, n_used FROM i")
def idw_depth(fx):
    out = idw(R.knn_neighbors(flagged_wells(fx), P_ELEV))
    return out.select(wkey("tid").alias("tid"), F.round("value", 3).alias("value"), "n_used")


@query(
    "predict_depth_idw",
    _KNN + ", " + idw_sql("i", "k") + f""" SELECT wkey, round(coalesce(value, elev), 3) AS elev,
    CASE WHEN value IS NOT NULL THEN 'P3' WHEN {_C1} THEN CASE WHEN elev < 0 THEN 'C1;V1' ELSE 'C1' END WHEN elev < 0 OR elev > 5000 THEN 'V1' ELSE '' END
    || CASE WHEN value IS NOT NULL AND elev < 0 THEN ';V1' ELSE '' END AS qc,
    CASE WHEN value IS NOT NULL THEN ';DEPTH_DATUM_ELEV has been predicted by QCEngine;' ELSE '' END AS remark
    FROM f_well LEFT JOIN i ON wkey = tid""",
)
def predict_depth_idw(fx):
    out = R.predict_depth_idw(flagged_wells(fx), P_ELEV, context())
    a = attributes(F.col("doc"))
    return out.select(
        wkey("node_path").alias("wkey"), F.round(attr_number(a, "DEPTH_DATUM_ELEV"), 3).alias("elev"), flags(), attr_text(a, "REMARK").alias("remark")
    )


# ---------------------------------------------------------------- curves

_NULLED = "CASE WHEN (wkey + sample_id) % 19 = 0 THEN NULL ELSE measured_value END"
_HAT = f"""b AS (SELECT uwi, wkey, sample_id, index_value, {_NULLED} AS m, max(sample_id) OVER (PARTITION BY uwi) AS e FROM f_long_curve),
    v AS (SELECT *, CASE WHEN sample_id < e THEN m END AS x FROM b),
    h AS (SELECT uwi, wkey, sample_id, index_value, m, e, avg(x) OVER t AS ta, stddev_samp(x) OVER t AS ts, avg(x) OVER c AS ca, stddev_samp(x) OVER c AS cs,
                 avg(x) OVER l AS la, stddev_samp(x) OVER l AS ls FROM v
          WINDOW t AS (PARTITION BY uwi ORDER BY sample_id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING),
                 c AS (PARTITION BY uwi ORDER BY sample_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING),
                 l AS (PARTITION BY uwi ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING))"""
_SEG = _HAT + """, r AS (SELECT *, CASE WHEN cs = 0 THEN CASE WHEN ls > 0 THEN 1e300 END ELSE ls / cs END AS ratio FROM h),
    cut AS (SELECT uwi, avg(ratio) + 2 * stddev_samp(ratio) AS lim, max(coalesce(ratio, 0)) >= 1e300 AS inf FROM r GROUP BY uwi),
    sg AS (SELECT r.*, sum(CASE WHEN NOT inf AND ratio > lim THEN 1 ELSE 0 END) OVER (PARTITION BY uwi ORDER BY sample_id)::BIGINT AS segment FROM r JOIN cut USING (uwi))"""
_SMOOTH = _SEG + """, mn AS (SELECT uwi, segment, avg(CASE WHEN sample_id < e THEN m END) AS mean FROM sg GROUP BY uwi, segment),
    sm AS (SELECT sg.uwi, sg.wkey, sample_id, index_value, e, sg.segment, CASE WHEN sample_id < e AND min(sg.segment) OVER (PARTITION BY sg.uwi) = 0 THEN mean END AS smoothed
           FROM sg JOIN mn ON sg.uwi = mn.uwi AND sg.segment = mn.segment)"""


def long_curves(fx):
    return fx["f_long_curve"].select("uwi", "wkey", "sample_id", "index_value", F.expr(_NULLED).alias("m"))


_R = ", ".join(f"round({a}, 4) AS {b}" for a, b in (
    ("ta", "trailing_avg"), ("ts", "trailing_std"), ("ca", "centred_avg"), ("cs", "centred_std"), ("la", "leading_avg"), ("ls", "leading_std")))


@query("hat_window_stats", duck_with("f_long_curve", more=_HAT) + f"SELECT uwi, sample_id, {_R} FROM h")
def hat_window_stats(fx):
    out = C.hat_stats(long_curves(fx), ["uwi"], "sample_id", "m")
    names = [f"{n}_{k}" for n in ("trailing", "centred", "leading") for k in ("avg", "std")]
    return out.select("uwi", "sample_id", *[F.round(n, 4).alias(n) for n in names])


@query("curve_segments", duck_with("f_long_curve", more=_SEG) + "SELECT uwi, sample_id, segment FROM sg")
def curve_segments(fx):
    out = C.segments(long_curves(fx), ["uwi"], "sample_id", "m")
    return out.select("uwi", "sample_id", F.col("segment").cast(BIG).alias("segment"))


@query("curve_smooth", duck_with("f_long_curve", more=_SMOOTH) + "SELECT uwi, sample_id, round(smoothed, 4) AS smoothed FROM sm")
def curve_smooth(fx):
    out = C.smooth(long_curves(fx), ["uwi"], "sample_id", "m")
    return out.select("uwi", "sample_id", F.round("smoothed", 4).alias("smoothed"))


_DEPTH = "CASE WHEN o_orderkey % 13 = 0 THEN cast(-99999 AS double) ELSE cast(o_orderkey % 700 AS double) / 20 END"
_SHALLOW = f"pk AS (SELECT o_orderkey AS pkey, concat('W', lpad(cast(o_custkey AS string), 8, '0')) AS uwi, {_DEPTH} AS depth FROM orders)"
_FOUND = (
    "nx AS (SELECT uwi, sample_id, index_value, lead(index_value) OVER (PARTITION BY uwi ORDER BY sample_id) AS nxt FROM f_long_curve),"
    " found AS (SELECT pkey, pk.uwi, depth, min(sample_id) AS pos FROM pk LEFT JOIN nx ON pk.uwi = nx.uwi"
    " AND ((depth >= index_value AND depth < nxt) OR (nxt IS NULL AND depth = index_value)) GROUP BY pkey, pk.uwi, depth)"
)


@query("pick_sample_lookup", duck_with("f_long_curve", more=_SHALLOW + ", " + _FOUND) + "SELECT pkey, pos FROM found")
def pick_sample_lookup(fx):
    picks = fx["orders"].select(
        F.col("o_orderkey").alias("pkey"), F.expr("concat('W', lpad(cast(o_custkey AS string), 8, '0'))").alias("uwi"), F.expr(_DEPTH).alias("depth")
    )
    samples = fx["f_long_curve"].select("uwi", "sample_id", "index_value")
    out = C.sample_lookup(picks, samples, ["uwi"], "depth", "index_value", "sample_id")
    return out.select("pkey", F.col("sample_id").alias("pos"))


_ROCK = (
    "CASE WHEN {0} >= 0 AND {0} < 10 THEN 'Salt' WHEN {0} >= 10 AND {0} < 20 THEN 'Limestone' WHEN {0} >= 20 AND {0} < 55 THEN 'Sandstone'"
    " WHEN {0} >= 55 AND {0} < 150 THEN 'Shale' ELSE 'Unknown' END"
)


@query("lithology_class", f"SELECT p_partkey, {_ROCK.format('v')} AS rock FROM (SELECT p_partkey, p_partkey % 180 - 10 + p_size % 2 * 0.5 AS v FROM part)")
def lithology_class(fx):
    value = F.col("p_partkey") % 180 - 10 + F.col("p_size") % 2 * 0.5
    return fx["part"].select("p_partkey", lithology(value).alias("rock"))


_SMOOTH_PLAIN = _SMOOTH.replace(_NULLED, "measured_value")


@query(
    "predict_lithology",
    duck_with("f_long_curve", more=_SHALLOW + ", " + _FOUND + ", " + _SMOOTH_PLAIN)
    + f"SELECT pkey, CASE WHEN c THEN {_ROCK.format('s')} ELSE 'UNKNOWN' END AS rock, CASE WHEN c THEN 'P6' ELSE 'R1' END AS qc FROM"
    " (SELECT pkey, CASE WHEN pos IS NOT NULL THEN coalesce(smoothed, 0) END AS s, depth <> -99999 AND f.uwi IN (SELECT uwi FROM f_long_curve) AS c"
    " FROM found f LEFT JOIN sm ON f.uwi = sm.uwi AND f.pos = sm.sample_id)",
)
def predict_lithology(fx):
    tables = tree_tables(fx, "f_long_curve")
    key = F.substring("INTERP_ID", 2, 9).cast(BIG)
    depth = F.when(key % 13 == 0, -99999.0).otherwise((key % 700).cast("double") / 20)
    tables["STRAT_WELL_SECTION"] = pick_table(fx).withColumn("PICK_DEPTH", depth)
    idx = X.build_index(fx.spark, WELL_TREE, tables, ACCESS)
    rock = Rule("R1", "MarkerPick", "IsEqualTo", "Validity", "DOMINANT_LITHOLOGY", '{"Value": "Salt,Limestone,Sandstone,Shale"}')
    rule = predict("P6", "MarkerPick", "PredictDominantLithology", "R1", 1, "DOMINANT_LITHOLOGY")
    out = R.predict_lithology(cut_lineage(flag_index(idx, [rock])), rule, context()).filter(F.col("data_type") == "MarkerPick")
    a = attributes(F.col("doc"))
    return out.select(
        F.substring(attr_text(a, "INTERP_ID"), 2, 9).cast(BIG).alias("pkey"), attr_text(a, "DOMINANT_LITHOLOGY").alias("rock"), flags()
    )


@query(
    "predict_log_depths",
    duck_with("f_curve") + "SELECT uwi, curve_id, min(index_value) AS low, max(index_value) AS high, 'P8;P7' AS qc,"
    " ';MIN_INDEX was calculated from curve array;;MAX_INDEX was calculated from curve array;' AS remark FROM f_curve GROUP BY uwi, curve_id",
)
def predict_log_depths(fx):
    c6 = Rule("C6", "Log", "Completeness", "Completeness", "MIN_INDEX")
    c7 = Rule("C7", "Log", "Completeness", "Completeness", "MAX_INDEX")
    from treemend.fixtures import flat_curves

    idx = flag_index(flat_curves(fx), [c6, c7])
    out = R.predict_log_depths(idx, predict("P8", "Log", "PredictLogDepthAttributes", "C6", 14, "MIN_INDEX"), context())
    out = R.predict_log_depths(out, predict("P7", "Log", "PredictLogDepthAttributes", "C7", 16, "MAX_INDEX"), context())
    a = attributes(F.col("doc"))
    return out.select(
        attr_text(a, "UWI").alias("uwi"), attr_text(a, "CURVE_ID").alias("curve_id"), attr_number(a, "MIN_INDEX").alias("low"),
        attr_number(a, "MAX_INDEX").alias("high"), flags(), attr_text(a, "REMARK").alias("remark"),
    )


@query(
    "predict_missing_children",
    WELL_IDX + _QC + """, picks AS (SELECT uwi, count(*) AS n FROM f_pick GROUP BY uwi),
    home AS (SELECT w.*, path || CASE WHEN hl THEN '2/' ELSE '1/' END AS grp, coalesce(n, 0) AS n FROM well_nodes w LEFT JOIN picks USING (uwi)
             WHERE path IN (SELECT path FROM fails WHERE rule_key = 'E1'))
    SELECT qc.path, replace(qc, 'E1', 'P9') AS qc, NULL AS data_key, NULL AS depth, NULL AS remark FROM qc
    UNION ALL SELECT grp, '', NULL, NULL, NULL FROM home WHERE NOT hp
    UNION ALL SELECT grp || (n + 1) || '/', '', 'UWI = ''' || uwi || ''' AND STRAT_UNIT_ID = ''3-MEDIUM'' AND INTERP_ID = ''UNKNOWN''', -99999.0::DOUBLE,
                     'Has been predicted and created by QCEngine' FROM home""",
)
def predict_missing_children(fx):
    out = R.predict_missing_children(flagged(fx), P_CHILD, context())
    a = attributes(F.col("doc"))
    made = attr_text(a, "REMARK").startswith("Has been")
    return out.select(
        path(), flags(), F.when(made, F.col("data_key")).alias("data_key"), F.when(made, attr_number(a, "PICK_DEPTH")).alias("depth"),
        F.when(made, attr_text(a, "REMARK")).alias("remark"),
    )


@query("flag_transition", WELL_IDX + _QC + " SELECT path, CASE WHEN path LIKE '%0/' THEN replace(qc, 'V1', 'P4') ELSE qc END AS qc FROM qc")
def flag_transition(fx):
    idx = flagged(fx)
    ids = R.select_failed(idx, P_RANGE).filter(F.element_at("node_path", -1) % 10 == 0)
    return R.mark_repaired(idx, P_RANGE, ids).select(path(), flags())


_RUN = duck_with(
    "f_well",
    more=knn_sql("k1", f"{_LOCATED} AND {_C1}", f"{_LOCATED} AND NOT {_C1}") + ", " + idw_sql("i1", "k1")
    + f""", w1 AS (SELECT wkey, lat, lon, {_C1} AS c1, elev < 0 OR elev > 5000 AS v1, value IS NOT NULL AS p3, coalesce(value, elev) AS elev
               FROM f_well LEFT JOIN i1 ON wkey = tid WHERE lat <> -99999), """
    + knn_sql("k2", "SELECT * FROM w1 WHERE v1", "SELECT * FROM w1 WHERE NOT coalesce(v1, false)") + ", " + idw_sql("i2", "k2"),
)


@query(
    "run_predictions",
    _RUN + "SELECT wkey, round(coalesce(value, elev), 2) AS elev, concat_ws(';', CASE WHEN p3 THEN 'P3' WHEN c1 THEN 'C1' END,"
    " CASE WHEN value IS NOT NULL THEN 'P4' WHEN v1 THEN 'V1' END) AS qc FROM w1 LEFT JOIN i2 ON wkey = tid"
    " UNION ALL SELECT wkey, NULL, 'P1' FROM f_well WHERE lat = -99999",
)
def run_predictions_query(fx):
    c2 = Rule("C2", "WellBore", "Completeness", "Completeness", "SURFACE_LATITUDE")
    idx = cut_lineage(flag_index(flat_wells(fx), [C1, V1, c2]))
    out, _ = run_predictions(idx, [P_RANGE, P_ELEV, P_DELETE], context())
    a = attributes(F.col("doc"))
    return out.select(wkey("node_path").alias("wkey"), F.round(attr_number(a, "DEPTH_DATUM_ELEV"), 2).alias("elev"), flags())


# ---------------------------------------------------------------- maps

_POINTS = "pts AS (SELECT wkey, lat, lon, elev AS z FROM f_well WHERE lat <> -99999 AND elev <> -99999)"
_GRID = _POINTS + """, box AS (SELECT min(lat) AS x0, max(lat) AS x1, min(lon) AS y0, max(lon) AS y1, greatest((max(lat) - min(lat)) / 20, (max(lon) - min(lon)) / 20) AS step
    FROM pts HAVING count(*) >= 6),
    dims AS (SELECT *, ceil(round((x1 - x0) / step, 9))::INT AS nx, ceil(round((y1 - y0) / step, 9))::INT AS ny FROM box),
    grid AS (SELECT i, j, x0 + CASE WHEN nx > 1 THEN step * nx / (nx - 1) ELSE 0 END * i AS lat, y0 + CASE WHEN ny > 1 THEN step * ny / (ny - 1) ELSE 0 END * j AS lon
    FROM dims, (SELECT unnest(range(20)) AS i) a, (SELECT unnest(range(20)) AS j) b WHERE i < nx AND j < ny)"""


def _map_points(fx):
    points = map_points(flat_wells(fx), "WellBore", z="DEPTH_DATUM_ELEV")
    return points.withColumn("pid", wkey("node_path"))


@query("map_points", duck_with("f_well") + "SELECT wkey, lat, lon FROM f_well WHERE lat <> -99999")
def map_points_query(fx):
    return map_points(flat_wells(fx), "WellBore").select(wkey("node_path").alias("wkey"), "lat", "lon")


@query("surface_grid", duck_with("f_well", more=_GRID) + "SELECT i::INT AS i, j::INT AS j, round(lat, 5) AS lat, round(lon, 5) AS lon FROM grid")
def surface_grid_query(fx):
    return surface_grid(_map_points(fx)).select("i", "j", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query(
    "surface_idw",
    duck_with("f_well", more=_GRID + """, d AS (SELECT i, j, wkey, z, sqrt(pow(g.lat - p.lat, 2) + pow(g.lon - p.lon, 2)) AS dist FROM grid g, pts p),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY round(dist, 9), wkey) AS rn FROM d) WHERE rn <= 5)""")
    + "SELECT i::INT AS i, j::INT AS j, round(coalesce(min(CASE WHEN dist = 0 THEN z END), sum(CASE WHEN dist > 0 THEN z / pow(dist, 2) END) / sum(CASE WHEN dist > 0 THEN 1 / pow(dist, 2) END)), 3) AS value"
    " FROM near GROUP BY i, j",
)
def surface_idw_query(fx):
    points = _map_points(fx)
    out = surface_idw(surface_grid(points), points)
    return out.select("i", "j", F.round("value", 3).alias("value"))


