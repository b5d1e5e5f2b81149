"""Reports, edits and duplicates (R keys) and the whole run (G key)."""

from pyspark.sql import functions as F

from treemend.catalog.registry import query
from treemend.catalog.repair import _RUN, P_DELETE, P_ELEV, P_RANGE, flags, path, predict
from treemend.catalog.rules import _FAILED, _FLAGS, ALL_RULES, E1
from treemend.catalog.tree import C1, C4, V1, WELL_IDX, well_index
from treemend.fixtures import ACCESS, WELL_TREE, duck_with, pick_table, tree_tables, well_table
from treemend.functions.docs import attr_number, attr_text, attributes, to_doc
from treemend.model import AccessDef, Rule, Taxonomy, TypeNode
from treemend.operators import duplicates as DU
from treemend.operators import edits as E
from treemend.operators import index as X
from treemend.operators.merge import merge_duplicates as fold_duplicates
from treemend.operators.reports import failure_counts, failure_list
from treemend.plans.end_to_end import run_all
from treemend.plans.files import tables_from_files
from treemend.plans.qc import flag_index
from treemend.session import cut_lineage

BIG = "bigint"
IDLE = Rule("V9", "WellBore", "ValidityRange", "Validity", "SURFACE_LATITUDE", '{"MinRange": -99999, "MaxRange": 90}')


def flagged(fx, rules=ALL_RULES):
    return cut_lineage(flag_index(cut_lineage(well_index(fx), "data_type"), rules, WELL_TREE, ACCESS), "data_type")


_LIST = "(VALUES (1, 'C1', 'WellBore'), (2, 'V1', 'WellBore'), (3, 'C2', 'WellBore'), (4, 'C4', 'MarkerPick'), (5, 'E1', 'WellBore'), (6, 'V9', 'WellBore')) r(rule_id, rule_key, data_type)"


@query(
    "failure_counts",
    WELL_IDX + _FAILED + f" SELECT r.*, count(path) AS n_failed FROM {_LIST} LEFT JOIN fails f ON f.rule_key = r.rule_key GROUP BY ALL",
)
def failure_counts_query(fx):
    rules = [*ALL_RULES, IDLE]
    return failure_counts(flagged(fx, rules), rules)


_UNIQ = "SELECT *, upper(replace(translate(p_name, ' ', ''), '&', 'AND')) || p_brand AS kt, count(*) OVER (PARTITION BY upper(replace(translate(p_name, ' ', ''), '&', 'AND')) || p_brand) AS n FROM part"
U1 = Rule("U1", "Part", "Uniqueness", "Uniqueness", "NAME", "*NORMALIZE(NAME); BRAND")


def part_index(fx):
    p = fx["part"]
    doc = to_doc(F.col("p_partkey").alias("ID"), F.col("p_name").alias("NAME"), F.col("p_brand").alias("BRAND"), F.lit("").alias("REMARK"))
    return p.select(
        F.array(F.lit(1), (F.col("p_partkey") + 1).cast("int")).alias("node_path"), F.lit(2).alias("level"),
        F.array(F.lit(1)).alias("parent_path"), F.col("p_name").alias("data_name"), F.lit("Part").alias("data_type"),
        F.concat(F.lit("ID = '"), F.col("p_partkey").cast("string"), F.lit("'")).alias("data_key"), doc.alias("doc"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.array().cast("array<string>").alias("qc"), F.lit("").alias("project"),
    )


@query("failure_list", f"SELECT p_partkey, p_name AS data_name, 'ID = ''' || p_partkey || '''' AS data_key, sha256(kt) AS uniq_key FROM ({_UNIQ}) WHERE n > 1")
def failure_list_query(fx):
    out = failure_list(flag_index(part_index(fx), [U1]), U1)
    return out.select((F.element_at("node_path", 2) - 1).cast(BIG).alias("p_partkey"), "data_name", "data_key", "uniq_key")


@query(
    "edit_attribute",
    WELL_IDX + _FAILED + ", qc AS (" + _FLAGS + """)
    SELECT qc.path, CASE WHEN k % 3 = 0 AND qc LIKE '%C1%' THEN replace(replace(qc, 'C1;', ''), 'C1', '') ELSE qc END AS qc,
           CASE WHEN k % 3 = 0 AND qc LIKE '%C1%' THEN 100.5::DOUBLE + k END AS elev,
           CASE WHEN k % 3 = 0 AND qc LIKE '%C1%' THEN ';DEPTH_DATUM_ELEV has been manually edited;' || CASE WHEN k % 2 = 0 THEN ';OPERATOR has been manually edited;' ELSE '' END END AS remark,
           CASE WHEN k % 6 = 0 AND qc LIKE '%C1%' THEN 'op ' || k END AS operator
    FROM qc LEFT JOIN (SELECT path AS wp, CAST(substr(data_name, 2) AS BIGINT) AS k FROM idx WHERE data_type = 'WellBore') w ON qc.path = wp""",
)
def edit_attribute(fx):
    idx = flagged(fx)
    wells = idx.filter(F.array_contains("qc", "C1")).withColumn("k", F.substring("data_name", 2, 8).try_cast(BIG)).filter(F.col("k") % 3 == 0)
    edits = wells.select(
        "node_path", F.lit("DEPTH_DATUM_ELEV").alias("column_name"), F.lit("number").alias("column_type"), (F.col("k") + 100.5).cast("double").alias("number_value"),
        F.lit(None).cast("string").alias("text_value"), F.lit("C1").alias("rule_key"), F.lit(1).alias("edit_no"), "k",
    )
    # every other record has a second edit
    second = edits.filter(F.col("k") % 2 == 0).select(
        "node_path", F.lit("OPERATOR").alias("column_name"), F.lit("text").alias("column_type"), F.lit(None).cast("double").alias("number_value"),
        F.concat(F.lit("op "), F.col("k").cast("string")).alias("text_value"), F.lit(None).cast("string").alias("rule_key"), F.lit(2).alias("edit_no"), "k",
    )
    out = E.apply_edits(idx, edits.unionByName(second))
    a = attributes(F.col("doc"))
    edited = attr_text(a, "REMARK").contains("manually")
    return out.select(
        path(), flags(), F.when(edited, attr_number(a, "DEPTH_DATUM_ELEV")).alias("elev"), F.when(edited, attr_text(a, "REMARK")).alias("remark"),
        F.when(attr_text(a, "REMARK").contains("OPERATOR has been"), attr_text(a, "OPERATOR")).alias("operator"),
    )


@query(
    "insert_child_edit",
    WELL_IDX + _FAILED + ", qc AS (" + _FLAGS + """), picks AS (SELECT uwi, count(*) AS n FROM f_pick GROUP BY uwi),
    home AS (SELECT w.path, w.uwi, hp, w.path || CASE WHEN hl THEN '2/' ELSE '1/' END AS grp, coalesce(n, 0) AS n FROM well_nodes w LEFT JOIN picks USING (uwi)
             WHERE w.path IN (SELECT path FROM fails WHERE rule_key = 'E1') AND wkey % 2 = 0)
    SELECT path, CASE WHEN path IN (SELECT path FROM home) THEN replace(replace(qc, ';E1', ''), 'E1', '') ELSE qc END AS qc, NULL AS data_key FROM qc
    UNION ALL SELECT grp, '', NULL FROM home WHERE NOT hp
    UNION ALL SELECT grp || (n + 1) || '/', '', 'UWI = ''' || uwi || ''' AND STRAT_UNIT_ID = ''3-MEDIUM'' AND INTERP_ID = ''UNKNOWN''' FROM home""",
)
def insert_child_edit(fx):
    idx = flagged(fx)
    parents = idx.filter(F.array_contains("qc", "E1") & (F.substring("data_name", 2, 8).try_cast(BIG) % 2 == 0))
    out = E.insert_children(idx, parents, E1, WELL_TREE, ACCESS["MarkerPick"], "2024-01-01")
    made = attr_text(attributes(F.col("doc")), "INTERP_ID") == "UNKNOWN"
    return out.select(path(), flags(), F.when(made, F.col("data_key")).alias("data_key"))


# parts with the same key merge into the lowest; their suppliers' lines are the children
LINE = AccessDef("Line", "LINES", ("ID", "TAG"), {"ID": "string", "TAG": "string", "QTY": "number"})
PART = AccessDef("Part", "PARTS", ("ID",), {"ID": "string", "NAME": "string", "BRAND": "string"})
ITEM = AccessDef("Item", "ITEMS", ("ID", "TAG", "FLAG"), {"ID": "string", "TAG": "string", "FLAG": "string", "TAX": "number"})
PART_TREE = Taxonomy((TypeNode("Part", "NAME", children=(TypeNode("Line", "TAG", parent_key="ID = [ID]", children=(TypeNode("Item", "FLAG", parent_key="ID = [ID], TAG = [TAG]"),)),)),))
_ITEMS = """SELECT l_partkey AS pk, concat('T', cast(l_suppkey % 7 AS string)) AS tag, l_returnflag AS flag, max(l_tax) AS tax FROM {lineitem}
    GROUP BY l_partkey, concat('T', cast(l_suppkey % 7 AS string)), l_returnflag"""
_LINES = """SELECT l_partkey AS pk, concat('T', cast(l_suppkey % 7 AS string)) AS tag, sum(l_quantity) AS qty FROM {lineitem}
    GROUP BY l_partkey, concat('T', cast(l_suppkey % 7 AS string))"""


@query(
    "merge_duplicates",
    # records of one name below one merged record become one, the lowest part's, on both levels
    f"""WITH lines AS ({_LINES.format(lineitem='lineitem')}), items AS ({_ITEMS.format(lineitem='lineitem')}),
    k AS ({_UNIQ}), m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY kt) AS home FROM k)
    SELECT DISTINCT 'Part' AS data_type, home AS id, NULL AS tag, NULL AS flag, NULL::DOUBLE AS qty, '' AS qc FROM m
    UNION ALL SELECT 'Line', home, tag, NULL, arg_min(qty, pk), '' FROM lines JOIN m ON pk = p_partkey GROUP BY home, tag
    UNION ALL SELECT 'Item', home, tag, flag, arg_min(tax, pk), '' FROM items JOIN m ON pk = p_partkey GROUP BY home, tag, flag""",
)
def merge_duplicates(fx):
    parts = fx["part"].select(F.col("p_partkey").alias("ID"), F.col("p_name").alias("NAME"), F.col("p_brand").alias("BRAND"))
    lines = fx.spark.sql(_LINES, lineitem=fx["lineitem"]).select(F.col("pk").alias("ID"), F.col("tag").alias("TAG"), F.col("qty").alias("QTY"))
    items = fx.spark.sql(_ITEMS, lineitem=fx["lineitem"]).select(F.col("pk").alias("ID"), F.col("tag").alias("TAG"), F.col("flag").alias("FLAG"), F.col("tax").alias("TAX"))
    access = {"Part": PART, "Line": LINE, "Item": ITEM}
    idx = X.build_index(fx.spark, PART_TREE, {"PARTS": parts, "LINES": lines, "ITEMS": items}, access)
    idx = cut_lineage(flag_index(idx, [U1], PART_TREE, access))
    failing = idx.filter(F.array_contains("qc", "U1"))
    a = attributes(F.col("doc"))
    from treemend.operators.set_rules import uniq_key

    survivors = failing.groupBy(uniq_key(a, U1.params).alias("k")).agg(F.min("node_path").alias("node_path"))
    out = fold_duplicates(idx, survivors, U1, PART_TREE, access)
    live = out.filter(F.col("data_type").isin("Part", "Line", "Item") & X.has_doc())
    return live.select(
        "data_type", attr_text(a, "ID").try_cast(BIG).alias("id"), F.try_element_at(a, F.lit("TAG")).alias("tag"), F.try_element_at(a, F.lit("FLAG")).alias("flag"),
        F.coalesce(attr_number(a, "QTY"), attr_number(a, "TAX")).alias("qty"), flags(),
    )


@query("mark_duplicates", duck_with("f_wells_dup") + "SELECT uwi, ukey, valid, CASE WHEN count(*) OVER (PARTITION BY ukey) > 1 THEN 'Y' END AS dup FROM f_wells_dup")
def mark_duplicates(fx):
    return DU.mark_duplicates(fx["f_wells_dup"], "ukey")


_CURVES = "SELECT l_partkey AS uwi, concat('S', cast(l_suppkey % 9 AS string)) AS curve_id, count(*) AS n FROM {lineitem} GROUP BY l_partkey, concat('S', cast(l_suppkey % 9 AS string))"


@query(
    "fix_duplicate_curves",
    duck_with("f_wells_dup", more=f"""c AS ({_CURVES.format(lineitem='lineitem')}),
    h AS (SELECT c.*, ukey, valid, count(*) OVER (PARTITION BY ukey, curve_id) AS cnt FROM c JOIN f_wells_dup USING (uwi)),
    g AS (SELECT ukey, min(CASE WHEN valid = 'Y' THEN uwi END) AS good FROM f_wells_dup GROUP BY ukey HAVING count(*) > 1),
    f AS (SELECT CASE WHEN valid = 'N' THEN coalesce(good, uwi) ELSE uwi END AS uwi, curve_id, n FROM h LEFT JOIN g USING (ukey) WHERE NOT (valid = 'N' AND cnt > 1))""")
    + "SELECT 'curve' AS kind, uwi, curve_id, n FROM f UNION ALL SELECT 'sample', uwi, curve_id, n * 10 FROM f",
)
def fix_duplicate_curves(fx):
    curves = fx.spark.sql(_CURVES, lineitem=fx["lineitem"])
    samples = curves.withColumn("n", F.col("n") * 10)
    fixed, moved = DU.fix_duplicate_curves(curves, samples, fx["f_wells_dup"])
    return fixed.select(F.lit("curve").alias("kind"), "*").unionByName(moved.select(F.lit("sample").alias("kind"), "*"))


@query(
    "delete_duplicate_wells",
    duck_with("f_wells_dup") + "SELECT p_partkey AS uwi, p_name FROM part WHERE p_partkey NOT IN (SELECT uwi FROM f_wells_dup WHERE valid = 'N')",
)
def delete_duplicate_wells(fx):
    wells = fx["part"].select(F.col("p_partkey").alias("uwi"), "p_name")
    return DU.delete_duplicate_wells(wells, DU.mark_duplicates(fx["f_wells_dup"], "ukey"))


# ---------------------------------------------------------------- the whole run

C2 = Rule("C2", "WellBore", "Completeness", "Completeness", "SURFACE_LATITUDE")
C6 = Rule("C6", "Log", "Completeness", "Completeness", "MIN_INDEX")
RUN_RULES = [
    C1, V1, C2, C4, C6, P_DELETE, P_ELEV, P_RANGE,
    predict("P5", "MarkerPick", "DeleteDataObject", "C4", 6),
    predict("P8", "Log", "PredictLogDepthAttributes", "C6", 14, "MIN_INDEX"),
]
# in the tree a well without elevation is a JSON null, so the flat states null/absent/text count as missing
_TREE_RUN = _RUN.replace("elev_state IN ('null', 'sentinel')", "(elev IS NULL OR elev = -99999)")


_RUN_COUNTS = _TREE_RUN + """, fin AS (SELECT w1.*, coalesce(value, w1.elev) AS e FROM w1 LEFT JOIN i2 ON wkey = tid), all_w AS (SELECT * FROM f_well),
    c AS (SELECT user_id, event_type FROM events GROUP BY ALL),
    p AS (SELECT o_orderkey % 13 = 0 AS bad FROM orders)
    SELECT 'C1' AS rule_key, (SELECT count(*) FROM all_w WHERE elev IS NULL OR elev = -99999) AS n_before, (SELECT count(*) FROM fin WHERE e IS NULL OR e = -99999) AS n_after
    UNION ALL SELECT 'V1', (SELECT count(*) FROM all_w WHERE elev < 0 OR elev > 5000), (SELECT count(*) FROM fin WHERE e < 0 OR e > 5000)
    UNION ALL SELECT 'C2', (SELECT count(*) FROM all_w WHERE lat = -99999), 0
    UNION ALL SELECT 'C4', (SELECT count(*) FROM p WHERE bad), 0
    UNION ALL SELECT 'C6', (SELECT count(*) FROM c WHERE concat('W', lpad(cast(user_id AS string), 8, '0')) IN (SELECT uwi FROM all_w)), 0"""


@query("end_to_end_run", _RUN_COUNTS)
def end_to_end_run(fx):
    out = run_all(fx.spark, tree_tables(fx), WELL_TREE, ACCESS, RUN_RULES, today="2024-01-01")
    return out.counts.select("rule_key", "n_before", "n_after")


# curves of accepted LAS files whose well has its own key
_LAS_COUNTS = _RUN_COUNTS.replace(
    "(SELECT count(*) FROM c WHERE concat('W', lpad(cast(user_id AS string), 8, '0')) IN (SELECT uwi FROM all_w))",
    "(SELECT 5 * count(DISTINCT user_id) FROM c WHERE concat('W', lpad(cast(user_id AS string), 8, '0')) IN (SELECT uwi FROM all_w)"
    " AND user_id % 13 > 0 AND user_id % 17 > 0 AND user_id % 19 > 0 AND user_id % 7 > 0 AND user_id % 11 > 0)",
)


@query("files_to_run", _LAS_COUNTS)
def files_to_run(fx):
    """Wells and picks from CSV, curves from LAS, then index, rules and repairs."""
    from treemend.catalog.files import _las_folder, _rfc_csv

    def places(df):
        return "; ".join(f"{c}={i}" for i, c in enumerate(df.columns))

    wells, picks = well_table(fx), pick_table(fx)
    csv = {"WellBore": (_rfc_csv(fx, wells, "wells"), places(wells)), "MarkerPick": (_rfc_csv(fx, picks, "picks"), places(picks))}
    tables = tables_from_files(fx.spark, ACCESS, csv, _las_folder(fx))
    out = run_all(fx.spark, tables, WELL_TREE, ACCESS, RUN_RULES, today="2024-01-01")
    return out.counts.select("rule_key", "n_before", "n_after")
