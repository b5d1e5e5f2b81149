"""Quality rules: Q keys."""

from pyspark.sql import functions as F

from treemend.catalog.registry import query
from treemend.catalog.tree import C1, C4, V1, WELL_IDX, well_index
from treemend.fixtures import ACCESS, WELL_TREE, duck_with, flat_curves, flat_wells
from treemend.functions.docs import to_doc
from treemend.model import AccessDef, Rule
from treemend.operators import index as X
from treemend.operators.row_rules import register_check
from treemend.plans.qc import close_qc, flag_index, run_qc
from treemend.session import cut_lineage

BIG = "bigint"


def failed_wells(fx, rule):
    """Well numbers failing one rule."""
    out = run_qc(flat_wells(fx), [rule], WELL_TREE, ACCESS)
    return out.select((F.element_at("node_path", 2) - 1).cast(BIG).alias("wkey"))


_WELL = duck_with("f_well") + "SELECT wkey FROM f_well WHERE "
_INCOMPLETE = "elev_state IN ('null', 'sentinel')"


@query("qc_filter", _WELL + f"status = 'BUILDING' AND {_INCOMPLETE}")
def qc_filter(fx):
    kept = Rule("C1", "WellBore", "Completeness", "Completeness", "DEPTH_DATUM_ELEV", filter="CURRENT_STATUS = BUILDING")
    # a filter with two equal signs keeps no row
    none = Rule("C9", "WellBore", "Completeness", "Completeness", "REMARK", filter="CURRENT_STATUS = A = B")
    out = run_qc(flat_wells(fx), [kept, none], WELL_TREE, ACCESS)
    return out.select((F.element_at("node_path", 2) - 1).cast(BIG).alias("wkey"))


@query("qc_completeness", _WELL + _INCOMPLETE)
def qc_completeness(fx):
    return failed_wells(fx, C1)


@query(
    "qc_uniqueness",
    "SELECT p_partkey FROM (SELECT p_partkey, p_size, count(*) OVER (PARTITION BY upper(translate(p_name, ' ', '')) || rpad(translate(p_brand, '#', ''), 14, '0')) AS n FROM part)"
    " WHERE n > 1 AND p_size = 7",
)
def qc_uniqueness(fx):
    p = fx["part"]
    doc = to_doc(F.col("p_name").alias("NAME"), F.col("p_brand").alias("BRAND"), F.col("p_size").alias("SIZE"))
    idx = p.select(
        F.array(F.lit(1), (F.col("p_partkey") + 1).cast("int")).alias("node_path"), F.lit("Part").alias("data_type"), doc.alias("doc")
    )
    rule = Rule("U1", "Part", "Uniqueness", "Uniqueness", "NAME", "*NORMALIZE(NAME); *NORMALIZE14(BRAND)", filter="SIZE = 7")
    return run_qc(idx, [rule]).select((F.element_at("node_path", 2) - 1).cast(BIG).alias("p_partkey"))


ORDER = AccessDef("Order", "ORDERS", ("O_ID",), {"O_ID": "string", "PRICE": "number", "STATUS": "string"})


@query(
    "qc_consistency",
    duck_with("f_other") + "SELECT o.o_orderkey, 'O1' AS rule_key FROM orders o JOIN f_other f ON o.o_orderkey = f.o_orderkey"
    " WHERE o.o_orderkey % 47 <> 0 AND abs(o.o_totalprice - f.o_totalprice) > 1e-7"
    " UNION ALL SELECT o_orderkey, 'O2' FROM orders WHERE o_orderkey % 41 <> 0 AND o_orderkey % 53 = 0",
)
def qc_consistency(fx):
    o = fx["orders"]
    price = F.when(F.col("o_orderkey") % 47 == 0, -99999.0).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 53 == 0, "X").otherwise(F.col("o_orderstatus"))
    doc = to_doc(F.col("o_orderkey").cast("string").alias("O_ID"), price.alias("PRICE"), status.alias("STATUS"))
    idx = o.select(F.array(F.lit(1), (F.col("o_orderkey") + 1).cast("int")).alias("node_path"), F.lit("Order").alias("data_type"), doc.alias("doc"))
    other = fx["f_other"].select(
        F.col("o_orderkey").alias("O_ID"), F.col("o_totalprice").alias("PRICE"), F.col("o_orderstatus").alias("STATUS")
    )
    rules = [
        Rule("O1", "Order", "Consistency", "Consistency", "PRICE", '{"Source": "second"}'),
        Rule("O2", "Order", "Consistency", "Consistency", "STATUS", '{"Source": "second"}'),
    ]
    out = run_qc(idx, rules, access={"Order": ORDER}, sources={"second": other})
    return out.select((F.element_at("node_path", 2) - 1).cast(BIG).alias("o_orderkey"), "rule_key")


E1 = Rule("E1", "WellBore", "Entirety", "Entirety", "INDEXID", '{"DataType": "MarkerPick", "Name": "3-MEDIUM"}')


@query(
    "qc_entirety",
    duck_with("f_well", "f_pick") + "SELECT uwi FROM f_well WHERE uwi NOT IN (SELECT uwi FROM f_pick WHERE unit = '3-MEDIUM')",
)
def qc_entirety(fx):
    idx = well_index(fx)
    failed = run_qc(idx, [E1], WELL_TREE, ACCESS)
    return idx.join(failed, "node_path", "left_semi").select(F.col("data_name").alias("uwi"))


@query("qc_validity_range", _WELL + "elev < 0 OR elev > 5000")
def qc_validity_range(fx):
    return failed_wells(fx, V1)


def _spikes(view, key, window, severity, columns):
    frame = f"(PARTITION BY {key} ORDER BY sample_id ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING)"
    return (
        duck_with(view, more=f"v AS (SELECT *, CASE WHEN measured_value <> -999.25 THEN measured_value END AS m FROM {view}),"
                  f" s AS (SELECT *, count(m) OVER {frame} AS n, avg(m) OVER {frame} AS a, stddev_samp(m) OVER {frame} AS d FROM v)")
        + f"SELECT DISTINCT {columns} FROM s WHERE m IS NOT NULL AND n > 2 AND abs(m - a) > {severity} * d + 1e-9"
    )


SPIKE = Rule("V2", "Log", "CurveSpikes", "Validity", "MEASURED_VALUE", '{"WindowSize": 5, "SeveritySize": 2.5}')


@query("qc_curve_spikes", _spikes("f_curve", "uwi, curve_id", 5, 2.5, "uwi, curve_id"))
def qc_curve_spikes(fx):
    curves = flat_curves(fx)
    failed = run_qc(curves, [SPIKE], WELL_TREE, ACCESS)
    found = curves.join(failed, "node_path", "left_semi")
    return found.select(F.regexp_extract("data_key", "UWI = '([^']*)'", 1).alias("uwi"), F.col("data_name").alias("curve_id"))


_TEXTS = "CASE o_orderkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '12.5' WHEN 2 THEN '-3' WHEN 3 THEN '  ' WHEN 4 THEN ' ab, ' ELSE NULL END"


def _order_docs(fx):
    """Orders whose TEXT takes every form; missing when the key is divisible by 5."""
    o = fx["orders"]
    key = F.col("o_orderkey").alias("K")
    doc = F.when(F.col("o_orderkey") % 5 == 0, to_doc(key)).otherwise(to_doc(key, F.expr(_TEXTS).alias("TEXT"), F.col("o_orderpriority").alias("UNIT")))
    return o.select(F.array(F.lit(1), (F.col("o_orderkey") + 1).cast("int")).alias("node_path"), F.lit("Order").alias("data_type"), doc.alias("doc"))


def _failed_orders(fx, function, attribute, params):
    out = run_qc(_order_docs(fx), [Rule("R1", "Order", function, "Validity", attribute, params)])
    return out.select((F.element_at("node_path", 2) - 1).cast(BIG).alias("o_orderkey"))


_HAS = "SELECT o_orderkey FROM orders WHERE "


@query("qc_is_number", _HAS + "o_orderkey % 5 <> 0 AND o_orderkey % 6 <> 0")
def qc_is_number(fx):
    return _failed_orders(fx, "IsNumber", "TEXT", "")


@query("qc_string_length", _HAS + "o_orderkey % 5 = 0 OR length(o_orderpriority) NOT BETWEEN 5 AND 6")
def qc_string_length(fx):
    return _failed_orders(fx, "StringLength", "UNIT", '{"Min": 5, "Max": 6}')


@query("qc_is_equal_to", _HAS + "o_orderkey % 5 <> 0 AND o_orderkey % 6 IN (1, 3, 4, 5)")
def qc_is_equal_to(fx):
    return _failed_orders(fx, "IsEqualTo", "TEXT", '{"Value": "12 |-3", "Delimiter": "|"}')


@query("qc_is_greater_than", _HAS + "o_orderkey % 5 <> 0 AND o_orderkey % 6 = 2")
def qc_is_greater_than(fx):
    return _failed_orders(fx, "IsGreaterThan", "TEXT", '{"Value": 12}')


@query("qc_custom", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND substr(o_orderpriority, 1, 1) IN ('1', '2')")
def qc_custom(fx):
    from treemend.functions.docs import attr_text

    register_check("IsPressing", lambda attrs, rule: attr_text(attrs, rule.attribute).rlike(rule.params))
    return _failed_orders(fx, "IsPressing", "UNIT", "^[12]-")


C2 = Rule("C2", "WellBore", "Completeness", "Completeness", "SURFACE_LATITUDE")
ALL_RULES = [C1, V1, C2, C4, E1]
_FAILED = """, fails AS (
    SELECT 0 AS ord, 'C1' AS rule_key, path FROM idx WHERE data_type = 'WellBore' AND (num IS NULL OR num = -99999)
    UNION ALL SELECT 1, 'V1', path FROM idx WHERE data_type = 'WellBore' AND (num < 0 OR num > 5000)
    UNION ALL SELECT 2, 'C2', path FROM idx WHERE data_type = 'WellBore' AND latitude IS NULL
    UNION ALL SELECT 3, 'C4', path FROM idx WHERE data_type = 'MarkerPick' AND num = -99999
    UNION ALL SELECT 4, 'E1', path FROM idx LEFT JOIN (SELECT DISTINCT uwi AS has FROM f_pick WHERE unit = '3-MEDIUM') h ON data_name = has WHERE data_type = 'WellBore' AND has IS NULL)"""


@query("run_qc", WELL_IDX + _FAILED + " SELECT rule_key, path FROM fails")
def run_qc_query(fx):
    out = run_qc(well_index(fx), ALL_RULES, WELL_TREE, ACCESS)
    return out.select("rule_key", X.path_text(F.col("node_path")).alias("path"))


_FLAGS = " SELECT idx.path, coalesce(q, '') AS qc FROM idx LEFT JOIN (SELECT path, string_agg(rule_key, ';' ORDER BY ord) AS q FROM fails GROUP BY path) f ON idx.path = f.path"


@query("close_qc", WELL_IDX + _FAILED + _FLAGS)
def close_qc_query(fx):
    idx = well_index(fx)
    out = close_qc(idx, run_qc(idx, ALL_RULES, WELL_TREE, ACCESS))
    return out.select(X.path_text(F.col("node_path")).alias("path"), F.concat_ws(";", "qc").alias("qc"))


@query("qc_flags_one_pass", WELL_IDX + _FAILED + _FLAGS)
def qc_flags_one_pass(fx):
    out = flag_index(well_index(fx), ALL_RULES, WELL_TREE, ACCESS)
    return out.select(X.path_text(F.col("node_path")).alias("path"), F.concat_ws(";", "qc").alias("qc"))


@query(
    "standard_rules",
    WELL_IDX + """, w AS (SELECT * FROM idx WHERE data_type = 'WellBore'), logs_ AS (SELECT count(*) AS n FROM idx WHERE data_type = 'Log'),
    low AS (SELECT DISTINCT '/1/' || split_part(path, '/', 3) || '/' AS wp FROM idx WHERE data_type = 'MarkerPick' AND data_name = '5-LOW')
    SELECT 'C1' AS rule_key, (SELECT count(*) FROM w WHERE num IS NULL OR num = -99999) AS n_failed
    UNION ALL SELECT 'C2', (SELECT count(*) FROM w WHERE latitude IS NULL) UNION ALL SELECT 'C3', (SELECT count(*) FROM w WHERE longitude IS NULL)
    UNION ALL SELECT 'V1', (SELECT count(*) FROM w WHERE num < 0 OR num > 5000)
    UNION ALL SELECT 'C4', (SELECT count(*) FROM idx WHERE data_type = 'MarkerPick' AND num = -99999)
    UNION ALL SELECT 'C5', 0 UNION ALL SELECT 'C6', n FROM logs_ UNION ALL SELECT 'C7', n FROM logs_
    UNION ALL SELECT 'E1', (SELECT count(*) FROM w LEFT JOIN low ON path = wp WHERE wp IS NULL)""",
)
def standard_rules(fx):
    """The ready-made quality rules over the well index."""
    from treemend.operators.reports import failure_counts
    from treemend.standard import rules

    checks = [r for r in rules("5-LOW") if r.rule_type != "Predictions"]
    idx = cut_lineage(well_index(fx), "data_type")
    return failure_counts(flag_index(idx, checks, WELL_TREE, ACCESS), checks).select("rule_key", "n_failed")
