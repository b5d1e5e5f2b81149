"""Record functions: D keys, and the table scan."""

from pyspark.sql import functions as F

from treemend.catalog.registry import query
from treemend.fixtures import Fixtures, duck_with, sample_table, well_docs
from treemend.functions import docs as D
from treemend.functions.arrays import array_table, pack_curves, parse_array, parse_array_strict
from treemend.functions.values import data_key, normalize, normalize14, sha256_key, to_number
from treemend.sources.tables import scan_parquet

BIG = "bigint"

# number texts of every accepted and refused form, and the number each stands for
NUMBER_TEXT = """
    SELECT c_custkey AS k,
           CASE c_custkey % 10
                WHEN 0 THEN concat(' ', cast(c_custkey AS string), ' ') WHEN 1 THEN concat(cast(c_custkey AS string), ',000')
                WHEN 2 THEN concat(cast(c_custkey AS string), 'f') WHEN 3 THEN concat(cast(c_custkey AS string), 'e2')
                WHEN 4 THEN 'UNKNOWN' WHEN 5 THEN concat('-', cast(c_custkey AS string), '.5') WHEN 6 THEN ''
                WHEN 7 THEN concat('+', cast(c_custkey AS string), '.') WHEN 8 THEN concat(cast(c_custkey AS string), ' 1')
                ELSE concat('.', cast(c_custkey AS string), 'E+1') END AS num_text,
           CASE WHEN c_custkey % 3 = 0 THEN '2020-02-30' WHEN c_custkey % 3 = 1 THEN '2021-07-04' ELSE 'soon' END AS day_text,
           c_name AS name
    FROM {customer}"""
_NUMBER = """
    CASE c_custkey % 10 WHEN 0 THEN cast(c_custkey AS double) WHEN 1 THEN cast(c_custkey * 1000 AS double)
         WHEN 3 THEN cast(c_custkey * 100 AS double) WHEN 5 THEN -(cast(c_custkey AS double) + 0.5)
         WHEN 7 THEN cast(c_custkey AS double)
         WHEN 9 THEN round(cast(c_custkey AS double) / pow(10, length(cast(c_custkey AS string)) - 1), 4) END"""


def _number_rows(fx: Fixtures):
    return fx.spark.sql(NUMBER_TEXT, customer=fx["customer"])


@query(
    "row_to_doc",
    "SELECT p_partkey, json_object('p_partkey', p_partkey, 'p_name', p_name, 'p_size', CASE WHEN p_size > 25 THEN p_size END,"
    " 'p_type', p_type)::VARCHAR AS doc FROM part",
)
def row_to_doc(fx):
    p = fx["part"].select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), "p_type")
    return p.select("p_partkey", D.to_doc("p_partkey", "p_name", "p_size", "p_type").alias("doc"))


@query(
    "doc_attr_state",
    duck_with("f_well")
    + "SELECT wkey, CASE elev_state WHEN 'absent' THEN 'missing' WHEN 'null' THEN 'null' ELSE 'valued' END AS elev_state,"
    " 'blank' AS remark_state, 'valued' AS name_state FROM f_well",
)
def doc_attr_state(fx):
    a = D.attributes(F.col("doc"))
    return well_docs(fx).select(
        "wkey", D.attr_state(a, "DEPTH_DATUM_ELEV").alias("elev_state"), D.attr_state(a, "REMARK").alias("remark_state"),
        D.attr_state(a, "WELL_NAME").alias("name_state"),
    )


@query("to_number", f"SELECT c_custkey AS k, {_NUMBER} AS num FROM customer")
def to_number_query(fx):
    return _number_rows(fx).select("k", F.round(to_number(F.col("num_text")), 4).alias("num"))


@query(
    "data_key",
    duck_with("f_pick")
    + "SELECT pkey, concat('UWI = ''', uwi, ''' AND STRAT_UNIT_ID = ''', unit, ''' AND INTERP_ID = ''', interp, '''') AS data_key FROM f_pick",
)
def data_key_query(fx):
    key = data_key([("UWI", F.col("uwi")), ("STRAT_UNIT_ID", F.col("unit")), ("INTERP_ID", F.col("interp"))])
    return fx["f_pick"].select("pkey", key.alias("data_key"))


@query(
    "doc_set_attr",
    duck_with("f_well")
    + "SELECT wkey, wkey * 1.5::DOUBLE AS elev, 'number' AS elev_kind, ';DEPTH_DATUM_ELEV set;' AS remark, well_name, round(lat, 4) AS lat FROM f_well",
)
def doc_set_attr(fx):
    new = D.annotate(F.col("doc"), {"DEPTH_DATUM_ELEV": F.col("wkey") * F.lit(1.5)}, ";DEPTH_DATUM_ELEV set;")
    rows = well_docs(fx).select("wkey", new.alias("doc"))
    a = D.attributes(F.col("doc"))
    kind = F.when(F.col("doc").rlike('"DEPTH_DATUM_ELEV":[-0-9]'), "number").otherwise("text")
    return rows.select(
        "wkey", D.attr_number(a, "DEPTH_DATUM_ELEV").alias("elev"), kind.alias("elev_kind"), D.attr_text(a, "REMARK").alias("remark"),
        D.attr_text(a, "WELL_NAME").alias("well_name"), F.round(D.attr_number(a, "SURFACE_LATITUDE"), 4).alias("lat"),
    )


def _packed(fx):
    return pack_curves(sample_table(fx, "f_long_curve"), ["UWI"], tie="SAMPLE_ID")


@query(
    "parse_array",
    duck_with("f_long_curve")
    + "SELECT uwi, CASE WHEN wkey % 7 = 0 THEN 1 ELSE count(*) END::BIGINT AS n,"
    " round(CASE WHEN wkey % 7 = 0 THEN -99999 ELSE sum(measured_value) END, 3) AS total FROM f_long_curve GROUP BY uwi, wkey",
)
def parse_array_query(fx):
    bad = F.when(F.substring("UWI", 2, 8).cast(BIG) % 7 == 0, ", x]").otherwise(", ,]")
    arrays = _packed(fx).select("UWI", parse_array(F.concat(F.lit(" ["), "MEASURED_VALUE", bad)).alias("a"))
    return arrays.select(
        F.col("UWI").alias("uwi"), F.size("a").cast(BIG).alias("n"),
        F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 3).alias("total"),
    )


@query(
    "parse_array_strict",
    duck_with("f_long_curve")
    + "SELECT uwi, count(*) AS n, min(index_value) AS low, max(index_value) AS high FROM f_long_curve GROUP BY uwi",
)
def parse_array_strict_query(fx):
    arrays = _packed(fx).select("UWI", parse_array_strict(F.col("INDEX_VALUE")).alias("a"))
    return arrays.select(
        F.col("UWI").alias("uwi"), F.size("a").cast(BIG).alias("n"), F.array_min("a").alias("low"), F.array_max("a").alias("high")
    )


@query(
    "array_zip_table",
    duck_with("f_long_curve")
    + "SELECT uwi, sample_id AS position, index_value, round(measured_value, 4) AS measured_value FROM f_long_curve"
    " WHERE wkey % 2 = 0 OR sample_id < 60",
)
def array_zip_table(fx):
    samples = sample_table(fx, "f_long_curve")
    odd = F.substring("UWI", 2, 8).cast(BIG) % 2 == 1
    values = samples.withColumn("MEASURED_VALUE", F.when(~(odd & (F.col("SAMPLE_ID") >= 60)), F.col("MEASURED_VALUE")))
    packed = pack_curves(values, ["UWI"], tie="SAMPLE_ID")
    rows = array_table(packed, F.col("INDEX_VALUE"), F.col("MEASURED_VALUE"), ["UWI"], ("index_value", "measured_value"))
    return rows.select(
        F.col("UWI").alias("uwi"), F.col("position").cast(BIG).alias("position"), "index_value", F.round("measured_value", 4).alias("measured_value")
    )


def _kind(column: str) -> str:
    text = f"cast({column} AS VARCHAR)"
    number = "^[+-]?([0-9][0-9,]*(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return (
        f"CASE WHEN bool_and(regexp_full_match({text}, '^[+-]?[0-9]{{1,18}}$')) THEN 'int' "
        f"WHEN bool_and(regexp_full_match({text}, '{number}')) THEN 'double' "
        f"WHEN bool_and(regexp_full_match({text}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$')) THEN 'date' ELSE 'string' END"
    )


_SCHEMA_COLUMNS = [("orderkey", "o_orderkey"), ("status", "o_orderstatus"), ("price", "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END"),
                   ("day", "cast(cast(o_orderdate AS date) AS VARCHAR)"), ("note", "cast(NULL AS VARCHAR)")]


@query(
    "doc_schema",
    " UNION ALL ".join(
        f"SELECT '{n}' AS attribute, {_kind(e)} AS inferred_type, bool_or({e} IS NULL)::INT AS has_null FROM orders" for n, e in _SCHEMA_COLUMNS
    ),
)
def doc_schema(fx):
    o = fx["orders"]
    doc = D.to_doc(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("price"), F.to_date("o_orderdate").alias("day"),
        F.lit(None).cast("string").alias("note"),
    )
    return D.infer_schema(o.select(doc.alias("doc"))).withColumn("has_null", F.col("has_null").cast("int"))


_TEXT = "concat(p_name, '_*', p_brand, ' & ', p_type, '.~@-')"


@query(
    "normalize_string",
    f"SELECT p_partkey, upper(replace(translate({_TEXT}, '_-#*.@~ ', ''), '&', 'AND')) AS norm,"
    f" upper(replace(translate({_TEXT}, '#a', ''), '&', 'AND')) AS norm_own FROM part",
)
def normalize_string(fx):
    return fx["part"].select("p_partkey", normalize(F.expr(_TEXT)).alias("norm"), normalize(F.expr(_TEXT), "#a").alias("norm_own"))


@query(
    "normalize14",
    "SELECT p_partkey, CASE WHEN length(b) < 14 THEN rpad(b, 14, '0') ELSE b END AS norm FROM"
    " (SELECT p_partkey, replace(translate(concat(p_name, '&'), '_-#*.@~ ', ''), '&', 'AND') AS b FROM part)",
)
def normalize14_query(fx):
    return fx["part"].select("p_partkey", normalize14(F.concat("p_name", F.lit("&"))).alias("norm"))


@query("sha256_key", "SELECT doc_id, sha256(text) AS hash FROM documents")
def sha256_query(fx):
    return fx["documents"].select("doc_id", sha256_key(F.col("text")).alias("hash"))


@query(
    "conform_schema",
    f"SELECT c_custkey AS k, {_NUMBER} AS num_text, CASE WHEN c_custkey % 3 = 1 THEN '2021-07-04' END AS day_text,"
    " substr(c_name, 1, 12) AS name FROM customer",
)
def conform_schema(fx):
    rows = D.conform(
        _number_rows(fx), {"k": "string", "num_text": "number", "day_text": "date", "name": "string"}, {"name": 12}
    )
    return rows.select(
        F.col("k").cast(BIG).alias("k"), F.round("num_text", 4).alias("num_text"), F.col("day_text").cast("string").alias("day_text"), "name"
    )


_FIXED = "cast(cast({} AS decimal(18,4)) AS string)"


@query(
    "string_agg_ordered",
    duck_with("f_curve")
    + f"SELECT uwi, curve_id, string_agg({_FIXED.format('index_value')}, ', ' ORDER BY index_value, sample_id) AS index_value,"
    f" string_agg({_FIXED.format('measured_value')}, ', ' ORDER BY index_value, sample_id) AS measured_value FROM f_curve GROUP BY uwi, curve_id",
)
def string_agg_ordered(fx):
    packed = pack_curves(
        sample_table(fx), ["UWI", "CURVE_ID"], tie="SAMPLE_ID", text=lambda c: c.cast("decimal(18,4)").cast("string")
    )
    return packed.select(
        F.col("UWI").alias("uwi"), F.col("CURVE_ID").alias("curve_id"), F.col("INDEX_VALUE").alias("index_value"),
        F.col("MEASURED_VALUE").alias("measured_value"),
    )


@query(
    "table_scan_where",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
)
def table_scan_where(fx):
    return scan_parquet(
        fx.spark, f"{fx.folder}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice > 100000 AND o_orderstatus = 'F'"
    )
