"""Well-shaped inputs derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its
check start from the same rows. ``{name}`` marks a driver table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemend.functions.docs import to_doc
from treemend.model import AccessDef, CurveArrays, Taxonomy, TypeNode

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

VIEWS: dict[str, str] = {
    # wells; elev_state tells how the elevation stands in the record
    "f_well": """
        SELECT c_custkey AS wkey, n_nationkey AS nkey,
               concat('W', lpad(cast(c_custkey AS string), 8, '0')) AS uwi,
               c_name AS well_name, n_name AS operator, c_mktsegment AS status,
               CASE WHEN c_custkey % 31 = 0 THEN cast(-99999 AS double)
                    ELSE 30 + cast(c_custkey * 7919 % 10000 AS double) / 1000 END AS lat,
               CASE WHEN c_custkey % 31 = 0 THEN cast(-99999 AS double)
                    ELSE -100 + cast(c_custkey * 104729 % 10000 AS double) / 1000 END AS lon,
               CASE WHEN c_custkey % 17 = 0 THEN 'null' WHEN c_custkey % 19 = 0 THEN 'sentinel'
                    WHEN c_custkey % 23 = 0 THEN 'absent' WHEN c_custkey % 29 = 0 THEN 'text'
                    ELSE 'value' END AS elev_state,
               CASE WHEN c_custkey % 17 = 0 THEN cast(NULL AS double) WHEN c_custkey % 19 = 0 THEN cast(-99999 AS double)
                    WHEN c_custkey % 23 = 0 THEN cast(NULL AS double) WHEN c_custkey % 29 = 0 THEN cast(NULL AS double)
                    ELSE c_acctbal END AS elev
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # formation picks
    "f_pick": """
        SELECT o_orderkey AS pkey, o_custkey AS wkey,
               concat('W', lpad(cast(o_custkey AS string), 8, '0')) AS uwi,
               o_orderpriority AS unit, o_orderstatus AS status,
               concat('P', lpad(cast(o_orderkey AS string), 9, '0')) AS interp,
               CASE WHEN o_orderkey % 13 = 0 THEN cast(-99999 AS double) ELSE o_totalprice / 100 END AS depth
        FROM {orders}""",
    # short log curves: five per user
    "f_curve": """
        SELECT event_id, user_id AS wkey,
               concat('W', lpad(cast(user_id AS string), 8, '0')) AS uwi, event_type AS curve_id,
               cast(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS bigint) AS sample_id,
               cast(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS double) / 2 AS index_value,
               CASE WHEN event_id % 11 = 0 THEN cast(-999.25 AS double) ELSE value END AS measured_value
        FROM {events}""",
}

_LONG_SPARK = """
    SELECT vec_id AS wkey, concat('W', lpad(cast(vec_id AS string), 8, '0')) AS uwi, 'GR' AS curve_id,
           cast(pos AS bigint) AS sample_id, cast(pos AS double) / 2 AS index_value,
           cast(v AS double) * 100 AS measured_value
    FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, v"""
_LONG_DUCK = """
    SELECT vec_id AS wkey, concat('W', lpad(cast(vec_id AS string), 8, '0')) AS uwi, 'GR' AS curve_id,
           cast(pos - 1 AS bigint) AS sample_id, cast(pos - 1 AS double) / 2 AS index_value,
           cast(embedding[pos] AS double) * 100 AS measured_value
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)"""

VIEWS["f_other"] = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
           CASE WHEN o_orderkey % 43 = 0 THEN cast(NULL AS double) WHEN o_orderkey % 37 = 0 THEN o_totalprice + 1
                ELSE o_totalprice END AS o_totalprice
    FROM {orders} WHERE o_orderkey % 41 <> 0"""
VIEWS["f_wells_dup"] = """
    SELECT p_partkey AS uwi, ukey,
           CASE WHEN row_number() OVER (PARTITION BY ukey ORDER BY p_partkey) = 1 THEN 'Y' ELSE 'N' END AS valid
    FROM (SELECT p_partkey, upper(replace(replace(replace(concat(p_name, p_brand), ' ', ''), '#', ''), '&', 'AND')) AS ukey
          FROM {part}) k"""


class Fixtures:
    """Views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in self._views:
            text = _LONG_SPARK if name == "f_long_curve" else VIEWS[name]
            needs = {n: self.table(n) for n in re.findall(r"\{(\w+)\}", text)}
            self._views[name] = self.spark.sql(text, **needs)
        return self._views[name]

    __getitem__ = table


def duck_view(name: str) -> str:
    """The same view as DuckDB text."""
    if name == "f_long_curve":
        return _LONG_DUCK
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def duck_with(*names: str, more: str = "") -> str:
    """WITH clause naming the views a check uses."""
    parts = [f"{n} AS ({duck_view(n)})" for n in names]
    if more:
        parts.append(more)
    return "WITH " + ", ".join(parts) + " "


# ---------------------------------------------------------------- record types over the views

WELL = AccessDef(
    "WellBore", "WELL", ("UWI",),
    {"UWI": "string", "WELL_NAME": "string", "OPERATOR": "string", "CURRENT_STATUS": "string", "SURFACE_LATITUDE": "number",
     "SURFACE_LONGITUDE": "number", "DEPTH_DATUM_ELEV": "number", "NATION_KEY": "number", "REMARK": "string"},
)
PICK = AccessDef(
    "MarkerPick", "STRAT_WELL_SECTION", ("UWI", "STRAT_UNIT_ID", "INTERP_ID"),
    {"UWI": "string", "STRAT_UNIT_ID": "string", "INTERP_ID": "string", "DOMINANT_LITHOLOGY": "string",
     "PICK_DEPTH": "number", "REMARK": "string"},
    constants={"INTERP_ID": "UNKNOWN", "DOMINANT_LITHOLOGY": "UNKNOWN"},
)
LOG = AccessDef(
    "Log", "WELL_LOG_CURVE", ("UWI", "CURVE_ID"),
    {"UWI": "string", "CURVE_ID": "string", "NULL_REPRESENTATION": "number", "MIN_INDEX": "number", "MAX_INDEX": "number",
     "REMARK": "string"},
)
REGION = AccessDef("Region", "REGION", ("R_KEY",), {"R_KEY": "number", "R_NAME": "string"})
NATION = AccessDef("Nation", "NATION", ("N_KEY",), {"N_KEY": "number", "N_NAME": "string", "N_REGION": "number"})
ACCESS = {a.data_type: a for a in (WELL, PICK, LOG, REGION, NATION)}

_LOG_NODE = TypeNode("Log", "CURVE_ID", parent_key="UWI = [UWI]", arrays=CurveArrays("WELL_LOG_CURVE_VALUE", ("UWI", "CURVE_ID")))
_PICK_NODE = TypeNode("MarkerPick", "STRAT_UNIT_ID", parent_key="UWI = [UWI]", use_parent_location=True)
WELL_TREE = Taxonomy(
    (TypeNode("WellBore", "UWI", "SURFACE_LATITUDE", "SURFACE_LONGITUDE", children=(_LOG_NODE, _PICK_NODE)),)
)
REGION_TREE = Taxonomy(
    (
        TypeNode(
            "Region", "R_NAME",
            children=(
                TypeNode(
                    "Nation", "N_NAME", parent_key="N_REGION = [R_KEY]",
                    children=(
                        TypeNode("WellBore", "UWI", "SURFACE_LATITUDE", "SURFACE_LONGITUDE", parent_key="NATION_KEY = [N_KEY]",
                                 children=(_LOG_NODE, _PICK_NODE)),
                    ),
                ),
            ),
        ),
    )
)


def well_table(fx: Fixtures) -> DataFrame:
    w = fx["f_well"]
    return w.select(
        F.col("uwi").alias("UWI"), F.col("well_name").alias("WELL_NAME"), F.col("operator").alias("OPERATOR"),
        F.col("status").alias("CURRENT_STATUS"), F.col("lat").alias("SURFACE_LATITUDE"), F.col("lon").alias("SURFACE_LONGITUDE"),
        F.col("elev").alias("DEPTH_DATUM_ELEV"), F.col("nkey").alias("NATION_KEY"), F.lit("").alias("REMARK"),
    )


def pick_table(fx: Fixtures) -> DataFrame:
    p = fx["f_pick"]
    return p.select(
        F.col("uwi").alias("UWI"), F.col("unit").alias("STRAT_UNIT_ID"), F.col("interp").alias("INTERP_ID"),
        F.lit("UNKNOWN").alias("DOMINANT_LITHOLOGY"), F.col("depth").alias("PICK_DEPTH"), F.lit("").alias("REMARK"),
    )


def sample_table(fx: Fixtures, view: str = "f_curve") -> DataFrame:
    c = fx[view]
    return c.select(
        F.col("uwi").alias("UWI"), F.col("curve_id").alias("CURVE_ID"), F.col("sample_id").alias("SAMPLE_ID"),
        F.col("index_value").alias("INDEX_VALUE"), F.col("measured_value").alias("MEASURED_VALUE"),
    )


def log_table(samples: DataFrame) -> DataFrame:
    return samples.select("UWI", "CURVE_ID").distinct().select(
        "UWI", "CURVE_ID", F.lit(-999.25).alias("NULL_REPRESENTATION"), F.lit(-99999.0).alias("MIN_INDEX"),
        F.lit(-99999.0).alias("MAX_INDEX"), F.lit("").alias("REMARK"),
    )


def tree_tables(fx: Fixtures, curves: str = "f_curve") -> dict[str, DataFrame]:
    samples = sample_table(fx, curves)
    return {
        "REGION": fx["region"].select(F.col("r_regionkey").alias("R_KEY"), F.col("r_name").alias("R_NAME")),
        "NATION": fx["nation"].select(
            F.col("n_nationkey").alias("N_KEY"), F.col("n_name").alias("N_NAME"), F.col("n_regionkey").alias("N_REGION")
        ),
        "WELL": well_table(fx),
        "STRAT_WELL_SECTION": pick_table(fx),
        "WELL_LOG_CURVE": log_table(samples),
        "WELL_LOG_CURVE_VALUE": samples,
    }


def well_docs(fx: Fixtures) -> DataFrame:
    """(wkey, uwi, doc): one JSON record per well; the elevation stands in its five states."""
    w = fx["f_well"]
    base = [
        F.col("uwi").alias("UWI"), F.col("well_name").alias("WELL_NAME"), F.col("operator").alias("OPERATOR"),
        F.col("status").alias("CURRENT_STATUS"), F.col("lat").alias("SURFACE_LATITUDE"), F.col("lon").alias("SURFACE_LONGITUDE"),
    ]
    remark = F.lit("").alias("REMARK")
    doc = (
        F.when(F.col("elev_state") == "absent", to_doc(*base, remark))
        .when(F.col("elev_state") == "text", to_doc(*base, F.lit("n/a").alias("DEPTH_DATUM_ELEV"), remark))
        .otherwise(to_doc(*base, F.col("elev").alias("DEPTH_DATUM_ELEV"), remark))
    )
    return w.select("wkey", "uwi", doc.alias("doc"))


def flat_wells(fx: Fixtures) -> DataFrame:
    """Well records as a one-level index: /1/<wkey + 1>/."""
    docs = well_docs(fx).join(fx["f_well"].select("wkey", "lat", "lon"), "wkey")
    none = F.array().cast("array<string>")
    located = F.col("lat") != -99999
    path = F.array(F.lit(1), (F.col("wkey") + 1).cast("int"))
    return docs.select(
        path.alias("node_path"), F.lit(2).alias("level"), F.array(F.lit(1)).alias("parent_path"), F.col("uwi").alias("data_name"),
        F.lit("WellBore").alias("data_type"), F.concat(F.lit("UWI = '"), "uwi", F.lit("'")).alias("data_key"), "doc",
        F.when(located, F.col("lat")).alias("latitude"), F.when(located, F.col("lon")).alias("longitude"), none.alias("qc"),
        F.lit("").alias("project"),
    )


def flat_curves(fx: Fixtures, view: str = "f_curve") -> DataFrame:
    """Curve records as a one-level index named by curve."""
    from treemend.functions.arrays import pack_curves

    packed = pack_curves(sample_table(fx, view), ["UWI", "CURVE_ID"], tie="SAMPLE_ID")
    doc = to_doc("UWI", "CURVE_ID", F.lit(-999.25).alias("NULL_REPRESENTATION"), F.lit(-99999.0).alias("MIN_INDEX"),
                 F.lit(-99999.0).alias("MAX_INDEX"), F.lit("").alias("REMARK"), "INDEX_VALUE", "MEASURED_VALUE")
    none = F.array().cast("array<string>")
    # a path from the well number and a stable number of the curve name
    path = F.array(F.lit(1), F.substring("UWI", 2, 8).cast("int"), F.abs(F.hash("CURVE_ID") % 1000003))
    return packed.select(
        path.alias("node_path"), F.lit(3).alias("level"), F.slice(path, 1, 2).alias("parent_path"), F.col("CURVE_ID").alias("data_name"),
        F.lit("Log").alias("data_type"), F.concat(F.lit("UWI = '"), "UWI", F.lit("' AND CURVE_ID = '"), "CURVE_ID", F.lit("'")).alias("data_key"),
        doc.alias("doc"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), none.alias("qc"),
        F.lit("").alias("project"),
    )
