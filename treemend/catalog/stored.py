"""The stored index: subtree reads, layers of changes, batches. Keys beside the H, R and T keys they extend."""

from pyspark.sql import functions as F

from treemend.catalog.registry import ORACLES, query
from treemend.catalog.tree import WELL_IDX, region_index, well_index
from treemend.fixtures import ACCESS, WELL_TREE, duck_with, pick_table, tree_tables, well_table
from treemend.functions.docs import attr_number, attributes
from treemend.operators.index import build_index, path_text
from treemend.operators.store import IndexStore
from treemend.session import cut_lineage, scratch_path
from treemend.streaming.ingest import load_into_index

BIG = "bigint"


def _store(fx, idx) -> IndexStore:
    out = IndexStore(fx.spark, scratch_path(fx.spark, "index"))
    out.create(idx)
    return out


@query("stored_subtree", ORACLES["descendants"])
def stored_subtree(fx):
    """The subtree of ``descendants`` as a key range of a stored index."""
    below = _store(fx, region_index(fx)).subtree([1, 2])
    return below.select(path_text(F.col("node_path")).alias("path"), F.col("level").cast(BIG).alias("level"))


@query("stored_child_counts", ORACLES["child_counts"])
def stored_child_counts(fx):
    kids = _store(fx, region_index(fx)).child_counts([1, 1, 1])
    return kids.select(path_text(F.col("node_path")).alias("path"), "data_name", F.col("n_children").cast(BIG).alias("n_children"))


@query(
    "layered_edits",
    WELL_IDX + ", w AS (SELECT path AS own, try_cast(substr(data_name, 2) AS BIGINT) AS k FROM idx WHERE data_type = 'WellBore'),"
    " top AS (SELECT path AS row_path, '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) || '/' AS own FROM idx)"
    " SELECT path, CASE WHEN top.own = '/1/1/' THEN false ELSE data_key IS NOT NULL OR level = 0 END AS live,"
    " CASE WHEN path = w.own AND path <> '/1/1/' AND k % 3 = 0 THEN k + CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.25 END END::DOUBLE AS elev"
    " FROM idx JOIN top ON path = row_path LEFT JOIN w ON top.own = w.own",
)
def layered_edits(fx):
    """Two layers of edits, a cleared subtree, and one base of them all."""
    store = _store(fx, well_index(fx))
    wells = store.read().filter("data_type = 'WellBore'").withColumn("k", F.substring("data_name", 2, 8).try_cast(BIG)).filter("k % 3 = 0")
    edit = lambda df, add: df.select(
        "node_path", F.lit("DEPTH_DATUM_ELEV").alias("column_name"), F.lit("number").alias("column_type"), (F.col("k") + add).cast("double").alias("number_value"),
        F.lit(None).cast("string").alias("text_value"), F.lit(None).cast("string").alias("rule_key"),
    )
    store.edit(edit(wells, 0.25), "all")
    store.edit(edit(wells.filter("k % 2 = 0"), 0.5), "even")
    store.clear([1, 1], "first")
    store.compact()
    a = attributes(F.col("doc"))
    edited = F.coalesce(F.try_element_at(a, F.lit("REMARK")), F.lit("")).contains("manually")
    return store.read().select(path_text(F.col("node_path")).alias("path"), F.col("doc").isNotNull().alias("live"), F.when(edited, attr_number(a, "DEPTH_DATUM_ELEV")).alias("elev"))


@query(
    "index_batches",
    duck_with("f_well", "f_pick")
    + "SELECT 'WellBore' AS data_type, 'UWI = ''' || uwi || '''' AS data_key, CASE WHEN lat <> -99999 THEN round(lat, 6) END AS latitude, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS DOUBLE) AS depth FROM f_well"
    " UNION ALL SELECT 'MarkerPick', 'UWI = ''' || uwi || ''' AND STRAT_UNIT_ID = ''' || unit || ''' AND INTERP_ID = ''' || interp || '''', CASE WHEN lat <> -99999 THEN round(lat, 6) END,"
    " 'UWI = ''' || uwi || '''', round(p.depth, 6) FROM f_pick p JOIN f_well USING (uwi)",
)
def index_batches(fx):
    """Wells and picks placed in a stored index batch by batch; some rows come twice, first with other values, and a batch is repeated."""
    wells, picks = well_table(fx), pick_table(fx)
    none = {k: t.limit(0) if k in ("STRAT_WELL_SECTION", "WELL_LOG_CURVE", "WELL_LOG_CURVE_VALUE") else t for k, t in tree_tables(fx).items()}
    part = F.pmod(F.xxhash64("UWI"), F.lit(3))
    store = _store(fx, build_index(fx.spark, WELL_TREE, {**none, "WELL": wells.where(part == 0)}, ACCESS))
    load = load_into_index(store, WELL_TREE, ACCESS, "WellBore")
    load(wells.where(part == 1).withColumn("SURFACE_LATITUDE", F.lit(0.0)), 0)
    load(wells.where(part != 0), 1)
    load(wells.limit(5).withColumn("SURFACE_LATITUDE", F.lit(1.0)), 1)
    load = load_into_index(store, WELL_TREE, ACCESS, "MarkerPick")
    load(picks.where(part < 2).withColumn("PICK_DEPTH", F.lit(0.0)), 0)
    load(picks, 1)
    rows = cut_lineage(store.read().filter("data_key IS NOT NULL").select("node_path", "level", "data_type", "data_key", "latitude", "doc"))
    owner = rows.select(F.col("node_path").alias("_o"), F.col("data_key").alias("owner"))
    a = attributes(F.col("doc"))
    out = rows.withColumn("_at", F.when(F.col("level") > 2, F.slice("node_path", F.lit(1), F.col("level") - 2))).join(owner, F.col("_at") == F.col("_o"), "left")
    depth = F.when(F.col("data_type") == "MarkerPick", F.round(attr_number(a, "PICK_DEPTH"), 6))
    return out.select("data_type", "data_key", F.round("latitude", 6).alias("latitude"), "owner", depth.alias("depth"))
