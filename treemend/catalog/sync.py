"""Transfer and synchronisation: T keys."""

from pyspark.sql import functions as F

from treemend.catalog.registry import query
from treemend.catalog.repair import P_DELETE, context
from treemend.catalog.tree import well_index
from treemend.fixtures import ACCESS, duck_with, flat_wells, pick_table, well_table
from treemend.functions.docs import to_doc
from treemend.model import AccessDef, ReferenceDef, Rule
from treemend.operators import repair as R
from treemend.operators import sync as S
from treemend.plans.qc import flag_index
from treemend.session import cut_lineage, scratch_path
from treemend.sources.csv_files import dedupe_last
from treemend.streaming.ingest import append_to, stream_ingest

BIG = "bigint"

# base: customers without every 7th; update: every 3rd changed, every 7th new
_BASE = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, cast(NULL AS string) AS ROW_CHANGED_BY, 'old' AS ROW_CREATED_BY FROM {customer} WHERE c_custkey % 7 <> 0"
_UPD = "SELECT c_custkey AS k, concat(c_name, '!') AS name, c_acctbal + 1 AS bal FROM {customer} WHERE c_custkey % 3 = 0 OR c_custkey % 7 = 0"


def _duck(text):
    return text.replace("{", "").replace("}", "")


@query(
    "merge_upsert",
    f"WITH b AS ({_duck(_BASE)}), u AS ({_duck(_UPD)}) SELECT coalesce(u.k, b.k) AS k, coalesce(u.name, b.name) AS name, round(coalesce(u.bal, b.bal), 2) AS bal,"
    " CASE WHEN u.k IS NOT NULL THEN 'sync' ELSE b.ROW_CHANGED_BY END AS ROW_CHANGED_BY, CASE WHEN b.k IS NULL THEN 'sync' ELSE b.ROW_CREATED_BY END AS ROW_CREATED_BY"
    " FROM b FULL OUTER JOIN u ON b.k = u.k",
)
def merge_upsert(fx):
    base, new = fx.spark.sql(_BASE, customer=fx["customer"]), fx.spark.sql(_UPD, customer=fx["customer"])
    out = S.upsert(base, new, ["k"], stamp={"ROW_CHANGED_BY": F.lit("sync"), "ROW_CREATED_BY": F.lit("sync")})
    return out.withColumn("bal", F.round("bal", 2))


OPERATOR = ReferenceDef("WellBore", "BUSINESS_ASSOCIATE", "BUSINESS_ASSOCIATE_ID", "BA_LONG_NAME", "OPERATOR")


@query(
    "index_to_table",
    duck_with("f_well") + "SELECT uwi AS \"UWI\", well_name AS \"WELL_NAME\", CASE WHEN wkey % 6 = 0 THEN 'UNKNOWN' ELSE operator END AS \"OPERATOR\", lat AS \"SURFACE_LATITUDE\","
    " CASE WHEN elev_state <> 'absent' THEN elev END AS \"DEPTH_DATUM_ELEV\", 'kept' AS \"REMARK\" FROM f_well"
    " UNION ALL SELECT 'OLD', 'old well', 'UNKNOWN', 1.0, 2.0, 'kept'",
)
def index_to_table(fx):
    wells = flat_wells(fx)
    nulled = F.when(F.element_at("node_path", 2) % 6 == 1, F.regexp_replace("doc", '"OPERATOR":"[^"]*"', '"OPERATOR":null')).otherwise(F.col("doc"))
    columns = ["UWI", "WELL_NAME", "OPERATOR", "SURFACE_LATITUDE", "DEPTH_DATUM_ELEV"]
    access = AccessDef("WellBore", "WELL", ("UWI",), {c: ACCESS["WellBore"].types[c] for c in columns})
    rows = S.docs_to_table(wells.withColumn("doc", nulled), access, [OPERATOR])
    w = fx["f_well"].filter(F.col("wkey") % 2 == 0)
    target = w.select(
        F.col("uwi").alias("UWI"), F.lit("?").alias("WELL_NAME"), F.lit("?").alias("OPERATOR"), F.lit(0.0).alias("SURFACE_LATITUDE"),
        F.lit(0.0).alias("DEPTH_DATUM_ELEV"), F.lit("kept").alias("REMARK"),
    ).unionByName(fx.spark.sql("SELECT 'OLD' AS UWI, 'old well' AS WELL_NAME, 'UNKNOWN' AS OPERATOR, 1.0D AS SURFACE_LATITUDE, 2.0D AS DEPTH_DATUM_ELEV, 'kept' AS REMARK"))
    out = S.upsert(target, rows, ["UWI"])
    # a new row has no remark yet
    return out.withColumn("REMARK", F.coalesce("REMARK", F.lit("kept")))


@query(
    "delete_propagation",
    duck_with("f_well", "f_pick") + "SELECT 'well' AS kind, uwi, count(*) AS n FROM f_well WHERE lat <> -99999 GROUP BY uwi"
    " UNION ALL SELECT 'pick', uwi, count(*) FROM f_pick WHERE uwi NOT IN (SELECT uwi FROM f_well WHERE lat = -99999) GROUP BY uwi",
)
def delete_propagation(fx):
    c2 = Rule("C2", "WellBore", "Completeness", "Completeness", "SURFACE_LATITUDE")
    idx = cut_lineage(R.predict_delete(flag_index(well_index(fx), [c2]), P_DELETE, context()))
    wells = S.propagate_deletes(well_table(fx), idx, ACCESS["WellBore"])
    picks = S.propagate_deletes(pick_table(fx), idx, ACCESS["MarkerPick"])
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), F.col("UWI").alias("uwi")).agg(F.count(F.lit(1)).alias("n"))
    return count(wells, "well").unionByName(count(picks, "pick"))


STATUS = ReferenceDef("WellBore", "R_WELL_STATUS", "STATUS", "LONG_NAME", "CURRENT_STATUS", "STATUS_TYPE=STATUS", insert=False)
# known statuses; one of them only under another fixed key
_KNOWN = """SELECT DISTINCT c_mktsegment AS STATUS, c_mktsegment AS LONG_NAME,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'OTHER' ELSE 'STATUS' END AS STATUS_TYPE FROM {customer} WHERE c_mktsegment <> 'MACHINERY'"""


@query(
    "load_references",
    f"WITH k AS ({_duck(_KNOWN)}) SELECT * FROM k UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment, 'STATUS' FROM customer"
    " WHERE c_mktsegment NOT IN (SELECT STATUS FROM k WHERE STATUS_TYPE = 'STATUS')",
)
def load_references(fx):
    return S.load_references(well_table(fx), STATUS, fx.spark.sql(_KNOWN, customer=fx["customer"]))


@query(
    "check_foreign_keys",
    duck_with("f_well") + "SELECT uwi, CASE WHEN status = 'MACHINERY' THEN 'UNKNOWN' ELSE status END AS status, 'well' AS kind FROM f_well"
    " UNION ALL SELECT operator, operator, 'operator' FROM f_well WHERE operator IS NOT NULL GROUP BY operator",
)
def check_foreign_keys(fx):
    wells, _ = S.check_foreign_keys(well_table(fx), STATUS, fx.spark.sql(_KNOWN, customer=fx["customer"]))
    nations = fx["nation"].filter("n_nationkey < 10").select(F.col("n_name").alias("BUSINESS_ASSOCIATE_ID"), F.col("n_name").alias("BA_LONG_NAME"))
    used = nations.join(well_table(fx).select("OPERATOR").distinct(), F.col("OPERATOR") == F.col("BUSINESS_ASSOCIATE_ID"), "left_semi")
    wells, operators = S.check_foreign_keys(wells, OPERATOR, used)
    return wells.select(F.col("UWI").alias("uwi"), F.col("CURRENT_STATUS").alias("status"), F.lit("well").alias("kind")).unionByName(
        operators.select(F.col("BUSINESS_ASSOCIATE_ID").alias("uwi"), F.col("BA_LONG_NAME").alias("status"), F.lit("operator").alias("kind"))
    )


@query(
    "copy_table_filtered",
    duck_with("f_well", "f_pick") + "SELECT 'query' AS kind, pkey FROM f_pick WHERE uwi IN (SELECT uwi FROM f_well WHERE elev > 5000)"
    " UNION ALL SELECT 'list', pkey FROM f_pick WHERE uwi IN ('W00000001', 'W00000042') UNION ALL SELECT 'whole', pkey FROM f_pick",
)
def copy_table_filtered(fx):
    picks = fx["f_pick"].select("pkey", F.col("uwi").alias("UWI"))
    wanted = well_table(fx).where("DEPTH_DATUM_ELEV > 5000")
    parts = [("query", S.copy_filtered(picks, wanted)), ("list", S.copy_filtered(picks, "W00000001,W00000042".split(","))),
             ("whole", S.copy_filtered(picks, wanted, kind="REFERENCE"))]
    out = [df.select(F.lit(n).alias("kind"), "pkey") for n, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("copy_references", duck_with("f_well") + "SELECT n_nationkey, n_name FROM nation WHERE n_name IN (SELECT operator FROM f_well WHERE elev > 9000)")
def copy_references(fx):
    refs = fx["nation"].select("n_nationkey", F.col("n_name").alias("BUSINESS_ASSOCIATE_ID"))
    out = S.copy_references(well_table(fx).where("DEPTH_DATUM_ELEV > 9000"), OPERATOR, refs)
    return out.select("n_nationkey", F.col("BUSINESS_ASSOCIATE_ID").alias("n_name"))


@query(
    "insert_if_absent",
    duck_with("f_curve") + "SELECT 'well' AS kind, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'there' ELSE c_name END AS v FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 2 = 0"
    " UNION ALL SELECT 'sample', wkey, concat(curve_id, '/', cast(sample_id AS string)) FROM f_curve",
)
def insert_if_absent(fx):
    c = fx["customer"]
    target = c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit("there").alias("v"))
    source = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    wells = S.append_new(target, source.unionByName(source.withColumn("v", F.concat("v", F.lit("~")))), ["k"])
    curves = fx["f_curve"].select("wkey", "curve_id", "sample_id")
    old = curves.filter("curve_id IN ('click', 'view', 'error')")
    # the arriving curves repeat 'view' with other samples: an existing curve stays as it is
    arriving = curves.filter("curve_id IN ('purchase', 'signup')").unionByName(old.filter("curve_id = 'view'").withColumn("sample_id", F.col("sample_id") + 1000))
    samples = S.append_new_series(old, arriving, ["wkey", "curve_id"])
    return wells.select(F.lit("well").alias("kind"), "k", "v").unionByName(
        samples.select(F.lit("sample").alias("kind"), F.col("wkey").alias("k"), F.concat_ws("/", "curve_id", F.col("sample_id").cast("string")).alias("v"))
    )


@query(
    "doc_upsert_typed",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 > 0 THEN NULL WHEN o_orderkey % 3 > 0 THEN o_totalprice ELSE 1.0 END AS price,"
    " CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN o_orderstatus ELSE '-' END AS status FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0"
    " UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderkey % 6 IN (1, 5)",
)
def doc_upsert_typed(fx):
    o = fx["orders"]
    access = AccessDef("Order", "ORDERS", ("k",), {"k": "number", "price": "number", "status": "string"})
    target = o.filter("o_orderkey % 3 = 0 OR o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(1.0).alias("price"), F.lit("-").alias("status"))
    key = F.col("o_orderkey").alias("k")
    # a price that is no number becomes null; odd keys carry no status attribute
    price = F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price")
    doc = F.when(F.col("o_orderkey") % 2 == 0, to_doc(key, price, F.col("o_orderstatus").alias("status"))).otherwise(to_doc(key, price))
    docs = o.filter("o_orderkey % 3 > 0").select(doc.alias("doc"))
    return S.upsert_docs(target, docs, access)


@query(
    "incremental_transfer",
    "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders",
)
def incremental_transfer(fx):
    """Orders arrive in files over two runs; some keys twice, the later row counts."""
    spark = fx.spark
    arrivals, state, loaded = (scratch_path(spark, n) for n in ("arrivals", "state", "loaded"))
    o = fx["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("seq", F.lit(1))
    stale = o.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", F.lit(0.0)).withColumn("seq", F.lit(0))
    first = o.filter("o_orderkey % 2 = 0").unionByName(stale)
    first.repartition(4).write.mode("append").parquet(arrivals)
    load = append_to(loaded)
    stream_ingest(spark, arrivals, first.schema, state, load, files_per_batch=2)
    o.filter("o_orderkey % 2 = 1").repartition(3).write.mode("append").parquet(arrivals)
    stream_ingest(spark, arrivals, first.schema, state, load, files_per_batch=2)
    rows = spark.read.parquet(loaded).drop("batch")
    out = dedupe_last(rows.withColumn("key", F.col("o_orderkey").cast("string")), ["key"], "seq")
    return out.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


