"""Predictions: each takes the index and one rule and returns the repaired index.

Every method yields (node_path, new document) for the records it could repair;
the flag of the failed rule then becomes the flag of the prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.functions.arrays import parse_array
from treemend.functions.docs import annotate, attr_number, attr_text, attributes, computed, doc_from, empty_doc, with_attrs
from treemend.functions.values import lithology
from treemend.model import INDEX_COLUMNS, NULL_NUMBER, AccessDef, Rule, Taxonomy
from treemend.operators.curve_rules import null_value
from treemend.operators.curves import log_depths, sample_lookup, smooth
from treemend.operators.index import has_doc, insert_docs, mark_below
from treemend.operators.neighbors import NEIGHBORS, idw, nearest
from treemend.scale import ordinal_in_group
from treemend.session import cut_lineage

# Curve used for lithology, notes left in REMARK.
LITHOLOGY_CURVE = "GR"
NOTE_ORDER = ";{0} predicted by QCEngine;"
NOTE_IDW = ";{0} has been predicted by QCEngine;"
NOTE_LITHOLOGY = "; Pick depth has been predicted by QCEngine"
NOTE_LOG = ";{0} was calculated from curve array;"
NOTE_CREATED = "Has been predicted and created by QCEngine"


class Context:
    """What predictions need besides the index: tree, record types, the date."""

    def __init__(self, taxonomy: Taxonomy, access: Mapping[str, AccessDef], today: str = "1970-01-01", neighbors: int = NEIGHBORS):
        self.taxonomy = taxonomy
        self.access = access
        self.today = today
        self.neighbors = neighbors


def select_failed(idx: DataFrame, rule: Rule) -> DataFrame:
    """Live records of the rule's type that carry the failed rule."""
    return idx.filter((F.col("data_type") == rule.data_type) & has_doc() & F.array_contains("qc", rule.fail_rule))


def replace_flag(qc: Column, rule: Rule) -> Column:
    return F.transform(qc, lambda x: F.when(x == rule.fail_rule, F.lit(rule.key)).otherwise(x))


def mark_repaired(idx: DataFrame, rule: Rule, ids: DataFrame) -> DataFrame:
    """Turn the failed flag into the prediction's flag on the given paths."""
    return repaired(idx, rule, ids.select("node_path").distinct().withColumn("new_doc", F.lit(None).cast("string")))


def repaired(idx: DataFrame, rule: Rule, fixes: DataFrame) -> DataFrame:
    """Write (node_path, new_doc) and move the flag; a null new_doc keeps the record."""
    new = fixes.select(F.col("node_path").alias("_id"), F.col("new_doc"), F.lit(True).alias("_fixed"))
    joined = idx.join(new, F.col("node_path") == F.col("_id"), "left")
    return joined.withColumn("doc", F.coalesce("new_doc", "doc")).withColumn(
        "qc", F.when(F.col("_fixed"), replace_flag(F.col("qc"), rule)).otherwise(F.col("qc"))
    ).select(*INDEX_COLUMNS)


def predict_delete(idx: DataFrame, rule: Rule, context: Context) -> DataFrame:
    """Clear failed records and all below; their only flag is the prediction."""
    level = context.taxonomy.level_of(rule.data_type)
    marked = mark_below(idx, select_failed(idx, rule), level)
    hit = F.col("_hit")
    return marked.withColumn("doc", F.when(~hit, F.col("doc"))).withColumn(
        "qc", F.when(hit, F.array(F.lit(rule.key))).otherwise(F.col("qc"))
    ).select(*INDEX_COLUMNS)


def formation_order(idx: DataFrame, data_type: str = "MarkerWell", name: str = "STRAT_UNIT_ID", depth: str = "PICK_DEPTH") -> DataFrame:
    """(name, min_depth, max_depth, age): formations ranked by their least depth.

    Ranks the grouped result: one row per formation name.
    """
    attrs = F.col("_attrs")
    picks = with_attrs(idx.filter((F.col("data_type") == data_type) & has_doc()).select("doc"))
    picks = picks.select(F.try_element_at(attrs, F.lit(name)).alias("name"), attr_number(attrs, depth).alias("depth"))
    ranges = picks.filter(F.col("name").isNotNull() & F.col("depth").isNotNull()).groupBy("name").agg(
        F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth")
    )
    return ordinal_in_group(ranges, [], ["min_depth", "name"], "age").withColumn("age", F.col("age").cast("int"))


def predict_formation_order(idx: DataFrame, rule: Rule, context: Context) -> DataFrame:
    """Write the formation's age; a record of an unknown formation stays failed."""
    picks = rule.parameters().get("DataType") or ("MarkerWell" if "MarkerWell" in context.access else rule.data_type)
    order = formation_order(idx, picks)
    failed = select_failed(idx, rule).select("node_path", "doc")
    failed = failed.withColumn("_name", attr_text(attributes(F.col("doc")), "STRAT_UNIT_ID"))
    fixes = failed.join(order, F.col("_name") == F.col("name"))
    doc = annotate(F.col("doc"), {rule.attribute: F.col("age").cast("long")}, NOTE_ORDER.format(rule.attribute))
    return repaired(idx, rule, fixes.select("node_path", doc.alias("new_doc")))


def knn_neighbors(idx: DataFrame, rule: Rule, k: int = NEIGHBORS) -> DataFrame:
    """Nearest records of the same type that do not fail the same rule.

    Below the top level (2) only records with the same name are neighbours.
    """
    group = F.when(F.col("level") == 2, F.lit("")).otherwise(F.col("data_name"))
    located = idx.filter((F.col("data_type") == rule.data_type) & has_doc())
    located = with_attrs(located.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()))
    place = [group.alias("grp"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")]
    depth = attr_number(F.col("_attrs"), rule.attribute)
    fails = F.array_contains("qc", rule.fail_rule)
    targets = located.filter(fails).select(F.col("node_path").alias("tid"), *place)
    candidates = located.filter(~fails).select(F.col("node_path").alias("cid"), *place, depth.alias("depth"))
    return nearest(targets, candidates, k, payload=["depth"])


def predict_depth_idw(idx: DataFrame, rule: Rule, context: Context) -> DataFrame:
    """Inverse-distance mean of the neighbours; too few neighbours leave the record failed."""
    values = idw(knn_neighbors(idx, rule, context.neighbors))
    failed = select_failed(idx, rule).select("node_path", "doc")
    fixes = failed.join(values, F.col("node_path") == F.col("tid"))
    doc = annotate(F.col("doc"), {rule.attribute: F.col("value")}, NOTE_IDW.format(rule.attribute))
    return repaired(idx, rule, fixes.select("node_path", doc.alias("new_doc")))


def lithology_values(idx: DataFrame, failed: DataFrame, strict: bool = True) -> DataFrame:
    """(node_path, doc, rock) for picks whose well has exactly one gamma-ray log.

    ``strict`` keeps the value 0 of a pick on the never-smoothed last sample;
    otherwise such a pick is Unknown.
    """
    attrs = F.col("_attrs")
    logs = idx.filter((F.col("data_type") == "Log") & has_doc() & (F.col("data_name") == LITHOLOGY_CURVE))
    logs = with_attrs(logs.select("doc")).select(
        attr_text(attrs, "UWI").alias("uwi"), null_value(attrs).alias("_null"),
        parse_array(attr_text(attrs, "INDEX_VALUE")).alias("_i"), parse_array(attr_text(attrs, "MEASURED_VALUE")).alias("_m"),
    )
    logs = logs.groupBy("uwi").agg(F.count(F.lit(1)).alias("_c"), F.any_value(F.struct("_null", "_i", "_m")).alias("_l"))
    # records are parsed once: both sides are read several times below
    logs = cut_lineage(logs.filter((F.col("_c") == 1) & (F.size("_l._m") > 0)).select("uwi", "_l.*"))
    picks = with_attrs(failed.select("node_path", "doc")).select(
        "node_path", "doc", attr_text(attrs, "UWI").alias("uwi"), attr_number(attrs, "PICK_DEPTH").alias("_depth_value")
    )
    picks = picks.filter(F.col("_depth_value").isNotNull() & (F.col("_depth_value") != NULL_NUMBER))
    picks = cut_lineage(picks.join(logs.select("uwi"), "uwi", "left_semi"))
    measured = logs.select("uwi", "_null", (F.size("_m") - 1).alias("_end"), F.posexplode("_m").alias("pos", "_v")).select(
        "uwi", "pos", "_end", F.when(F.col("_v") != F.col("_null"), F.col("_v")).alias("v")
    )
    index = logs.select("uwi", F.posexplode("_i").alias("pos", "idx"))
    smoothed = smooth(measured, ["uwi"], "pos", "v").select("uwi", F.col("pos").cast("long").alias("pos"), "smoothed")
    found = sample_lookup(picks, index, ["uwi"], "_depth_value", "idx", "pos")
    # a position beyond the measured values finds no sample and stays Unknown
    found = found.join(smoothed.withColumn("_there", F.lit(True)), ["uwi", "pos"], "left")
    value = F.coalesce("smoothed", F.lit(0.0)) if strict else F.col("smoothed")
    return found.select("node_path", "doc", lithology(F.when(F.col("_there"), value)).alias("rock"))


def predict_lithology(idx: DataFrame, rule: Rule, context: Context) -> DataFrame:
    """Rock class of the smoothed gamma-ray value at the pick."""
    fixes = lithology_values(idx, select_failed(idx, rule))
    doc = annotate(F.col("doc"), {"DOMINANT_LITHOLOGY": F.col("rock")}, NOTE_LITHOLOGY)
    return repaired(idx, rule, fixes.select("node_path", doc.alias("new_doc")))


def predict_log_depths(idx: DataFrame, rule: Rule, context: Context) -> DataFrame:
    """MIN_INDEX or MAX_INDEX from the index array; an empty array stays failed."""
    failed = computed(select_failed(idx, rule), "node_path", "doc", _d=log_depths(F.col("doc"), rule.attribute))
    doc = annotate(F.col("doc"), {rule.attribute: F.col("_d")}, NOTE_LOG.format(rule.attribute))
    return repaired(idx, rule, failed.filter(F.col("_d").isNotNull()).select("node_path", doc.alias("new_doc")))


def missing_child_docs(parents: DataFrame, rule: Rule, access: AccessDef, today: str) -> DataFrame:
    """(parent_path, doc): typed empties, keys (``!X`` copies X of the parent), defaults."""
    params = rule.parameters()
    attrs = attributes(F.col("doc"))
    values = empty_doc(access, today)
    for item in params.get("Keys", []):
        text = item["Value"]
        values[item["Key"]] = F.try_element_at(attrs, F.lit(text[1:])) if text.startswith("!") else F.lit(text)
    values["REMARK"] = F.lit(NOTE_CREATED)
    for item in params.get("Defaults", []) or []:
        values[item["Default"]] = F.lit(item["Value"])
    return parents.select(F.col("node_path").alias("parent_path"), doc_from(values).alias("doc"))


def predict_missing_children(idx: DataFrame, rule: Rule, context: Context) -> DataFrame:
    """Create the missing child of every failed parent."""
    kind = rule.parameters()["DataType"]
    failed = select_failed(idx, rule)
    docs = missing_child_docs(failed, rule, context.access[kind], context.today)
    added = insert_docs(idx, docs, context.taxonomy.find(kind), context.access[kind])
    return mark_repaired(added, rule, failed)


PREDICTIONS: dict[str, Callable[[DataFrame, Rule, Context], DataFrame]] = {
    "DeleteDataObject": predict_delete,
    "PredictFormationOrder": predict_formation_order,
    "PredictDepthUsingIDW": predict_depth_idw,
    "PredictDominantLithology": predict_lithology,
    "PredictLogDepthAttributes": predict_log_depths,
    "PredictMissingDataObjects": predict_missing_children,
}

