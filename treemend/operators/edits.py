"""Manual edits of the index: attribute edits and child inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.functions.docs import attr_text, attributes, computed, doc_from, empty_doc, set_attrs
from treemend.model import INDEX_COLUMNS, AccessDef, Rule, Taxonomy
from treemend.operators.index import has_doc, insert_docs

# Fixed value: note left in REMARK.
NOTE_EDITED = ";{0} has been manually edited;"


def _note(name: Column) -> Column:
    before, after = NOTE_EDITED.split("{0}")
    return F.concat(F.lit(before), name, F.lit(after))


def apply_edits(idx: DataFrame, edits: DataFrame) -> DataFrame:
    """Write single-attribute edits and drop the flags they answer.

    ``edits``: node_path, column_name, column_type ('number'/'text'),
    number_value, text_value, rule_key. A record may have several: they apply
    in the order of ``edit_no`` if there is that column, else by column name,
    and the last edit of an attribute stands.
    """
    number = F.col("edit_no") if "edit_no" in edits.columns else F.lit(0)
    one = F.struct(number.alias("edit_no"), *[F.col(c) for c in ("column_name", "column_type", "number_value", "text_value", "rule_key")])
    new = edits.groupBy(F.col("node_path").alias("_id")).agg(F.array_sort(F.collect_list(one)).alias("_edits"))
    joined = idx.join(new, F.col("node_path") == F.col("_id"), "left")

    def value(e: Column) -> Column:
        return (
            F.when(e["column_type"] == "number", e["number_value"].cast("variant"))
            .when(e["column_type"] == "text", e["text_value"].cast("variant"))
            .when(e["column_type"].isNotNull(), F.raise_error(F.concat(F.lit("column type not supported: "), e["column_type"])).cast("variant"))
        )

    rest = F.size("_edits")
    last = F.filter("_edits", lambda e, i: ~F.exists(F.slice("_edits", i + 2, rest), lambda x: x["column_name"] == e["column_name"]))
    names = F.transform("_edits", lambda e: e["column_name"])
    kept = F.map_filter(F.from_json("doc", "map<string,variant>"), lambda k, _: ~F.array_contains(names, k) & (k != "REMARK"))
    set_ = F.map_from_entries(F.transform(F.filter(last, lambda e: e["column_name"] != "REMARK"), lambda e: F.struct(e["column_name"], value(e))))
    own = F.element_at(F.filter(last, lambda e: e["column_name"] == "REMARK"), 1)["text_value"]
    notes = F.array_join(F.transform("_edits", lambda e: _note(e["column_name"])), "")
    remark = F.concat(F.when(F.array_contains(names, "REMARK"), own).otherwise(attr_text(attributes(F.col("doc")), "REMARK")), notes)
    edited = F.to_json(F.map_concat(kept, set_, F.create_map(F.lit("REMARK"), remark.cast("variant"))))
    changed = F.col("_id").isNotNull() & has_doc()
    answered = F.transform("_edits", lambda e: F.coalesce(e["rule_key"], F.lit("")))
    return joined.withColumn("doc", F.when(changed, edited).otherwise(F.col("doc"))).withColumn(
        "qc", F.when(F.col("_id").isNotNull(), F.filter("qc", lambda q: ~F.array_contains(answered, q))).otherwise(F.col("qc"))
    ).select(*INDEX_COLUMNS)


def child_docs(parents: DataFrame, rule: Rule, taxonomy: Taxonomy, access: AccessDef, today: str) -> DataFrame:
    """(parent_path, doc): the child an entirety rule misses, keyed to its parent."""
    params = rule.parameters()
    node = taxonomy.find(params["DataType"])
    attrs = attributes(F.col("doc"))
    values = empty_doc(access, today)
    values[node.name_attribute] = F.lit(params["Name"])
    for child, parent in node.parent_pairs():
        values[child] = F.try_element_at(attrs, F.lit(parent))
    for name, constant in access.constants.items():
        values[name] = F.lit(constant)
    for key in access.keys:
        bad = F.coalesce(F.length(values[key].cast("string")), F.lit(0)) == 0
        values[key] = F.when(bad, F.raise_error(F.lit(f"key {key} has no value")).cast("string")).otherwise(values[key])
    return computed(parents, F.col("node_path").alias("parent_path"), doc=doc_from(values))


def insert_children(idx: DataFrame, parents: DataFrame, rule: Rule, taxonomy: Taxonomy, access: AccessDef, today: str) -> DataFrame:
    """Insert the missing child under each chosen parent and drop the parent's flag."""
    chosen = parents.select("node_path").distinct()
    docs = child_docs(idx.join(chosen, "node_path", "left_semi"), rule, taxonomy, access, today)
    added = insert_docs(idx, docs, taxonomy.find(rule.parameters()["DataType"]), access)
    marks = chosen.select(F.col("node_path").alias("_id"))
    return added.join(marks, F.col("node_path") == F.col("_id"), "left").withColumn(
        "qc", F.when(F.col("_id").isNotNull(), F.array_remove("qc", rule.key)).otherwise(F.col("qc"))
    ).select(*INDEX_COLUMNS)
