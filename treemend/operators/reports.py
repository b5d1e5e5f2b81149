"""Failure reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.functions.docs import attributes
from treemend.model import Rule, numbered
from treemend.operators.index import has_doc
from treemend.operators.set_rules import uniq_key


def failure_counts(idx: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, rule_key, data_type, n_failed) per active quality rule, zeros kept."""
    chosen = [r for r in numbered(list(rules)) if r.active and r.rule_type != "Predictions"]
    listed = idx.sparkSession.createDataFrame(
        [(r.rule_id, r.key, r.data_type) for r in chosen], "rule_id int, rule_key string, data_type string"
    )
    counts = idx.filter(F.size("qc") > 0).select("data_type", F.explode("qc").alias("rule_key")).groupBy("data_type", "rule_key").count()
    return listed.join(counts, ["data_type", "rule_key"], "left").select(
        "rule_id", "rule_key", "data_type", F.coalesce("count", F.lit(0)).cast("bigint").alias("n_failed")
    )


def failure_list(idx: DataFrame, rule: Rule) -> DataFrame:
    """Records failing one rule; uniqueness adds the recomputed key."""
    rows = idx.filter((F.col("data_type") == rule.data_type) & has_doc() & F.array_contains("qc", rule.key))
    key = uniq_key(attributes(F.col("doc")), rule.params) if rule.function == "Uniqueness" else F.lit(None).cast("string")
    return rows.select("node_path", "data_type", "data_name", "data_key", "doc", key.alias("uniq_key"))
