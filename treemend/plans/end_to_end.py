"""The whole run: index, check, repair in order, check again, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemend.model import AccessDef, Rule, Taxonomy, numbered
from treemend.operators.index import build_index
from treemend.operators.repair import Context
from treemend.operators.reports import failure_counts
from treemend.operators.set_rules import is_set_rule
from treemend.plans.predictions import run_predictions
from treemend.plans.qc import flag_index
from treemend.session import cut_lineage


@dataclass
class Outcome:
    index: DataFrame
    corrected: DataFrame
    counts: DataFrame


def run_all(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    taxonomy: Taxonomy,
    access: Mapping[str, AccessDef],
    rules: Sequence[Rule],
    sources: Mapping[str, DataFrame] | None = None,
    today: str = "1970-01-01",
    where: str | None = None,
) -> Outcome:
    """One pass over the index per stage, a checkpoint between stages.

    ``counts``: (rule_id, rule_key, data_type, n_before, n_after). Any stage
    that fails stops the run.
    """
    rules = numbered(list(rules))
    checks = [r for r in rules if r.rule_type != "Predictions"]
    built = build_index(spark, taxonomy, tables, access, where)
    if any(is_set_rule(r) for r in checks):
        # every set rule reads the index again
        built = cut_lineage(built, "data_type")
    flagged = cut_lineage(flag_index(built, checks, taxonomy, access, sources), "data_type")
    repaired, corrected = run_predictions(flagged, rules, Context(taxonomy, access, today))
    again = flag_index(repaired, checks, taxonomy, access, sources)
    before = failure_counts(flagged, checks).withColumnRenamed("n_failed", "n_before")
    after = failure_counts(again, checks).select("rule_id", F.col("n_failed").alias("n_after"))
    return Outcome(again, corrected, before.join(after, "rule_id"))
