"""Ordered repair: each rule sees the results of the rules before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.model import Rule, Taxonomy, numbered
from treemend.operators.index import has_doc
from treemend.operators.repair import PREDICTIONS, Context, select_failed
from treemend.session import cut_lineage

# predictions whose reach is known; user predictions added later rewrite the whole index
BUILT_IN = tuple(PREDICTIONS)


def prediction_order(rules: Sequence[Rule]) -> list[Rule]:
    """Active prediction rules in their order."""
    chosen = [r for r in numbered(list(rules)) if r.rule_type == "Predictions" and r.active]
    for rule in chosen:
        if rule.function not in PREDICTIONS:
            raise ValueError(f"rule {rule.key}: unknown prediction {rule.function!r}")
    return sorted(chosen, key=lambda r: (r.order, r.rule_id))


def touched_types(rule: Rule, taxonomy: Taxonomy) -> list[str] | None:
    """Data types a prediction can change or add to; None when it is not known."""
    if rule.function == "DeleteDataObject":
        node = taxonomy.find(rule.data_type)
        return [node.name, *(n for c in node.children for d in c.walk() for n in (d.name, d.group_name))]
    if rule.function == "PredictMissingDataObjects":
        child = taxonomy.find(rule.parameters()["DataType"])
        return [rule.data_type, child.name, child.group_name]
    return [rule.data_type] if rule.function in BUILT_IN else None


def run_predictions(idx: DataFrame, rules: Sequence[Rule], context: Context) -> tuple[DataFrame, DataFrame]:
    """(repaired index, corrected): ``corrected`` is (rule_key, node_path).

    After each rule that had something to do the record types it touches are
    written anew, by type; all other types are read from where they were. The
    plan stays short and a lost executor does not replay the whole chain.
    """
    corrected = idx.select(F.lit("").alias("rule_key"), "node_path").limit(0)
    current = base = idx
    moved: set[str] = set()  # types no longer read from the base
    parts: list[tuple[set[str], DataFrame]] = []  # types and where they are now
    ordered = prediction_order(rules)
    # one job tells which rules have nothing to do; a flag that another prediction sets may appear later
    open_ = idx.filter(has_doc()).select("data_type", F.explode("qc").alias("flag"))
    open_ = {(r["data_type"], r["flag"]) for r in open_.filter(F.col("flag").isin([r.fail_rule for r in ordered])).distinct().collect()} if ordered else set()
    set_later, changed, unknown = {r.key for r in ordered}, False, False
    for rule in ordered:
        if (rule.data_type, rule.fail_rule) not in open_ and rule.fail_rule not in set_later and not unknown:
            continue
        if (changed or (rule.data_type, rule.fail_rule) not in open_) and select_failed(current, rule).isEmpty():
            continue
        changed = True
        after = PREDICTIONS[rule.function](current, rule, context)
        types = touched_types(rule, context.taxonomy)
        if types is None:
            # a prediction of one's own may set any flag
            unknown = True
            after = rest = base = cut_lineage(after, "data_type")
            moved, parts = set(), []
        else:
            after = after.filter(F.col("data_type").isin(types))
            after = cut_lineage(after, "data_type" if len(types) > 1 else None)
            moved |= set(types)
            # earlier parts keep the types this rule left alone
            parts = [(left, df.filter(F.col("data_type").isin(sorted(left)))) for held, df in parts if (left := held - set(types))]
            parts.append((set(types), after))
            rest = base.filter(~F.col("data_type").isin(sorted(moved)))
            for _, df in parts:
                rest = rest.unionByName(df)
        done = after.filter(F.array_contains("qc", rule.key)).select("node_path")
        before = select_failed(current, rule).select("node_path")
        corrected = corrected.unionByName(
            before.join(done, "node_path", "left_semi").select(F.lit(rule.key).alias("rule_key"), "node_path")
        )
        current = rest
    return current, corrected
