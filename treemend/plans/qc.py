"""Running rules over an index and writing their flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.functions.docs import attributes
from treemend.model import INDEX_COLUMNS, AccessDef, Rule, Taxonomy, numbered
from treemend.operators.index import has_doc
from treemend.operators.row_rules import ROW_CHECKS, rule_filter
from treemend.operators.set_rules import BUILT_IN_SET_RULES, is_set_rule, set_failures


def _checked(rules: Sequence[Rule], active_only: bool) -> list[Rule]:
    rules = numbered(list(rules))
    for rule in rules:
        if rule.rule_type == "Predictions":
            raise ValueError(f"rule {rule.key}: prediction rules are not allowed in a quality run")
        if not is_set_rule(rule) and rule.function not in ROW_CHECKS:
            raise ValueError(f"rule {rule.key}: unknown function {rule.function!r}")
    return [r for r in rules if r.active or not active_only]


def _row_hits(rules: list[tuple[int, Rule]]):
    """Array of (ord, rule_id, rule_key) of the failed row rules, in rule order."""
    hits = []
    for position, rule in rules:
        fails = (F.col("data_type") == rule.data_type) & rule_filter(F.col("_attrs"), rule) & ROW_CHECKS[rule.function](F.col("_attrs"), rule)
        hit = F.struct(F.lit(position).alias("ord"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.key).alias("rule_key"))
        hits.append(F.when(fails, hit))
    return F.array_compact(F.array(*hits))


def run_qc(
    idx: DataFrame,
    rules: Sequence[Rule],
    taxonomy: Taxonomy | None = None,
    access: Mapping[str, AccessDef] | None = None,
    sources: Mapping[str, DataFrame] | None = None,
    active_only: bool = True,
) -> DataFrame:
    """(ord, rule_id, rule_key, node_path) of every failure.

    All row rules of all types share one scan and one parse of each record.
    """
    chosen = list(enumerate(_checked(rules, active_only)))
    row_rules = [(i, r) for i, r in chosen if not is_set_rule(r)]
    parts = []
    if row_rules:
        types = sorted({r.data_type for _, r in row_rules})
        live = idx.filter(F.col("data_type").isin(types) & has_doc())
        parsed = live.select("node_path", "data_type", attributes(F.col("doc")).alias("_attrs"))
        parts.append(parsed.select("node_path", F.inline(_row_hits(row_rules))).select("ord", "rule_id", "rule_key", "node_path"))
    for position, rule in chosen:
        if is_set_rule(rule):
            failed = set_failures(idx, rule, taxonomy, access or {}, sources or {})
            parts.append(
                failed.select(
                    F.lit(position).alias("ord"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.key).alias("rule_key"), "node_path"
                )
            )
    if not parts:
        return idx.sparkSession.createDataFrame([], "ord int, rule_id int, rule_key string, node_path array<int>")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def close_qc(idx: DataFrame, failures: DataFrame) -> DataFrame:
    """Replace all flags by the keys of the failed rules, in rule order.

    A node fails each rule at most once, so its flag list is as long as the
    rule list at most.
    """
    flags = (
        failures.groupBy(F.col("node_path").alias("_id"))
        .agg(F.array_sort(F.collect_set(F.struct("ord", "rule_key"))).alias("_f"))
        .select("_id", F.col("_f.rule_key").alias("_flags"))
    )
    empty = F.array().cast("array<string>")
    return (
        idx.join(flags, F.col("node_path") == F.col("_id"), "left")
        .withColumn("qc", F.coalesce("_flags", empty))
        .select(*INDEX_COLUMNS)
    )


def flag_index(
    idx: DataFrame,
    rules: Sequence[Rule],
    taxonomy: Taxonomy | None = None,
    access: Mapping[str, AccessDef] | None = None,
    sources: Mapping[str, DataFrame] | None = None,
    active_only: bool = True,
) -> DataFrame:
    """``close_qc(run_qc(...))`` in one pass: row rules set flags in place,
    only failures of set rules are joined in."""
    chosen = list(enumerate(_checked(rules, active_only)))
    row_rules = [(i, r) for i, r in chosen if not is_set_rule(r)]
    set_rules = [r for _, r in chosen if is_set_rule(r)]
    order = {r.key: i for i, r in chosen}
    none = F.array().cast("array<struct<ord:int,rule_key:string>>")
    hits = F.transform(_row_hits(row_rules), lambda x: F.struct(x["ord"].alias("ord"), x["rule_key"].alias("rule_key"))) if row_rules else none
    types = sorted({r.data_type for _, r in row_rules})
    # only records that a row rule looks at are parsed: a curve's record may be megabytes
    looked_at = F.col("data_type").isin(types) & has_doc() if types else F.lit(False)
    own = F.when(looked_at, hits).otherwise(none)
    flagged = idx.withColumn("_attrs", F.when(looked_at, attributes(F.col("doc")))).withColumn("_hits", own).drop("_attrs")
    if set_rules:
        found = run_qc(idx, set_rules, taxonomy, access, sources, active_only=False)
        position = F.create_map(*[x for r in set_rules for x in (F.lit(r.key), F.lit(order[r.key]))])
        found = found.groupBy(F.col("node_path").alias("_id")).agg(
            F.collect_set(F.struct(position[F.col("rule_key")].alias("ord"), "rule_key")).alias("_more")
        )
        # the built-in rules fail records of their own type: all others need not meet the failures
        near = F.lit(True)
        if all(r.function in BUILT_IN_SET_RULES for r in set_rules):
            near = F.coalesce(F.col("data_type").isin(sorted({r.data_type for r in set_rules})), F.lit(False))
        met = flagged.filter(near).join(found, F.col("node_path") == F.col("_id"), "left")
        met = met.withColumn("_hits", F.concat("_hits", F.coalesce("_more", none))).select(*flagged.columns)
        flagged = met.unionByName(flagged.filter(~near))
    flags = F.transform(F.array_sort("_hits"), lambda x: x["rule_key"])
    return flagged.withColumn("qc", flags).select(*INDEX_COLUMNS)
