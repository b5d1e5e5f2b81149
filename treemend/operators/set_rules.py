"""Rules that compare records with other records; each returns failed paths."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.functions.docs import attr_text, has_attr, with_attrs
from treemend.functions.values import normalize, normalize14, sha256_key, to_number
from treemend.model import AccessDef, Rule, Taxonomy, split_list
from treemend.operators.curve_rules import curve_spikes
from treemend.operators.index import has_doc, owners
from treemend.operators.row_rules import incomplete, rule_filter
from treemend.scale import first_by

# Fixed value: largest difference of two equal numbers.
TOLERANCE = 1e-7


def key_text(attrs: Column, params: str) -> Column:
    """Concatenated key attributes, each optionally normalised."""
    parts = []
    for item in split_list(params, ";"):
        if item.startswith("*"):
            function, inner = item.split("(", 1)
            arguments = next(csv.reader([inner.rsplit(")", 1)[0]]))
            text = attr_text(attrs, arguments[0].strip())
            if function == "*NORMALIZE":
                text = normalize(text, arguments[1] if len(arguments) > 1 else None)
            elif function == "*NORMALIZE14":
                text = normalize14(text)
        else:
            text = attr_text(attrs, item)
        parts.append(text)
    return F.concat(*parts) if parts else F.lit("")


def uniq_key(attrs: Column, params: str) -> Column:
    """sha256 of the key text; null when it is empty."""
    text = key_text(attrs, params)
    return F.when(F.length(text) > 0, sha256_key(text))


def rows_of(idx: DataFrame, rule: Rule) -> DataFrame:
    """Live records of the rule's type with their attributes."""
    return with_attrs(idx.filter((F.col("data_type") == rule.data_type) & has_doc()))


def uniqueness(idx: DataFrame, rule: Rule) -> DataFrame:
    """Key occurs more than once. Twins count even when the filter skips them.

    Keys are counted with map-side combine; the join back is on keys unique on
    one side, so AQE can split a hot key.
    """
    keyed = rows_of(idx, rule).select("node_path", uniq_key(F.col("_attrs"), rule.params).alias("_key"), rule_filter(F.col("_attrs"), rule).alias("_in"))
    keyed = keyed.filter(F.col("_key").isNotNull())
    repeated = keyed.groupBy("_key").count().filter(F.col("count") > 1)
    return keyed.filter("_in").join(repeated, "_key", "left_semi").select("node_path")


def consistency(idx: DataFrame, rule: Rule, source: DataFrame, access: AccessDef) -> DataFrame:
    """Same key in another source carries another value (first match by value order)."""
    keys = list(access.keys)
    numeric = access.types.get(rule.attribute) == "number"
    other = source.select(*[F.col(k).cast("string").alias(f"_r{i}") for i, k in enumerate(keys)], F.col(rule.attribute).cast("string").alias("_ref"))
    other = first_by(other, [f"_r{i}" for i in range(len(keys))], F.coalesce("_ref", F.lit("")))
    attrs = F.col("_attrs")
    own = rows_of(idx, rule).filter(rule_filter(attrs, rule)).select(
        "node_path",
        attr_text(attrs, rule.attribute).alias("_own"),
        has_attr(attrs, rule.attribute).alias("_present"),
        *[attr_text(attrs, k).alias(f"_k{i}") for i, k in enumerate(keys)],
    )
    own = own.filter(F.col("_present") & ~incomplete(F.col("_own")))
    match = None
    for i in range(len(keys)):
        term = F.col(f"_k{i}") == F.col(f"_r{i}")
        match = term if match is None else match & term
    own_text, ref = F.col("_own"), F.col("_ref")
    if numeric:
        differs = F.coalesce(F.abs(to_number(ref) - to_number(own_text)) > TOLERANCE, F.lit(False))
    else:
        differs = own_text != ref
    return own.join(other, match).filter(~incomplete(ref) & differs).select("node_path")


def entirety(idx: DataFrame, rule: Rule, level: int) -> DataFrame:
    """No descendant of the wanted type and name."""
    params = rule.parameters()
    rows = rows_of(idx, rule).filter(rule_filter(F.col("_attrs"), rule)).select("node_path")
    return rows.join(owners(idx, params["DataType"], params["Name"], level), "node_path", "left_anti")


def set_failures(
    idx: DataFrame,
    rule: Rule,
    taxonomy: Taxonomy,
    access: Mapping[str, AccessDef],
    sources: Mapping[str, DataFrame],
) -> DataFrame:
    if rule.function == "Uniqueness":
        return uniqueness(idx, rule)
    if rule.function == "Consistency":
        name = rule.parameters().get("Source")
        if name not in sources:
            raise ValueError(f"rule {rule.key}: unknown consistency source {name!r}")
        return consistency(idx, rule, sources[name], access[rule.data_type])
    if rule.function == "Entirety":
        return entirety(idx, rule, taxonomy.level_of(rule.data_type))
    if rule.function == "CurveSpikes":
        return curve_spikes(idx, rule)
    return SET_CHECKS[rule.function](idx, rule)


# User checks over sets: (index, rule) -> DataFrame(node_path).
SET_CHECKS: dict[str, Callable[[DataFrame, Rule], DataFrame]] = {}
BUILT_IN_SET_RULES = ("Uniqueness", "Consistency", "Entirety", "CurveSpikes")


def is_set_rule(rule: Rule) -> bool:
    return rule.function in BUILT_IN_SET_RULES or rule.function in SET_CHECKS
