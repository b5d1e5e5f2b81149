"""Rules decided by one record: each builds a boolean "fails" Column.

``attrs`` is the text map of a record. What a missing attribute does differs
per rule and is stated with each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from treemend.functions.docs import attr_number, attr_text, has_attr
from treemend.functions.values import is_blank, to_number
from treemend.model import NULL_NUMBER, Rule

RowCheck = Callable[[Column, Rule], Column]


def incomplete(text: Column) -> Column:
    """Blank, or the missing-number sentinel."""
    return is_blank(text) | F.coalesce(to_number(text) == NULL_NUMBER, F.lit(False))


def rule_filter(attrs: Column, rule: Rule) -> Column:
    """Rows a rule looks at. A filter without exactly one ``=`` keeps none."""
    if not rule.filter:
        return F.lit(True)
    parts = rule.filter.split("=")
    if len(parts) != 2:
        return F.lit(False)
    name, value = parts[0].strip(), parts[1].strip()
    return has_attr(attrs, name) & (attr_text(attrs, name) == value)


def completeness(attrs: Column, rule: Rule) -> Column:
    """Blank or -99999; a missing attribute passes."""
    return has_attr(attrs, rule.attribute) & incomplete(attr_text(attrs, rule.attribute))


def _bound(value: object, default: float) -> float:
    text = str(value).strip().replace(",", "")
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else default


def validity_range(attrs: Column, rule: Rule) -> Column:
    """Number outside the inclusive range; a non-number passes."""
    params = rule.parameters()
    low = _bound(params.get("MinRange"), -99999.0)
    high = _bound(params.get("MaxRange"), 99999.0)
    number = attr_number(attrs, rule.attribute)
    return F.coalesce((number < low) | (number > high), F.lit(False))


def is_number(attrs: Column, rule: Rule) -> Column:
    """Text is not all digits; a missing attribute passes."""
    text = attr_text(attrs, rule.attribute)
    return has_attr(attrs, rule.attribute) & ~text.rlike("^[0-9]+$")


def string_length(attrs: Column, rule: Rule) -> Column:
    """Trimmed length outside [Min, Max]; a missing attribute fails."""
    params = rule.parameters()
    # Both limits default to 20; 0 means not set.
    low = int(params.get("Min") or 20)
    high = int(params.get("Max") or (low if params else 20))
    length = F.length(F.regexp_replace(attr_text(attrs, rule.attribute), r"^\s+|\s+$", ""))
    return ~has_attr(attrs, rule.attribute) | (length < low) | (length > high)


def is_equal_to(attrs: Column, rule: Rule) -> Column:
    """Text is none of the listed values; a missing attribute passes."""
    params = rule.parameters()
    delimiter = params.get("Delimiter") or ","
    value = params.get("Value")
    allowed = [v.strip() for v in value.split(delimiter if len(delimiter) == 1 else ",")] if value else [""]
    text = F.regexp_replace(attr_text(attrs, rule.attribute), r"^\s+|\s+$", "")
    return has_attr(attrs, rule.attribute) & ~text.isin(allowed)


def is_greater_than(attrs: Column, rule: Rule) -> Column:
    """Number below Value (equal passes); a non-number or missing passes."""
    low = _bound(rule.parameters().get("Value"), 0.0)
    return F.coalesce(attr_number(attrs, rule.attribute) < low, F.lit(False))


ROW_CHECKS: dict[str, RowCheck] = {
    "Completeness": completeness,
    "ValidityRange": validity_range,
    "IsNumber": is_number,
    "StringLength": string_length,
    "IsEqualTo": is_equal_to,
    "IsGreaterThan": is_greater_than,
}


def register_check(name: str, check: RowCheck) -> None:
    """Add a user check; rules refer to it by name."""
    ROW_CHECKS[name] = check
