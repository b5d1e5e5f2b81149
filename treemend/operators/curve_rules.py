"""Spike detection in log curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemend.functions.docs import attr_number, attr_text, with_attrs
from treemend.functions.values import to_number
from treemend.model import NULL_CURVE, Rule
from treemend.operators.index import has_doc
from treemend.operators.row_rules import rule_filter
from treemend.scale import with_halo

# Default reach to each side and severity in standard deviations.
WINDOW_SIZE = 5
SEVERITY_SIZE = 4.0
# A constant window has a standard deviation of rounding noise only.
ROUNDING = 1e-9


def spike_samples(samples: DataFrame, series: list[str], position: str, value: str, window: int, severity: float) -> DataFrame:
    """Add ``is_spike``. ``value`` is null where the curve has no value.

    Curves are cut into blocks with a halo as wide as the window, so a very
    long curve spreads over many tasks.
    """
    blocks = with_halo(samples, position, window)
    frame = Window.partitionBy(*series, "_block").orderBy(position).rowsBetween(-window, window)
    v = F.col(value)
    spike = (F.count(v).over(frame) > 2) & (F.abs(v - F.avg(v).over(frame)) > F.stddev_samp(v).over(frame) * severity + ROUNDING)
    return blocks.withColumn("is_spike", F.coalesce(spike, F.lit(False))).filter("_home").drop("_block", "_home")


def spike_parameters(rule: Rule) -> tuple[int, float]:
    params = rule.parameters()
    return int(params.get("WindowSize") or WINDOW_SIZE), float(params.get("SeveritySize") or SEVERITY_SIZE)


def null_value(attrs: Column) -> Column:
    return F.coalesce(attr_number(attrs, "NULL_REPRESENTATION"), F.lit(NULL_CURVE))


def curve_spikes(idx: DataFrame, rule: Rule) -> DataFrame:
    """Curves with at least one spike; an array that does not parse passes."""
    window, severity = spike_parameters(rule)
    attrs = F.col("_attrs")
    curves = (
        with_attrs(idx.filter((F.col("data_type") == rule.data_type) & has_doc()).select("node_path", "doc"))
        .filter(rule_filter(attrs, rule))
        .select(
            "node_path",
            null_value(attrs).alias("_null"),
            F.transform(F.split(attr_text(attrs, "MEASURED_VALUE"), ","), to_number).alias("_values"),
        )
        .filter(~F.exists("_values", lambda x: x.isNull()))
    )
    samples = curves.select("node_path", "_null", F.posexplode("_values").alias("_pos", "_v")).select(
        "node_path", "_pos", F.when(F.col("_v") != F.col("_null"), F.col("_v")).alias("_v")
    )
    spikes = spike_samples(samples, ["node_path"], "_pos", "_v", window, severity)
    return spikes.filter("is_spike").select("node_path").distinct()
