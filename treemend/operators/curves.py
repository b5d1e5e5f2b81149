"""Curve smoothing, sample lookup and log depths.

A curve is a set of rows (series keys, dense 0-based position, value). All
frames are bounded and computed in blocks with a halo, running numbers carry
over between blocks: no task needs a whole curve.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treemend.functions.arrays import parse_array_strict
from treemend.functions.docs import attr_text, attributes
from treemend.functions.values import is_blank
from treemend.scale import in_stretches, running_sum, with_halo
from treemend.session import cut_lineage

# Frame width in samples, cutoff in standard deviations.
HAT_WINDOW = 25
STD_WEIGHT = 2.0


def with_end(samples: DataFrame, series: Sequence[str], position: str) -> DataFrame:
    """Add ``_end``, the last position of the curve."""
    if "_end" in samples.columns:
        return samples
    ends = samples.groupBy(*series).agg(F.max(position).alias("_end"))
    return samples.join(ends, list(series))


def hat_stats(samples: DataFrame, series: Sequence[str], position: str, value: str, window: int = HAT_WINDOW) -> DataFrame:
    """Mean and deviation of the trailing, centred and leading frame per sample.

    The last sample of a curve is never inside a frame; null samples are
    ignored; an empty frame gives null.
    """
    half = window // 2
    rows = with_end(samples, series, position)
    rows = rows.withColumn("_v", F.when(F.col(position) < F.col("_end"), F.col(value)))
    rows = with_halo(rows, position, window)
    base = Window.partitionBy(*series, "_block").orderBy(position)
    v = F.col("_v")
    out = rows
    for name, low, high in (("trailing", -window, -1), ("centred", -half, half - 1), ("leading", 0, window - 1)):
        frame = base.rowsBetween(low, high)
        out = out.withColumn(f"{name}_avg", F.avg(v).over(frame)).withColumn(f"{name}_std", F.stddev_samp(v).over(frame))
    keep = [] if "_end" in samples.columns else ["_end"]
    return out.filter("_home").drop("_v", "_block", "_home", *keep)


def segments(
    samples: DataFrame,
    series: Sequence[str],
    position: str,
    value: str,
    window: int = HAT_WINDOW,
    weight: float = STD_WEIGHT,
) -> DataFrame:
    """Add ``segment``: a new one starts where leading/centred deviation is extreme.

    A curve with an infinite ratio has no finite cutoff and stays in one segment.
    """
    stats = hat_stats(samples, series, position, value, window)
    ratio = F.when(
        F.col("centred_std") == 0, F.when(F.col("leading_std") > 0, F.lit(float("inf")))
    ).otherwise(F.try_divide("leading_std", "centred_std"))
    # read for the limits, for the carries and for the result: computed once
    rated = cut_lineage(stats.withColumn("ratio", ratio))
    finite = F.when(F.col("ratio") < float("inf"), F.col("ratio"))
    limits = rated.groupBy(*series).agg(
        (F.avg(finite) + weight * F.stddev_samp(finite)).alias("_limit"),
        F.max(F.coalesce(F.col("ratio") == float("inf"), F.lit(False))).alias("_open"),
    )
    rated = rated.join(limits, list(series))
    starts = (~F.col("_open")) & (F.col("ratio") > F.col("_limit"))
    rated = rated.withColumn("_start", F.coalesce(starts, F.lit(False)).cast("int"))
    return running_sum(rated, series, position, "_start", "segment").drop("_limit", "_open", "_start")


def smooth(samples: DataFrame, series: Sequence[str], position: str, value: str) -> DataFrame:
    """Add ``smoothed``: the mean of the sample's segment.

    The last sample belongs to no segment and stays null. A break at the very
    first sample leaves the whole curve unsmoothed.
    """
    cut = segments(with_end(samples, series, position), series, position, value)
    inner = F.col(position) < F.col("_end")
    means = cut.groupBy(*series, "segment").agg(F.avg(F.when(inner, F.col(value))).alias("_mean"))
    broken = cut.filter((F.col(position) == 0) & (F.col("segment") > 0)).select(*series, F.lit(True).alias("_broken"))
    out = cut.join(means, [*series, "segment"]).join(broken, list(series), "left")
    return out.withColumn("smoothed", F.when(inner & F.col("_broken").isNull(), F.col("_mean"))).drop("_end", "_mean", "_broken")


def sample_lookup(
    picks: DataFrame,
    samples: DataFrame,
    series: Sequence[str],
    depth: str,
    index: str,
    position: str,
) -> DataFrame:
    """Add ``position`` of the sample whose interval [index, next index) holds the depth; of several the first by position.

    The next index is that of the next position; where it does not ascend, the
    interval is empty. A depth in no interval that equals the last sample's
    index gets that sample; anything else gives null, and so do null depths. An
    index may fall, repeat and start again. Intervals are stabbed by a sweep:
    distinct depths and interval starts are sorted together in stretches of
    equal length, each stretch keeps its open intervals in a heap by position,
    and only intervals that are still open at a stretch's end go on to the
    later ones they reach, those without an earlier one that reaches as far
    left out.
    """
    series = list(series)
    points = samples.select(*series, F.col(index).cast("double").alias("_d"), F.col(position).cast("long").alias("_pos"))
    after = points.select(*series, F.col("_d").alias("_end"), (F.col("_pos") - 1).alias("_pos"))
    intervals = points.join(after, [*series, "_pos"]).filter((F.col("_d") < F.col("_end")) & ~F.isnan("_end"))
    spans = points.groupBy(*series).agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"), F.max("_pos").alias("_last"), F.max_by("_d", "_pos").alias("_last_d"))
    spans = cut_lineage(spans)
    wanted = picks.select(*series, F.col(depth).cast("double").alias("_d")).distinct().join(spans, series)
    wanted = wanted.filter((F.col("_d") >= F.col("_low")) & (F.col("_d") <= F.col("_high")))
    none = F.lit(None)
    rows = intervals.select(*series, "_d", F.lit(0).alias("_ask"), "_pos", "_end").unionByName(
        wanted.select(*series, "_d", F.lit(1).alias("_ask"), none.cast("long").alias("_pos"), none.cast("double").alias("_end"))
    )
    rows = in_stretches(rows, [F.col(c) for c in (*series, "_d", "_ask", "_pos")])
    # what is open at the end of a stretch: an interval counts where none before it in the curve reaches as far
    stretch = cut_lineage(rows.groupBy(*series, "_t").agg(F.min("_d").alias("_from"), F.max("_d").alias("_upto")))
    crossing = rows.filter("_ask = 0").join(stretch, [*series, "_t"]).filter(F.col("_end") > F.col("_upto"))
    reach = F.max("_end").over(Window.partitionBy(*series, "_t").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1))
    crossing = crossing.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("_end") > F.col("_reach")))
    later = stretch.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(series)], F.col("_t").alias("_to"), F.col("_from").alias("_begins"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(series)])
    carried = crossing.join(later, same & (F.col("_to") > F.col("_t")) & (F.col("_begins") < F.col("_end")))
    carried = carried.select(*series, F.lit(float("-inf")).alias("_d"), F.lit(0).alias("_ask"), "_pos", "_end", F.col("_to").alias("_t"))
    names = [*series, "_d", "_ask", "_pos", "_end", "_t"]
    dealt = rows.select(*names).unionByName(carried.select(*names)).repartition("_t", *series).sortWithinPartitions("_t", *series, "_d", "_ask", "_pos")
    kinds = dict(dealt.dtypes)
    found = dealt.mapInArrow(_swept(len(series)), ", ".join([*[f"`{c}` {kinds[c]}" for c in series], "_ask_d double", "_found long"]))
    # the last sample holds its own index and nothing above
    found = wanted.select(*series, "_d", "_last", "_last_d").join(found.withColumnRenamed("_ask_d", "_d"), [*series, "_d"], "left")
    found = found.select(*series, F.col("_d").alias("_ask"), F.coalesce("_found", F.when(F.col("_d") == F.col("_last_d"), F.col("_last"))).alias(position))
    match = F.col("_depth") == F.col("_ask")
    left = picks.withColumn("_depth", F.col(depth).cast("double")).alias("p")
    right = found.alias("f")
    for s in series:
        match = match & (F.col(f"p.{s}") == F.col(f"f.{s}"))
    return left.join(right, match, "left").select(*[F.col(f"p.{c}").alias(c) for c in picks.columns], F.col(f"f.{position}"))


def _swept(keys: int):
    """Rows (series keys, _d, _ask, _pos, _end, _t) of stretches, sorted -> (series keys, depth asked for, first interval that holds it)."""

    def run(batches):
        at, heap = None, []
        for batch in batches:
            out: list[list] = [[] for _ in range(keys + 2)]
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                d, ask, pos, end, t = row[keys:]
                if (t, row[:keys]) != at:
                    at, heap = (t, row[:keys]), []
                if not ask:
                    heapq.heappush(heap, (pos, end))
                    continue
                while heap and heap[0][1] <= d:
                    heapq.heappop(heap)
                if heap:
                    for values, v in zip(out, (*row[:keys], d, heap[0][0])):
                        values.append(v)
            if out[0]:
                types = [*[batch.schema.field(i).type for i in range(keys)], pa.float64(), pa.int64()]
                names = [*[batch.schema.field(i).name for i in range(keys)], "_ask_d", "_found"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, types)], names=names)

    return run


def log_depths(doc, attribute: str):
    """MIN_INDEX or MAX_INDEX from the index array; null when it is empty."""
    text = attr_text(attributes(doc), "INDEX_VALUE")
    values = parse_array_strict(text)
    pick = F.array_min(values) if attribute == "MIN_INDEX" else F.array_max(values)
    return F.when(~is_blank(text), pick)
