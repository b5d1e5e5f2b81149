"""Map points and an interpolated surface over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.functions.docs import attr_number, with_attrs
from treemend.model import NULL_NUMBER
from treemend.operators.index import has_doc
from treemend.operators.neighbors import nearest

# Grid intervals, fewest points, neighbours, weighting power.
INTERVALS = 20
MIN_POINTS = 6
SURFACE_NEIGHBORS = 5
SURFACE_POWER = 2


def map_points(idx: DataFrame, data_type: str, lat: str = "SURFACE_LATITUDE", lon: str = "SURFACE_LONGITUDE", z: str | None = None) -> DataFrame:
    """Plottable points of records without sentinels (and with a z value if asked)."""
    attrs = F.col("_attrs")
    rows = with_attrs(idx.filter((F.col("data_type") == data_type) & has_doc()).select("node_path", "data_name", "doc"))
    rows = rows.select(
        "node_path", "data_name", attr_number(attrs, lon).alias("lon"), attr_number(attrs, lat).alias("lat"),
        *([attr_number(attrs, z).alias("z")] if z else []),
    )
    for name in ["lon", "lat", *(["z"] if z else [])]:
        rows = rows.filter(F.col(name) != NULL_NUMBER)
    return rows


def surface_grid(points: DataFrame, intervals: int = INTERVALS) -> DataFrame:
    """(i, j, lat, lon): regular grid, at most intervals x intervals cells; none below six points."""
    box = points.agg(
        F.min("lat").alias("x0"), F.max("lat").alias("x1"), F.min("lon").alias("y0"), F.max("lon").alias("y1"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= MIN_POINTS)
    step = F.greatest((F.col("x1") - F.col("x0")) / intervals, (F.col("y1") - F.col("y0")) / intervals)
    # the quotient is a whole number up to rounding on the longer axis
    count = lambda a, b: F.ceil(F.round((F.col(b) - F.col(a)) / F.col("step"), 9)).cast("int")
    box = box.withColumn("step", step).filter(F.col("step") > 0)
    box = box.withColumn("nx", count("x0", "x1")).withColumn("ny", count("y0", "y1"))
    cells = box.filter((F.col("nx") > 0) & (F.col("ny") > 0)).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))
    ).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    # both ends of an axis are grid lines: n points over n steps
    at = lambda low, n, pos: F.col(low) + F.coalesce(F.try_divide(F.col("step") * F.col(n), F.col(n) - 1), F.lit(0.0)) * F.col(pos)
    return cells.select("i", "j", at("x0", "nx", "i").alias("lat"), at("y0", "ny", "j").alias("lon"))


def surface_idw(grid: DataFrame, points: DataFrame, k: int = SURFACE_NEIGHBORS, power: int = SURFACE_POWER) -> DataFrame:
    """(i, j, value): the value of an exact hit, else the weighted mean of the k nearest."""
    targets = grid.select(F.concat_ws(",", "i", "j").alias("tid"), F.lit("g").alias("grp"), "lat", "lon")
    candidates = points.select(F.col("pid").alias("cid"), F.lit("g").alias("grp"), "lat", "lon", "z")
    near = nearest(targets, candidates, k, metric="planar", payload=["z"], exclude_self=False)
    hit = F.col("distance") == 0
    weight = F.when(~hit, 1 / F.pow(F.col("distance"), power))
    out = near.groupBy("tid").agg(
        F.min_by("z", F.when(hit, F.col("rank"))).alias("_hit"),
        F.max(hit).alias("_exact"),
        (F.sum(F.col("z") * weight) / F.sum(weight)).alias("_mean"),
    )
    value = F.when(F.col("_exact"), F.col("_hit")).otherwise(F.col("_mean"))
    at = F.split("tid", ",")
    return out.select(at[0].cast("int").alias("i"), at[1].cast("int").alias("j"), value.alias("value"))


