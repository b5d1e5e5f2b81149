"""Nearest neighbours and inverse-distance weighting.

Neighbours are found by descending a grid: every target keeps only the cells
that can hold one of its k nearest points, and cells are split eightfold per
axis until each holds few points. The work per target depends on k and on the
leaf size, not on how many points share a cell, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemend.functions.geo import EARTH_RADIUS, haversine
from treemend.model import NULL_NUMBER
from treemend.scale import broadcast_if_small
from treemend.session import cut_lineage

# Neighbours, weighting power, closest usable distance (m), twin distance (degrees).
NEIGHBORS = 24
IDW_POWER = 4
MIN_DISTANCE = 0.1
TWIN_DEGREES = 0.0001
MIN_NEIGHBORS = 3

LEAF_POINTS = 24
_BITS = 3
# Depth of the grid: 36 bits a side, cells of well under a metre on the globe. Deeper cells would not split points any
# more that differ by less; a cell of the last depth is joined whole, after points on one spot are cut to k + 1 ids.
_MAX_DEPTH = 12


def _planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def _bounds(metric: str) -> tuple[Column, Column]:
    """Least and greatest possible distance from the target to a cell's points."""
    if metric == "planar":
        def gap(p: str, lo: str, hi: str) -> tuple[Column, Column]:
            below, above = F.col(lo) - F.col(p), F.col(p) - F.col(hi)
            return F.greatest(below, above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))

        ny, fy = gap("lat", "lat_lo", "lat_hi")
        nx, fx = gap("lon", "lon_lo", "lon_hi")
        return F.sqrt(ny * ny + nx * nx), F.sqrt(fy * fy + fx * fx)
    # a straight line in degrees from the centre to any point of the box is no longer than this
    # reach (meridians count fully, parallels at most at their widest), and the great circle is shorter
    mid_lat = (F.col("lat_lo") + F.col("lat_hi")) / 2
    mid_lon = (F.col("lon_lo") + F.col("lon_hi")) / 2
    widest = F.when((F.col("lat_lo") < 0) & (F.col("lat_hi") > 0), F.lit(1.0)).otherwise(
        F.greatest(F.cos(F.radians("lat_lo")), F.cos(F.radians("lat_hi")))
    )
    reach = EARTH_RADIUS / 2 * F.sqrt(
        F.pow(F.radians(F.col("lat_hi") - F.col("lat_lo")), 2) + F.pow(widest * F.radians(F.col("lon_hi") - F.col("lon_lo")), 2)
    )
    centre = haversine(F.col("lat"), F.col("lon"), mid_lat, mid_lon)
    return F.greatest(centre - reach, F.lit(0.0)), centre + reach


def _prune(frontier: DataFrame, k: int, metric: str) -> DataFrame:
    """Drop cells that lie beyond the distance within which k points are certain."""
    near, far = _bounds(metric)
    sized = frontier.withColumn("_near", near).withColumn("_far", far)
    run = Window.partitionBy("tid").orderBy("_far", "cx", "cy", "cell_depth")
    sized = sized.withColumn("_cum", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    enough = F.min(F.when(F.col("_cum") >= k, F.col("_far"))).over(Window.partitionBy("tid"))
    sized = sized.withColumn("_limit", enough)
    slack = F.col("_limit") * (1 + 1e-9) + 1e-6
    return sized.filter(F.col("_limit").isNull() | (F.col("_near") <= slack)).drop("_near", "_far", "_cum", "_limit")


def nearest(
    targets: DataFrame,
    candidates: DataFrame,
    k: int = NEIGHBORS,
    metric: str = "sphere",
    payload: Sequence[str] = (),
    leaf: int = LEAF_POINTS,
    exclude_self: bool = True,
) -> DataFrame:
    """(tid, cid, n_lat, n_lon, distance, rank, payload) of the k nearest candidates.

    ``targets``: tid, grp, lat, lon. ``candidates``: cid, grp, lat, lon and the
    payload. With ``exclude_self`` a target never matches its own id. Distances are
    ordered to the micrometre, ties by id. Targets of one group on one spot are
    sought as one.
    """
    need = k + 1  # the target itself may be among the points
    # at one location only the lowest ids can be among the nearest; limited before the shuffle
    spot = Window.partitionBy("grp", "lat", "lon").orderBy("cid")
    points = candidates.select("cid", "grp", "lat", "lon", *payload).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    # narrow, and read once per depth: computed once
    points = cut_lineage(points.withColumn("_r", F.row_number().over(spot)).filter(F.col("_r") <= need).drop("_r"))
    box = points.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")).first()
    seekers = targets.select("tid", "grp", "lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if box["a"] is None:
        seekers = seekers.limit(0)
        box = {"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0}
    place = ["grp", "lat", "lon"]
    own = cut_lineage(seekers.groupBy("tid", *place).agg(F.count(F.lit(1)).cast("int").alias("_m")))
    seekers = cut_lineage(own.groupBy(*place).agg(F.min("tid").alias("tid")))
    height, width = max(box["b"] - box["a"], 1e-9), max(box["d"] - box["c"], 1e-9)

    def cell(value: str, low: float, size: float, depth: int) -> Column:
        parts = 1 << (_BITS * depth)
        return F.least(F.floor((F.col(value) - low) / size * parts), F.lit(parts - 1)).cast("long")

    def at_depth(df: DataFrame, depth: int) -> DataFrame:
        return df.withColumn("cx", cell("lon", box["c"], width, depth)).withColumn("cy", cell("lat", box["a"], height, depth))

    def cells(depth: int) -> DataFrame:
        return (
            at_depth(points, depth).groupBy("grp", "cx", "cy")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
                F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"),
            )
            .withColumn("cell_depth", F.lit(depth))
        )

    columns = ["tid", "grp", "lat", "lon", "cell_depth", "cx", "cy", "n", "lat_lo", "lat_hi", "lon_lo", "lon_hi"]
    # a group has at most 64 cells on the first depth
    frontier = cut_lineage(_prune(seekers.join(cells(1), "grp").select(*columns), need, metric))
    depth = 1
    used = [1]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while depth < _MAX_DEPTH and not frontier.filter((F.col("cell_depth") == depth) & (F.col("n") > leaf)).isEmpty():
        wide = (F.col("cell_depth") == depth) & (F.col("n") > leaf)
        # a row becomes up to 64: spread before, and met by cells where these are few
        opened = frontier.filter(wide).select("tid", "grp", "lat", "lon", F.col("cx").alias("px"), F.col("cy").alias("py")).repartition(tasks, "tid")
        below = cells(depth + 1).withColumn("px", F.shiftright("cx", _BITS)).withColumn("py", F.shiftright("cy", _BITS))
        below = broadcast_if_small(cut_lineage(below))
        split = opened.join(below, ["grp", "px", "py"]).select(*columns)
        frontier = cut_lineage(_prune(frontier.filter(~wide).unionByName(split), need, metric))
        depth += 1
        used.append(depth)

    parts = [
        at_depth(points, d).select("cid", "grp", F.lit(d).alias("cell_depth"), "cx", "cy", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"), *payload)
        for d in used
    ]
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    pairs = frontier.select("tid", "grp", "lat", "lon", "cell_depth", "cx", "cy").join(placed, ["grp", "cell_depth", "cx", "cy"])
    distance = haversine if metric == "sphere" else _planar
    pairs = pairs.withColumn("distance", distance(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon")))
    by_distance = Window.partitionBy("tid").orderBy(F.round("distance", 6 if metric == "sphere" else 9), "cid")
    near = pairs.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= need)
    found = F.array_sort(F.collect_list(F.struct("rank", "cid", "n_lat", "n_lon", "distance", *payload)), lambda a, b: a["rank"] - b["rank"])
    lists = near.groupBy(*place).agg(found.alias("_near"))
    if exclude_self:
        rows = own.join(lists, place).select("tid", "_m", F.filter("_near", lambda x: x["cid"] != F.col("tid")).alias("_near"))
    else:
        rows = own.join(lists, place)
    # a target given more than once finds each neighbour as often
    often = F.when(F.col("_m") > 1, F.flatten(F.transform("_near", lambda x: F.array_repeat(x, F.col("_m"))))).otherwise(F.col("_near"))
    rows = rows.select("tid", F.posexplode(F.slice(often, 1, k)).alias("_at", "_n"))
    return rows.select("tid", "_n.cid", "_n.n_lat", "_n.n_lon", "_n.distance", (F.col("_at") + 1).alias("rank"), *[F.col("_n")[c].alias(c) for c in payload])


def idw(neighbors: DataFrame, depth: str = "depth", power: int = IDW_POWER) -> DataFrame:
    """(tid, value, n_used): weighted mean over usable neighbours, at least three.

    Unusable: sentinel location, a twin of the previous row in distance order,
    almost no distance, missing depth.
    """
    order = Window.partitionBy("tid").orderBy("rank")
    twin = (F.abs(F.col("n_lat") - F.lag("n_lat").over(order)) < TWIN_DEGREES) & (
        F.abs(F.col("n_lon") - F.lag("n_lon").over(order)) < TWIN_DEGREES
    )
    nowhere = (F.col("n_lat") == NULL_NUMBER) & (F.col("n_lon") == NULL_NUMBER)
    usable = neighbors.withColumn("_twin", F.coalesce(twin, F.lit(False))).filter(
        ~nowhere & ~F.col("_twin") & (F.col("distance") >= MIN_DISTANCE)
        & F.col(depth).isNotNull() & (F.col(depth) != NULL_NUMBER)
    )
    weight = 1 / F.pow(F.col("distance"), power)
    return (
        usable.groupBy("tid")
        .agg((F.sum(F.col(depth) * weight) / F.sum(weight)).alias("value"), F.count(F.lit(1)).alias("n_used"))
        .filter(F.col("n_used") >= MIN_NEIGHBORS)
    )
