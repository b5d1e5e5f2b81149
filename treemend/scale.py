"""Shuffle patterns that stay balanced when one group holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemend.session import cut_lineage

# Rows per block when a long ordered series is cut into independent pieces.
BLOCK_ROWS = 4096
# Rows of a table about files or splits, some hundred bytes each, up to which it goes to every task; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def in_stretches(df: DataFrame, sort: Sequence[Column]) -> DataFrame:
    """The rows range-partitioned and sorted, written once; ``_at`` ascends in that order and ``_t`` is the stretch.

    Stretches are about equally long whatever the values are: a hot group or an
    outlier only moves their borders. Rows equal in ``sort`` stay together.
    """
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(placed).withColumn("_t", F.shiftright("_at", 33))


def ordinal_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Add 1..n per group in the given order, as a long.

    Each stretch of the range-partitioned rows numbers its own rows and a carry
    per (stretch, group) completes the numbers, so no task needs a whole group.
    """
    keys = [*group]
    sort = [*[F.col(g) for g in group], *[F.col(o) if isinstance(o, str) else o for o in order]]
    rows = in_stretches(df, sort)
    starts = rows.groupBy(*keys, F.col("_t").alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        "_task",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    match = F.col("_t") == F.col("_task")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(starts, match).select(*[F.col(c) for c in df.columns], (F.col("_at") + F.col("_shift")).alias(out))


def broadcast_if_small(written: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast when it has at most ``most`` of them."""
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def pin_splits(spark: SparkSession) -> None:
    """From now on files are cut into the same splits however many executors there are, unless the session says how."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def first_by(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the order, by aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), order).alias("_row"))
        .select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])
    )


def with_halo(df: DataFrame, position: str, reach: int, block: str = "_block", home: str = "_home") -> DataFrame:
    """Copy each row to the blocks whose frames can see it.

    ``position`` is a dense 0-based position in its series. A frame of at most
    ``reach`` rows to either side computed inside one block is exact for the
    rows at home there; the copies (2*reach per block) only feed frames.
    """
    size = max(BLOCK_ROWS, 8 * reach)
    own = F.floor(F.col(position) / size)
    low = F.floor((F.col(position) - reach) / size)
    high = F.floor((F.col(position) + reach) / size)
    return (
        df.withColumn(block, F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
        .withColumn(home, F.col(block) == own)
    )


def running_sum(df: DataFrame, series: Sequence[str], position: str, value: str, out: str) -> DataFrame:
    """Running sum along a series, block by block with a carry per block."""
    keys = [*series, "_blk"]
    rows = df.withColumn("_blk", F.floor(F.col(position) / BLOCK_ROWS))
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*series).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys)
        .agg(F.sum(value).alias("_s"))
        .select(*keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    )
    return (
        rows.join(carry, keys)
        .withColumn(out, F.sum(value).over(inside) + F.col("_carry"))
        .drop("_blk", "_carry")
    )


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; the job fails when a key occurs twice."""
    counts = df.groupBy(*[F.col(k).alias(f"_u{i}") for i, k in enumerate(keys)]).count()
    repeated = counts.filter(F.col("count") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"source has repeated keys {list(keys)}")
    return df
