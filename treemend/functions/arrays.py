"""Number arrays held as comma-joined text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.functions.values import is_blank, to_number
from treemend.model import NULL_NUMBER
from treemend.scale import in_stretches

# Packing blocks hold up to 2 ** 12 sorted samples; they are built in parallel and then joined.
BLOCK_BITS = 12


def parse_array(text: Column) -> Column:
    """``"[1, 2,3]"`` as doubles; blanks dropped, any bad item gives [-99999]."""
    bare = F.regexp_replace(F.trim(text), r"^\[+|\]+$", "")
    items = F.filter(F.split(bare, ","), lambda x: ~is_blank(x))
    numbers = F.transform(items, to_number)
    bad = F.exists(numbers, lambda x: x.isNull())
    return F.when(bad, F.array(F.lit(NULL_NUMBER))).otherwise(numbers)


def parse_array_strict(text: Column) -> Column:
    """The same without brackets; blank text is empty, a bad item is an error."""

    def item(x: Column) -> Column:
        number = to_number(x)
        return F.when(number.isNotNull(), number).otherwise(
            F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")
        )

    return F.when(is_blank(text), F.array().cast("array<double>")).otherwise(F.transform(F.split(text, ","), item))


def array_table(df: DataFrame, first: Column, second: Column, keep: Sequence[str], names=("first", "second")) -> DataFrame:
    """Two array texts as rows (position, first, second), cut to the shorter array."""
    pairs = df.select(*keep, parse_array(first).alias("_a"), parse_array(second).alias("_b"))
    size = F.least(F.size("_a"), F.size("_b"))
    zipped = F.slice(F.arrays_zip("_a", "_b"), F.lit(1), size)
    return pairs.select(*keep, F.posexplode(zipped).alias("position", "_z")).select(
        *keep, "position", F.col("_z._a").alias(names[0]), F.col("_z._b").alias(names[1])
    )


def pack_curves(
    samples: DataFrame,
    keys: Sequence[str],
    index: str = "INDEX_VALUE",
    value: str = "MEASURED_VALUE",
    tie: str | None = None,
    text=lambda c: c.cast("string"),
) -> DataFrame:
    """Samples as two ``", "``-joined texts per curve, ordered by index value.

    Samples are sorted in stretches, and blocks of neighbours in a stretch are
    joined first, however densely they lie; the last step only strings finished
    pieces together. A packed curve is one value of the record, as the
    model wants it: beyond 2 GB of text it cannot be held, and the job fails.
    """
    order = [F.col("_o0"), F.col("_o1"), F.col("_i"), F.col("_v")]
    rows = samples.select(
        *keys, F.col(index).alias("_o0"), F.col(tie or value).alias("_o1"), text(F.col(index)).alias("_i"), text(F.col(value)).alias("_v")
    )
    rows = in_stretches(rows, [*[F.col(k) for k in keys], *order])
    block = F.shiftright("_at", BLOCK_BITS).alias("_block")
    rows = rows.select(*keys, block, F.struct(F.col("_at"), F.col("_i").alias("i"), F.col("_v").alias("v")).alias("_s"))
    pieces = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    pieces = pieces.select(
        *keys, F.struct("_block", F.array_join("_s.i", ", ").alias("i"), F.array_join("_s.v", ", ").alias("v")).alias("_p")
    )
    whole = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return whole.select(*keys, F.array_join("_p.i", ", ").alias(index), F.array_join("_p.v", ", ").alias(value))
