"""Duplicate wells kept in a work table (ukey, uwi, valid)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_duplicates(df: DataFrame, key: str, out: str = "dup") -> DataFrame:
    """``Y`` where the key occurs more than once, else null. Counts combine before the shuffle."""
    repeated = df.groupBy(F.col(key).alias("_k")).count().filter(F.col("count") > 1).select("_k")
    return df.join(repeated, F.col(key) == F.col("_k"), "left").withColumn(
        out, F.when(F.col("_k").isNotNull(), F.lit("Y"))
    ).drop("_k")


def curve_fate(curves: DataFrame, wells: DataFrame) -> DataFrame:
    """(uwi, curve_id, drop, good_uwi) for every curve of a work-table well."""
    held = curves.select("uwi", "curve_id").distinct().join(wells.select("uwi", "ukey", "valid"), "uwi")
    shared = held.groupBy("ukey", "curve_id").agg(F.count(F.lit(1)).alias("_c"))
    good = wells.groupBy("ukey").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("valid") == "Y", F.col("uwi"))).alias("_good")
    )
    good = good.filter((F.col("_n") > 1) & F.col("_good").isNotNull()).select("ukey", "_good")
    invalid = held.filter(F.col("valid") == "N").join(shared, ["ukey", "curve_id"]).join(good, "ukey", "left")
    invalid = invalid.select("uwi", "curve_id", "ukey", "_c", "_good")
    return invalid.select("uwi", "curve_id", (F.col("_c") > 1).alias("drop"), F.col("_good").alias("good_uwi"))


def fix_duplicate_curves(curves: DataFrame, values: DataFrame, wells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curves on both a valid and an invalid twin lose the invalid copy; other
    curves of invalid twins move to the valid well of the key."""
    fate = curve_fate(curves, wells)

    def rewrite(df: DataFrame) -> DataFrame:
        joined = df.join(fate, ["uwi", "curve_id"], "left").filter(~F.coalesce("drop", F.lit(False)))
        return joined.withColumn("uwi", F.coalesce("good_uwi", "uwi")).select(*df.columns)

    return rewrite(curves), rewrite(values)


def delete_duplicate_wells(wells: DataFrame, marks: DataFrame) -> DataFrame:
    """Drop wells marked duplicate and not valid."""
    gone = marks.filter((F.col("dup") == "Y") & (F.col("valid") == "N")).select("uwi")
    return wells.join(gone, "uwi", "left_anti")

