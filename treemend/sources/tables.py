"""Table scans with a declared column list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemend.model import AccessDef


def scan_table(table: DataFrame, columns: list[str] | AccessDef, where: str | None = None) -> DataFrame:
    """Declared columns of the rows matching a raw condition; both reach the scan."""
    names = columns.columns if isinstance(columns, AccessDef) else columns
    rows = table.where(where) if where else table
    return rows.select(*[F.col(n) for n in names])


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | AccessDef, where: str | None = None) -> DataFrame:
    return scan_table(spark.read.parquet(path), columns, where)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    access: AccessDef,
    where: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
    single_task: bool = False,
    **options: str,
) -> DataFrame:
    """The same over JDBC, read in parallel along a partition column.

    Without a column and its bounds one task would read the whole table; that
    must be asked for with ``single_task``, for small tables.
    """
    if not (partition_column and bounds) and not single_task:
        raise ValueError("give partition_column and bounds, or single_task=True for a small table")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", access.table).options(**options)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", str(partitions))
        )
    return scan_table(reader.load(), access, where)
