"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Skewed joins are split by AQE even when
# that costs one more exchange, because one key may hold a third of all rows.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, name: str = "treemend", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # building long plans: do not record a Python call site for every expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a session on one machine may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "treemend")


def run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; other runs have their own."""
    return f"{shared_folder(spark).rstrip('/')}/treemend/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below this run's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path as any process sees it, where it is on a mounted file system; else none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri()
    return folder.toUri().getPath() if uri.getScheme() == "file" else None


# Folders that a task writes at a time; rows of further ones are sorted first.
OPEN_WRITERS = 32
_UNSORTED = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_WRITERS), "spark.sql.optimizer.plannedWrite.enabled": "false"}


@contextmanager
def open_writers(spark: SparkSession) -> Iterator[None]:
    """Tasks write a few folders at once, so that partitioned writes of wide rows hold and sort none of them."""
    before = {k: spark.conf.get(k, None) for k in _UNSORTED}
    try:
        for k, v in _UNSORTED.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_lineage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The rows as a table written to the shared folder.

    Survives the loss of executors, is computed once however often it is read,
    and readers get column pruning and filter pushdown. The schema is carried
    over, so column types stay as they were. ``partition_by`` names a column of
    few values whose filters should skip files.
    """
    path = scratch_path(df.sparkSession, "stage")
    if partition_by:
        with open_writers(df.sparkSession):
            df.write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the stage tables of this run, once its results are written. Other runs keep theirs."""
    delete_folder(spark, run_folder(spark))


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder wherever it is stored; false if there was none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
