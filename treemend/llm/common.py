"""Helpers shared by the operators: folds, words, batches and Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treemend.session import tune

WORD = r"[^\x20\x09-\x0D]+"
# Rows per Arrow batch where rows are whole texts.
TEXT_BATCH = "500"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of text jobs: small Arrow batches, since one row may be a very long text."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH)
    return spark


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from. Null ids: false, and not learned from either."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) != 2, F.lit(False))


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces_of(texts: list, most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` characters, so that numpy buffers stay bounded."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def arrow_rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])
