"""From CSV and LAS files to the tables an index is built from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from treemend.functions.docs import complete
from treemend.model import AccessDef
from treemend.session import cut_lineage
from treemend.sources.csv_files import dedupe_last, scan_csv
from treemend.sources.las import load_las


def tables_from_files(
    spark: SparkSession,
    access: Mapping[str, AccessDef],
    csv: Mapping[str, tuple[str, str]],
    las: str | None = None,
    las_types: tuple[str, ...] = ("Log",),
    multiline: bool = False,
) -> dict[str, DataFrame]:
    """Tables by name: of each CSV type (folder, column mapping), one row per key, the last in file order; of LAS files the curves.

    ``las_types`` names the record types taken from the LAS files; their
    samples come along. Columns a source lacks are empty. Each table is written
    once: an index reads it several times, and reading and deduplicating the
    files again costs more.
    """
    out = {}
    for name, (path, mapping) in csv.items():
        definition = access[name]
        rows = scan_csv(spark, path, mapping, definition.lengths, with_order=True, multiline=multiline)
        out[definition.table] = cut_lineage(complete(dedupe_last(rows, definition.keys), definition))
    if las:
        found = load_las(spark, las).tables()
        for name in las_types:
            out[access[name].table] = cut_lineage(complete(found[access[name].table], access[name]))
        out["WELL_LOG_CURVE_VALUE"] = cut_lineage(found["WELL_LOG_CURVE_VALUE"])
    return out
