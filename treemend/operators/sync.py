"""Synchronising records with tables: upsert, deletes, references, copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.functions.docs import attributes, doc_columns, has_attr
from treemend.model import UNKNOWN, AccessDef, ReferenceDef
from treemend.operators.index import has_doc
from treemend.scale import first_by, require_unique


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    stamp: Mapping[str, Column] | None = None,
    check: bool = True,
    ignore_unknown: bool = False,
) -> DataFrame:
    """Source rows replace or extend the target; columns the source lacks keep the target's value.

    Columns the target lacks are an error, unless ``ignore_unknown`` drops them.

    ``stamp`` gives ``ROW_CHANGED_*`` values for touched rows and
    ``ROW_CREATED_*`` values for new ones. The result is a new version of the
    table; write it to a new path, never over the one being read.
    """
    unknown = [c for c in source.columns if c not in target.columns]
    if unknown and not ignore_unknown:
        raise ValueError(f"columns not in the target: {unknown}")
    source = source.drop(*unknown)
    if check:
        source = require_unique(source, keys)
    stamp = stamp or {}
    new = source.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns], F.lit(True).alias("_src"))
    old = target.withColumn("_tgt", F.lit(True))
    match = None
    for k in keys:
        term = F.col(k) == F.col(f"_s_{k}")
        match = term if match is None else match & term
    joined = old.join(new, match, "full_outer")
    touched, fresh = F.col("_src").isNotNull(), F.col("_tgt").isNull()
    out = []
    for c in target.columns:
        value = F.when(touched, F.col(f"_s_{c}").cast(target.schema[c].dataType)).otherwise(F.col(c)) if c in source.columns else F.col(c)
        if c in stamp:
            value = F.when(fresh if c.startswith("ROW_CREATED") else touched, stamp[c]).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def docs_to_table(idx: DataFrame, access: AccessDef, references: Sequence[ReferenceDef] = ()) -> DataFrame:
    """Records of one type as typed columns; null in a reference column becomes UNKNOWN."""
    rows = idx.filter((F.col("data_type") == access.data_type) & has_doc())
    table = rows.select(*doc_columns(F.col("doc"), access))
    for ref in references:
        if ref.data_type == access.data_type and access.types[ref.reference_attribute] == "string":
            name = ref.reference_attribute
            table = table.withColumn(name, F.coalesce(name, F.lit(UNKNOWN)))
    return table


def cleared_keys(idx: DataFrame, access: AccessDef) -> DataFrame:
    """Key columns of records whose document was cleared, read from the data key."""
    gone = idx.filter((F.col("data_type") == access.data_type) & ~has_doc() & F.col("data_key").isNotNull())
    out = []
    for i, key in enumerate(access.keys):
        # the value runs to the start of the next key, or to the end of the text
        stop = f"' AND {access.keys[i + 1]} = '" if i + 1 < len(access.keys) else "'$"
        out.append(F.regexp_extract("data_key", rf"(?s)(?:^| AND ){key} = '(.*?){stop}", 1).alias(key))
    return gone.select(*out).distinct()


def propagate_deletes(target: DataFrame, idx: DataFrame, access: AccessDef) -> DataFrame:
    """Target rows without those whose record was cleared."""
    gone = cleared_keys(idx, access).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(access.keys)])
    match = None
    for i, k in enumerate(access.keys):
        term = F.col(k).cast("string") == F.col(f"_g{i}")
        match = term if match is None else match & term
    return target.join(gone, match, "left_anti")


def new_references(df: DataFrame, ref: ReferenceDef, table: DataFrame) -> DataFrame:
    """Reference rows to add: distinct values the table lacks (within the fixed key)."""
    known = table
    if ref.fixed:
        name, value = ref.fixed
        known = known.filter(F.col(name) == value)
    values = df.select(F.col(ref.reference_attribute).cast("string").alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    fresh = values.join(known.select(F.col(ref.key_attribute).alias("_k")), F.col("_v") == F.col("_k"), "left_anti")
    columns = [F.col("_v").alias(ref.key_attribute)]
    if ref.value_attribute != ref.key_attribute:
        columns.append(F.col("_v").alias(ref.value_attribute))
    if ref.fixed:
        columns.append(F.lit(ref.fixed[1]).alias(ref.fixed[0]))
    return fresh.select(*columns)


def load_references(df: DataFrame, ref: ReferenceDef, table: DataFrame) -> DataFrame:
    """The reference table with the new values."""
    return table.unionByName(new_references(df, ref, table), allowMissingColumns=True)


def check_foreign_keys(df: DataFrame, ref: ReferenceDef, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, reference table): unknown values join the reference when it allows inserts, else become UNKNOWN."""
    if ref.insert:
        return df, load_references(df, ref, table)
    known = table.select(F.col(ref.key_attribute).alias("_k")).distinct()
    name = ref.reference_attribute
    rows = df.join(known, F.col(name) == F.col("_k"), "left")
    return rows.withColumn(name, F.when(F.col("_k").isNotNull(), F.col(name)).otherwise(UNKNOWN)).select(*df.columns), table


def copy_filtered(source: DataFrame, keep: DataFrame | Sequence[str] | None = None, key: str = "UWI", kind: str = "TABLE") -> DataFrame:
    """A table, or for kind TABLE only the rows whose key is wanted.

    ``keep`` is a DataFrame with the key column (a query on the well table) or
    a short list given by hand.
    """
    if keep is None or kind != "TABLE":
        return source
    if isinstance(keep, DataFrame):
        return source.join(keep.select(F.col(key)).distinct(), key, "left_semi")
    return source.filter(F.col(key).isin(list(keep)))


def copy_references(table: DataFrame, ref: ReferenceDef, source_refs: DataFrame) -> DataFrame:
    """Reference rows the copied table uses; they replace the target's."""
    used = table.select(F.col(ref.reference_attribute).alias("_v")).distinct()
    return source_refs.join(used, F.col(ref.key_attribute) == F.col("_v"), "left_semi")


def append_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the source rows whose key it lacks, one per key (the first in column order)."""
    names = list(keys)
    whole_row = F.struct(*[F.col(c) for c in source.columns])
    fresh = first_by(source.join(target.select(*names).distinct(), names, "left_anti"), names, whole_row)
    return target.unionByName(fresh.select(*target.columns))


def append_new_series(target: DataFrame, source: DataFrame, series: Sequence[str]) -> DataFrame:
    """Target plus whole series (curves) it does not have yet."""
    names = list(series)
    return target.unionByName(source.join(target.select(*names).distinct(), names, "left_anti").select(*target.columns))


def upsert_docs(target: DataFrame, docs: DataFrame, access: AccessDef, check: bool = True) -> DataFrame:
    """Typed insert or update from JSON rows; attributes a document lacks keep the target's value."""
    attrs = attributes(F.col("doc"))
    given = [has_attr(attrs, n).alias(f"_h_{n}") for n in access.types]
    rows = docs.select(*doc_columns(F.col("doc"), access), *given)
    if check:
        rows = require_unique(rows, access.keys)
    new = rows.select(*[F.col(n).alias(f"_s_{n}") for n in access.types], *[F.col(f"_h_{n}") for n in access.types], F.lit(True).alias("_src"))
    match = None
    for k in access.keys:
        term = F.col(k) == F.col(f"_s_{k}")
        match = term if match is None else match & term
    joined = target.join(new, match, "full_outer")
    out = []
    for c in target.columns:
        use = F.col("_src").isNotNull() & F.col(f"_h_{c}") if c in access.types else None
        out.append((F.when(use, F.col(f"_s_{c}").cast(target.schema[c].dataType)).otherwise(F.col(c)) if use is not None else F.col(c)).alias(c))
    return joined.select(*out)


def write_version(df: DataFrame, root: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write a new version directory of a table; readers switch once it is complete."""
    path = f"{root.rstrip('/')}/v{version:06d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path
