"""CSV sources mapped by column position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treemend.functions.values import sha256_key
from treemend.model import UNKNOWN, ReferenceDef, split_pairs
from treemend.scale import broadcast_if_small, first_by, pin_splits
from treemend.session import cut_lineage


def parse_mapping(text: str) -> dict[str, int]:
    """``UWI=2; FINAL_TD=22`` as column positions."""
    return {name: int(at) for name, at in split_pairs(text).items()}


def scan_csv(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, int] | str,
    lengths: Mapping[str, int] | None = None,
    with_order: bool = False,
    *,
    multiline: bool,
) -> DataFrame:
    """Columns picked by position, renamed, text cut to its declared length.

    Quotes follow RFC 4180: a quote inside quotes is doubled, a backslash is
    an ordinary character. ``multiline`` says whether quoted values may hold
    line breaks. Files are read in splits either way; with line breaks a pass
    ahead counts quotes, see ``_records``.

    ``with_order`` adds ``_order``, which sorts rows of one file as they stand
    in it (split start, then line within the split).
    """
    places = parse_mapping(mapping) if isinstance(mapping, str) else dict(mapping)
    lengths = lengths or {}
    if multiline:
        schema = ", ".join(f"_c{i} string" for i in range(max(places.values(), default=0) + 1))
        rows = _records(spark, path).select("file", "start", "line", F.from_csv("record", schema, {"quote": '"', "escape": '"'}).alias("_r"))
        cut = lambda name, at: F.substring(f"_r._c{at}", 1, lengths[name]) if name in lengths else F.col(f"_r._c{at}")
        order = [F.struct("file", "start", "line").alias("_order")] if with_order else []
        return rows.select(*[cut(name, at).alias(name) for name, at in places.items()], *order)
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=True, quote='"', escape='"')
    names = raw.columns
    out = []
    for name, at in places.items():
        column = F.col(f"`{names[at]}`")
        out.append((F.substring(column, 1, lengths[name]) if name in lengths else column).alias(name))
    if with_order:
        line = F.monotonically_increasing_id().alias("line")
        order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), line)
        out.append(order.alias("_order"))
    return raw.select(*out)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line, record) of files whose quoted values may hold line breaks, without each file's first record.

    A line break ends a record where the quotes before it are even in number.
    A first pass over the splits counts each one's quotes; whether a split
    begins inside quotes is the parity of all before it in the file. Each split
    then joins its own lines to records. What a record has in later splits
    comes to it by a join of these parts alone, so a record may span any
    number of splits. Empty lines between records are no records.
    """
    pin_splits(spark)
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = cut_lineage(raw.groupBy("file", "start").agg(F.sum(quotes).alias("_quotes"), F.count(F.lit(1)).alias("_lines")))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut_lineage(counted.select("file", "start", "_lines", (F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2).cast("int").alias("_inside")))
    known = raw.join(broadcast_if_small(inside), ["file", "start"], "left").select("file", "start", "_inside", "_lines", "value")
    # a part: head 1 continues what began before the split, tail 1 goes on after it; its lines are joined
    parts = cut_lineage(known.mapInArrow(_joined, "file string, start long, line long, head int, tail int, text string"))
    whole = parts.filter("head = 0 AND tail = 0")
    broken = parts.filter("head = 1 OR tail = 1")
    # a record's parts follow each other: the one that begins it, then the heads up to the one that ends it
    first = F.last(F.when(F.col("head") == 0, F.struct("start", "line")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start", "line"))
    met = broken.withColumn("_first", first).groupBy("file", "_first").agg(F.array_sort(F.collect_list(F.struct("start", "line", "text"))).alias("_parts"))
    joined = met.select("file", "_first.start", "_first.line", F.array_join(F.transform("_parts", lambda p: p["text"]), "\n").alias("text"))
    rows = whole.select("file", "start", "line", "text").unionByName(joined)
    record = F.regexp_replace("text", "\r$", "")
    return rows.filter((F.col("start") > 0) | (F.col("line") > 0)).select("file", "start", "line", record.alias("record")).filter("record <> ''")


def _joined(batches):
    """Lines (file, start, _inside, _lines, value) in order -> parts (file, start, line, head, tail, text) of records."""
    names = ("file", "start", "line", "head", "tail", "text")
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    at, held, line, begun, head, inside, left = None, [], 0, 0, 0, 0, 0

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

    for batch in batches:
        out = []
        for file, start, odd, lines, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != at:
                if left:
                    raise ValueError("the splits of a file changed while it was read")
                if held:
                    out.append((*at, begun, head, 1, "\n".join(held)))
                if odd is None:
                    raise ValueError("the splits of a file changed while it was read")
                at, held, line, begun, head, inside, left = (file, start), [], 0, 0, odd, odd, lines
            if not held:
                begun = line
            held.append(value)
            inside ^= value.count('"') & 1
            line, left = line + 1, left - 1
            if not inside:
                out.append((*at, begun, head, 0, "\n".join(held)))
                held, head = [], 0
        if out:
            yield rows(out)
    if left:
        raise ValueError("the splits of a file changed while it was read")
    if held:
        yield rows([(*at, begun, head, 1, "\n".join(held))])


def fix_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns present and filled: absent or empty becomes UNKNOWN; adds KeyHash."""
    for key in keys:
        known = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(UNKNOWN)) if key in df.columns else F.lit(UNKNOWN)
        df = df.withColumn(key, known)
    return df.withColumn("KeyHash", sha256_key(F.upper(F.concat(*[F.col(k) for k in keys]))))


def dedupe_last(df: DataFrame, keys: Sequence[str], order: str = "_order") -> DataFrame:
    """One row per key hash, the last in file order, by aggregation with map-side combine."""
    return first_by(fix_keys(df, keys), ["KeyHash"], F.col(order), last=True)


def derive_parents(child: DataFrame, ref: ReferenceDef, key_length: int) -> DataFrame:
    """Parent rows of a child file: distinct values cut to the key length.

    A quote left at the end by the cut goes; the full value is kept beside the
    key; the lowest full value wins a shared key.
    """
    value = F.col("_v")
    cut = F.regexp_replace(F.substring(value, 1, key_length), "'$", "")
    key = F.when(F.length(value) > key_length, cut).otherwise(value)
    values = child.select(F.col(ref.reference_attribute).alias("_v")).filter(F.length("_v") > 0).distinct()
    rows = first_by(values.select(key.alias("_k"), "_v"), ["_k"], value)
    columns = [F.col("_k").alias(ref.key_attribute)]
    if ref.value_attribute != ref.key_attribute:
        columns.append(value.alias(ref.value_attribute))
    if ref.fixed:
        columns.append(F.lit(ref.fixed[1]).alias(ref.fixed[0]))
    return rows.select(*columns)


def cut_references(child: DataFrame, ref: ReferenceDef, key_length: int) -> DataFrame:
    """The child with its reference column cut like the parent keys."""
    name = ref.reference_attribute
    cut = F.regexp_replace(F.substring(name, 1, key_length), "'$", "")
    return child.withColumn(name, F.when(F.length(name) > key_length, cut).otherwise(F.col(name)))
