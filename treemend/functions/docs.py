"""JSON records: build, read, rewrite, infer and conform."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.functions.values import NUMBER_PATTERN, is_blank, to_number
from treemend.model import AccessDef

_TEXT_MAP = "map<string,string>"
_TYPED_MAP = "map<string,variant>"


def to_doc(*columns: Column | str) -> Column:
    """Row as JSON; null fields stay as JSON nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def attributes(doc: Column) -> Column:
    """Top-level attributes as text. A JSON null keeps its key."""
    return F.from_json(doc, _TEXT_MAP)


def computed(df: DataFrame, *keep: str | Column, **columns: Column) -> DataFrame:
    """Select columns, computing the named ones exactly here and once per row.

    They sit in a generator of one row: filters on them run on the result and
    are not pushed below, where each would compute them again, or compute them
    for rows that an earlier step drops.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_attrs(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Add ``_attrs``, parsed once per record."""
    return computed(df, "*", _attrs=attributes(F.col(doc)))


def has_attr(attrs: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(attrs, F.lit(name)), F.lit(False))


def attr_text(attrs: Column, name: str) -> Column:
    """Text of an attribute; missing and JSON null both give ''."""
    return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))


def attr_number(attrs: Column, name: str) -> Column:
    return to_number(F.try_element_at(attrs, F.lit(name)))


def attr_state(attrs: Column, name: str) -> Column:
    """missing / null / blank / valued."""
    value = F.try_element_at(attrs, F.lit(name))
    return (
        F.when(~has_attr(attrs, name), "missing")
        .when(value.isNull(), "null")
        .when(is_blank(value), "blank")
        .otherwise("valued")
    )


def set_attrs(doc: Column, values: Mapping[str, Column]) -> Column:
    """Set attributes, leaving the JSON type of all others as it is."""
    names = F.array(*[F.lit(n) for n in values])
    kept = F.map_filter(F.from_json(doc, _TYPED_MAP), lambda k, _: ~F.array_contains(names, k))
    pairs = [x for n, v in values.items() for x in (F.lit(n), v.cast("variant"))]
    return F.to_json(F.map_concat(kept, F.create_map(*pairs)))


def annotate(doc: Column, values: Mapping[str, Column], note: str) -> Column:
    """Set attributes and append a note to REMARK."""
    remark = F.concat(attr_text(attributes(doc), "REMARK"), F.lit(note))
    return set_attrs(doc, {**values, "REMARK": remark})


def doc_columns(doc: Column, access: AccessDef) -> list[Column]:
    """Typed columns of a record; text that does not convert becomes null."""
    attrs = attributes(doc)
    return [typed(F.try_element_at(attrs, F.lit(n)), t).alias(n) for n, t in access.types.items()]


def typed(text: Column, kind: str) -> Column:
    if kind == "number":
        return to_number(text)
    if kind == "date":
        return F.substring(text, 1, 10).try_cast("date")
    return text


def conform(df: DataFrame, types: Mapping[str, str], lengths: Mapping[str, int] | None = None) -> DataFrame:
    """Cast to the declared types (bad value -> null) and cut text to its length."""
    lengths = lengths or {}
    out = []
    for name, kind in types.items():
        column = F.col(name)
        if kind != "string":
            column = typed(column.cast("string"), kind)
        elif name in lengths:
            column = F.substring(column.cast("string"), 1, lengths[name])
        else:
            column = column.cast("string")
        out.append(column.alias(name))
    return df.select(*out)


def complete(df: DataFrame, access: AccessDef) -> DataFrame:
    """Rows of a source as a table of the record type: absent columns are '' or null, then ``conform``."""
    missing = {n: F.lit("" if kind == "string" else None) for n, kind in access.types.items() if n not in df.columns}
    return conform(df.withColumns(missing), access.types, access.lengths)


def infer_schema(df: DataFrame, doc: str = "doc") -> DataFrame:
    """(attribute, inferred type, has_null) over many records, one aggregation."""
    entries = df.select(F.explode(attributes(F.col(doc))).alias("attribute", "value"))
    value = F.col("value")
    whole = value.rlike(r"^[+-]?[0-9]{1,18}$")
    date = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$")
    seen = entries.groupBy("attribute").agg(
        F.bool_and(whole).alias("_int"),
        F.bool_and(value.rlike(NUMBER_PATTERN)).alias("_num"),
        F.bool_and(date).alias("_date"),
        F.bool_or(value.isNull()).alias("has_null"),
    )
    kind = F.when(F.col("_int"), "int").when(F.col("_num"), "double").when(F.col("_date"), "date").otherwise("string")
    return seen.select("attribute", kind.alias("inferred_type"), "has_null")


def empty_doc(access: AccessDef, today: str) -> dict[str, Column]:
    """Typed empties of a record type: '' / -99999 / the given date."""
    # Fixed values.
    empties = {"string": F.lit(""), "number": F.lit(-99999.0), "date": F.lit(today)}
    return {name: empties[kind] for name, kind in access.types.items()}


def doc_from(values: Mapping[str, Column]) -> Column:
    return to_doc(*[v.alias(n) for n, v in values.items()])


