"""Plain descriptions of record types, trees, references and rules.

These are job arguments: small Python values that parameterise DataFrame
plans. No data passes through them.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

NULL_NUMBER = -99999.0
NULL_CURVE = -999.25
UNKNOWN = "UNKNOWN"

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("node_path", T.ArrayType(T.IntegerType())),
        T.StructField("level", T.IntegerType()),
        T.StructField("parent_path", T.ArrayType(T.IntegerType())),
        T.StructField("data_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("data_key", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("qc", T.ArrayType(T.StringType())),
        T.StructField("project", T.StringType()),
    ]
)
INDEX_COLUMNS = [f.name for f in INDEX_SCHEMA.fields]

SPARK_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "date": T.DateType()}


def split_list(text: str, sep: str = ",") -> list[str]:
    return [part.strip() for part in text.split(sep) if part.strip()]


def split_pairs(text: str, sep: str = ";") -> dict[str, str]:
    """``A=1; B=2`` as a dict."""
    return {k.strip(): v.strip() for k, v in (part.split("=", 1) for part in split_list(text, sep))}


@dataclass(frozen=True)
class AccessDef:
    """Columns, types, key and string lengths of one record type."""

    data_type: str
    table: str
    keys: tuple[str, ...]
    types: dict[str, str]
    constants: dict[str, str] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[t]) for n, t in self.types.items()])


@dataclass(frozen=True)
class CurveArrays:
    """Samples packed into two text attributes of a curve record."""

    table: str
    keys: tuple[str, ...]
    index_attribute: str = "INDEX_VALUE"
    value_attribute: str = "MEASURED_VALUE"


@dataclass(frozen=True)
class TypeNode:
    """One record type of the tree and the types below it."""

    name: str
    name_attribute: str
    latitude: str | None = None
    longitude: str | None = None
    parent_key: str | None = None
    use_parent_location: bool = False
    arrays: CurveArrays | None = None
    children: tuple["TypeNode", ...] = ()

    @property
    def group_name(self) -> str:
        return self.name + "s"

    def parent_pairs(self) -> list[tuple[str, str]]:
        """``UWI = [UWI], A = [B]`` as (child column, parent column) pairs."""
        pairs = []
        for part in split_list(self.parent_key or ""):
            found = re.fullmatch(r"\s*(\w+)\s*=\s*\[\s*(\w+)\s*\]\s*", part)
            if not found:
                raise ValueError(f"bad parent key {part!r} of {self.name}")
            pairs.append((found.group(1), found.group(2)))
        return pairs

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


@dataclass(frozen=True)
class Taxonomy:
    roots: tuple[TypeNode, ...]

    def find(self, name: str) -> TypeNode:
        for root in self.roots:
            for node in root.walk():
                if node.name == name:
                    return node
        raise KeyError(name)

    def level_of(self, name: str) -> int:
        """Tree level of the rows of a type: root 0, groups on odd levels."""

        def search(nodes, level):
            for node in nodes:
                if node.name == name:
                    return level
                below = search(node.children, level + 2)
                if below:
                    return below
            return 0

        level = search(self.roots, 2)
        if not level:
            raise KeyError(name)
        return level

    @property
    def depth(self) -> int:
        def deep(nodes):
            return max((2 + deep(n.children) for n in nodes), default=0)

        return deep(self.roots)


@dataclass(frozen=True)
class ReferenceDef:
    """A lookup table fed by one column of a record type."""

    data_type: str
    table: str
    key_attribute: str
    value_attribute: str
    reference_attribute: str
    fixed_key: str = ""
    insert: bool = True

    @property
    def fixed(self) -> tuple[str, str] | None:
        if not self.fixed_key:
            return None
        name, value = self.fixed_key.split("=", 1)
        return name.strip(), value.strip()


@dataclass(frozen=True)
class Rule:
    """A quality or prediction rule."""

    key: str
    data_type: str
    function: str
    rule_type: str
    attribute: str = ""
    params: str = ""
    filter: str = ""
    fail_rule: str = ""
    order: int = 0
    active: bool = True
    rule_id: int = 0
    name: str = ""

    def parameters(self) -> dict:
        return lenient_json(self.params)


def lenient_json(text: str | None) -> dict:
    """JSON object whose keys may be unquoted; anything else gives ``{}``."""
    if not text or not text.strip():
        return {}
    for candidate in (text, re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', text)):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        return value if isinstance(value, dict) else {}
    return {}


def numbered(rules: list[Rule]) -> list[Rule]:
    """Give every rule without an id its position as id."""
    return [r if r.rule_id else replace(r, rule_id=i) for i, r in enumerate(rules, 1)]
