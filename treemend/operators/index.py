"""The hierarchical index: one DataFrame of records addressed by tree path.

A path is an ``array<int>``: it sorts correctly and its prefixes are the
ancestors, so tree questions become equi-joins on prefixes.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from treemend.functions.arrays import pack_curves
from treemend.functions.docs import attr_text, attributes, to_doc
from treemend.functions.geo import resolve_location
from treemend.functions.values import data_key
from treemend.model import INDEX_COLUMNS, INDEX_SCHEMA, AccessDef, Taxonomy, TypeNode
from treemend.scale import ordinal_in_group, require_unique
from treemend.session import cut_lineage, delete_folder, open_writers

ROOT_NAME = "QCPROJECT"


def _empty_qc() -> Column:
    return F.array().cast("array<string>")


def path_text(path: Column) -> Column:
    """``/1/3/2/``; the root is ``/``."""
    return F.concat(F.lit("/"), F.concat_ws("", F.transform(path, lambda x: F.concat(x.cast("string"), F.lit("/")))))


def parent_of(path: Column) -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def ancestors(path: Column, include_self: bool = False) -> Column:
    """All proper prefixes of a path (root first)."""
    top = F.size(path) if include_self else F.size(path) - 1
    return F.when(top >= 0, F.transform(F.sequence(F.lit(0), top), lambda n: F.slice(path, F.lit(1), n))).otherwise(
        F.array().cast("array<array<int>>")
    )


def has_doc() -> Column:
    return F.coalesce(F.length("doc"), F.lit(0)) > 0


# ---------------------------------------------------------------- building


def join_children(parents: DataFrame, children: DataFrame, node: TypeNode) -> DataFrame:
    """Bind child rows to their parents by the parent-key template."""
    return children.join(parents, _all(children[c] == parents[p] for c, p in node.parent_pairs()), "inner")


def _columns(**values: Column) -> list[Column]:
    return [values[n].cast(INDEX_SCHEMA[n].dataType).alias(n) for n in INDEX_COLUMNS]


def _group_rows(source: DataFrame, path: Column, name: str, project: Column) -> DataFrame:
    nothing = F.lit(None)
    return source.select(
        *_columns(
            node_path=path,
            level=F.size(path),
            parent_path=parent_of(path),
            data_name=F.lit(name),
            data_type=F.lit(name),
            data_key=nothing,
            doc=nothing,
            latitude=nothing,
            longitude=nothing,
            qc=_empty_qc(),
            project=project,
        )
    )


def build_index(
    spark: SparkSession,
    taxonomy: Taxonomy,
    tables: Mapping[str, DataFrame],
    access: Mapping[str, AccessDef],
    where: str | None = None,
    project: str = "",
) -> DataFrame:
    """Root, one group node per non-empty type, one node per row, recursively.

    One join per type of the taxonomy, never one query per parent row.
    """
    root = spark.range(1).select(
        *_columns(
            node_path=F.array().cast("array<int>"),
            level=F.lit(0),
            parent_path=F.array().cast("array<int>"),
            data_name=F.lit(ROOT_NAME),
            data_type=F.lit(ROOT_NAME),
            data_key=F.lit(None),
            doc=F.lit("{}"),
            latitude=F.lit(None),
            longitude=F.lit(None),
            qc=_empty_qc(),
            project=F.lit(project),
        )
    )
    parts = [root]
    group = 0
    for node in taxonomy.roots:
        rows = tables[access[node.name].table]
        if where:
            rows = rows.where(where)
        if rows.isEmpty():
            continue
        group += 1
        top = F.array(F.lit(group))
        parts.append(_group_rows(spark.range(1), top, node.group_name, F.lit(project)))
        nowhere = F.lit(None).cast("double")
        placed = rows.select("*", top.alias("_group"), nowhere.alias("_plat"), nowhere.alias("_plon"))
        parts += _place(node, placed, tables, access, project)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _place(node, rows, tables, access, project) -> list[DataFrame]:
    """Nodes of one type and, recursively, of the types below it.

    ``rows`` carry the path of their group node in ``_group`` and the
    location of their parent in ``_plat``/``_plon``.
    """
    definition = access[node.name]
    # siblings are the rows of one group node, also where parents share a key
    numbered = ordinal_in_group(rows, ["_group"], list(definition.keys), "_n")
    if node.use_parent_location:
        lat, lon = F.col("_plat"), F.col("_plon")
    elif node.latitude:
        lat, lon = resolve_location(F.col(node.latitude).cast("string"), F.col(node.longitude).cast("string"))
    else:
        lat = lon = F.lit(None).cast("double")
    placed = numbered.select(
        "*", F.concat("_group", F.array(F.col("_n").cast("int"))).alias("_path"), lat.alias("_lat"), lon.alias("_lon")
    )
    doc_columns: list = [F.col(c) for c in definition.columns]
    source = placed
    if node.arrays:
        packed = pack_curves(tables[node.arrays.table], node.arrays.keys)
        arrays = [node.arrays.index_attribute, node.arrays.value_attribute]
        source = source.join(packed, list(node.arrays.keys), "left")
        doc_columns += [F.coalesce(F.col(a), F.lit("")).alias(a) for a in arrays]
    nodes = source.select(
        *_columns(
            node_path=F.col("_path"),
            level=F.size("_path"),
            parent_path=F.col("_group"),
            data_name=F.col(node.name_attribute).cast("string"),
            data_type=F.lit(node.name),
            data_key=data_key([(k, F.col(k)) for k in definition.keys]),
            doc=to_doc(*doc_columns),
            latitude=F.col("_lat"),
            longitude=F.col("_lon"),
            qc=_empty_qc(),
            project=F.lit(project),
        )
    )
    return [nodes, *(_place_below(node, placed, tables, access, project) if node.children else [])]


def _place_below(node, placed, tables, access, project) -> list[DataFrame]:
    """Group nodes and nodes of all child types of one type."""
    # parents as keys, path, location, and which child types they own
    wanted = list(dict.fromkeys(p for child in node.children for _, p in child.parent_pairs()))
    parents = placed.select(*wanted, "_path", "_lat", "_lon")
    for i, child in enumerate(node.children):
        pairs = child.parent_pairs()
        owned = tables[access[child.name].table].select(*[F.col(c).alias(f"_o{j}") for j, (c, _) in enumerate(pairs)]).distinct()
        match = _all(F.col(p) == F.col(f"_o{j}") for j, (_, p) in enumerate(pairs))
        parents = parents.join(owned.withColumn(f"_has{i}", F.lit(1)), match, "left").drop(*[f"_o{j}" for j in range(len(pairs))])
    # narrow, and read once per child type: computed once
    parents = cut_lineage(parents)

    parts = []
    for i, child in enumerate(node.children):
        pairs = child.parent_pairs()
        ordinal = sum((F.coalesce(F.col(f"_has{j}"), F.lit(0)) for j in range(i)), F.lit(1)).cast("int")
        owners_ = parents.filter(F.col(f"_has{i}") == 1).select(
            *[F.col(p).alias(f"_p{j}") for j, (_, p) in enumerate(pairs)],
            F.concat("_path", F.array(ordinal)).alias("_group"),
            F.col("_lat").alias("_plat"),
            F.col("_lon").alias("_plon"),
        )
        parts.append(_group_rows(owners_, F.col("_group"), child.group_name, F.lit(project)))
        match = _all(F.col(c) == F.col(f"_p{j}") for j, (c, _) in enumerate(pairs))
        bound = tables[access[child.name].table].join(owners_, match).drop(*[f"_p{j}" for j in range(len(pairs))])
        parts += _place(child, bound, tables, access, project)
    return parts


def _all(terms) -> Column:
    return reduce(lambda a, b: a & b, terms)


# ---------------------------------------------------------------- reading


def descendants(idx: DataFrame, path: list[int], include_self: bool = False) -> DataFrame:
    """All nodes below a node."""
    prefix = F.array(*[F.lit(p) for p in path]).cast("array<int>")
    size = len(path)
    deep = F.col("level") >= size if include_self else F.col("level") > size
    return idx.filter(deep & (F.slice("node_path", 1, size) == prefix)) if size else idx.filter(deep)


def children_of(idx: DataFrame, path: list[int]) -> DataFrame:
    prefix = F.array(*[F.lit(p) for p in path]).cast("array<int>")
    return idx.filter((F.col("level") == len(path) + 1) & (F.col("parent_path") == prefix))


def child_counts(idx: DataFrame, path: list[int]) -> DataFrame:
    """Children of a node with the number of their own direct children."""
    counts = (
        descendants(idx, path).filter(F.col("level") == len(path) + 2)
        .groupBy(F.col("parent_path").alias("_of"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    kids = children_of(idx, path)
    return kids.join(counts, F.col("node_path") == F.col("_of"), "left").select(
        *[kids[c] for c in INDEX_COLUMNS], F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children")
    )


def descendant_counts(idx: DataFrame, level: int) -> DataFrame:
    """Subtree size minus the node itself, for every node of a level.

    Each deeper node knows its ancestor at that level, so one grouped count is enough.
    """
    counts = (
        idx.filter(F.col("level") > level)
        .groupBy(F.slice("node_path", 1, level).alias("_of"))
        .agg(F.count(F.lit(1)).alias("n_descendants"))
    )
    nodes = idx.filter(F.col("level") == level)
    return nodes.join(counts, F.col("node_path") == F.col("_of"), "left").select(
        *[nodes[c] for c in INDEX_COLUMNS], F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants")
    )


def by_ids(idx: DataFrame, ids: str) -> DataFrame:
    """Rows whose path is in a ``;`` list such as ``/1/2/;/1/3/``."""
    paths = []
    for item in ids.split(";"):
        if item.strip():
            paths.append(F.array(*[F.lit(int(p)) for p in item.strip().split("/") if p]).cast("array<int>"))
    return idx.filter(F.col("node_path").isin(*paths)) if paths else idx.filter(F.lit(False))


def query_index(idx: DataFrame, data_type: str | None = None, flag: str | None = None) -> DataFrame:
    return search_index(idx, data_type=data_type, flag=flag)


def search_index(
    idx: DataFrame,
    data_name: str | None = None,
    data_type: str | None = None,
    data_key: str | None = None,
    flag: str | None = None,
    project: str | None = None,
) -> DataFrame:
    """AND of the given criteria."""
    exact = {"data_name": data_name, "data_type": data_type, "data_key": data_key, "project": project}
    for column, value in exact.items():
        if value:
            idx = idx.filter(F.col(column) == value)
    return idx.filter(F.array_contains("qc", flag)) if flag else idx


def children_with_name(idx: DataFrame, path: list[int], name: str) -> DataFrame:
    return descendants(idx, path).filter(F.col("data_name") == name)


def owners(idx: DataFrame, data_type: str, data_name: str, level: int) -> DataFrame:
    """Paths on a level that have a descendant of this type and name."""
    hits = idx.filter((F.col("data_type") == data_type) & (F.col("data_name") == data_name) & has_doc() & (F.col("level") > level))
    return hits.select(F.slice("node_path", 1, level).alias("node_path")).distinct()


def entirety_parents(idx: DataFrame, data_type: str, data_name: str, parent_type: str, level: int) -> DataFrame:
    """Nodes of the parent type owning at least one such descendant."""
    nodes = idx.filter((F.col("data_type") == parent_type) & (F.col("level") == level))
    return nodes.join(owners(idx, data_type, data_name, level), "node_path", "left_semi")


# ---------------------------------------------------------------- writing


def insert_docs(
    idx: DataFrame,
    inserts: DataFrame,
    node: TypeNode,
    access: AccessDef,
) -> DataFrame:
    """Add records (``parent_path``, ``doc``) below their parents.

    The ``<Type>s`` group node of a parent is found or created with the next
    ordinal; the records follow its last child. All parents in one plan.
    """
    return insert_placed(idx, inserts.withColumn("old_path", F.lit(None).cast("array<int>")), node, access)[0]


def insert_placed(idx: DataFrame, inserts: DataFrame, node: TypeNode, access: AccessDef) -> tuple[DataFrame, DataFrame]:
    """The same for records that come from ``old_path``; also gives (old_path, new_path, doc)."""
    rows, placed = added_rows(idx, inserts, node, access)
    return idx.unionByName(rows), placed


def added_rows(idx: DataFrame, inserts: DataFrame, node: TypeNode, access: AccessDef) -> tuple[DataFrame, DataFrame]:
    """The rows alone that ``insert_placed`` adds. Of ``idx`` it reads paths, types, projects and locations."""
    if "old_path" not in inserts.columns:
        inserts = inserts.withColumn("old_path", F.lit(None).cast("array<int>"))
    wanted = inserts.select(F.col("parent_path").alias("_owner"), F.col("doc").alias("_doc"), F.col("old_path").alias("_old"))
    owners_ = wanted.select("_owner").distinct()
    level_below = idx.select("node_path", "parent_path", "data_type")
    groups = (
        owners_.join(level_below, F.col("_owner") == F.col("parent_path"), "left")
        .groupBy("_owner")
        .agg(
            F.min(F.when(F.col("data_type") == node.group_name, F.col("node_path"))).alias("_have"),
            F.coalesce(F.max(F.try_element_at("node_path", F.lit(-1))), F.lit(0)).alias("_last"),
        )
        .withColumn("_group", F.coalesce("_have", F.concat("_owner", F.array((F.col("_last") + 1).cast("int")))))
    )
    home = idx.select(F.col("node_path").alias("_at"), "project", F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon"))
    # an insert below a node that is not there fails; it is never dropped
    unknown = F.raise_error(F.concat(F.lit("no such parent: "), path_text(F.col("_owner")))).cast("array<int>")
    groups = groups.join(home, F.col("_owner") == F.col("_at"), "left")
    groups = groups.withColumn("_group", F.when(F.col("_at").isNotNull(), F.col("_group")).otherwise(unknown)).drop("_at")
    tails = (
        groups.select("_group").join(level_below, F.col("_group") == F.col("parent_path"))
        .groupBy("_group").agg(F.max(F.element_at("node_path", -1)).alias("_tail"))
    )
    groups = groups.join(tails, "_group", "left")
    attrs = attributes(F.col("_doc"))
    rows = wanted.withColumn("_key", data_key([(k, attr_text(attrs, k)) for k in access.keys]))
    rows = ordinal_in_group(rows, ["_owner"], ["_key", "_doc"], "_n").join(groups, "_owner")
    path = F.concat("_group", F.array((F.coalesce("_tail", F.lit(0)) + F.col("_n")).cast("int")))
    own_lat, own_lon = (None, None)
    if node.latitude:
        own_lat, own_lon = resolve_location(attr_text(attrs, node.latitude), attr_text(attrs, node.longitude))
    lat = F.col("_plat") if node.use_parent_location else (own_lat if own_lat is not None else F.lit(None))
    lon = F.col("_plon") if node.use_parent_location else (own_lon if own_lon is not None else F.lit(None))
    records = rows.select(
        *_columns(
            node_path=path,
            level=F.size(path),
            parent_path=F.col("_group"),
            data_name=attr_text(attrs, node.name_attribute),
            data_type=F.lit(node.name),
            data_key=F.col("_key"),
            doc=F.col("_doc"),
            latitude=lat,
            longitude=lon,
            qc=_empty_qc(),
            project=F.col("project"),
        )
    )
    made = _group_rows(groups.filter(F.col("_have").isNull()), F.col("_group"), node.group_name, F.col("project"))
    placed = rows.select(F.col("_old").alias("old_path"), path.alias("new_path"), F.col("_doc").alias("doc"))
    return made.unionByName(records), placed


def mark_below(idx: DataFrame, ids: DataFrame, level: int | None = None) -> DataFrame:
    """Add ``_hit``: the node or one of its ancestors is in ``ids`` (node_path).

    ``level`` tells that all ids are on one level. Without it the ids' levels
    are looked up, a few numbers, and each takes one join.
    """
    marks = ids.select(F.col("node_path").alias("_id")).distinct()
    levels = [level]
    if level is None:
        marks = cut_lineage(marks)
        levels = sorted(r["n"] for r in marks.select(F.size("_id").alias("n")).distinct().collect())
    out = idx.withColumn("_hit", F.lit(False))
    for n in levels:
        own = (marks if level is not None else marks.filter(F.size("_id") == n)).withColumn("_mark", F.lit(True))
        out = (
            out.withColumn("_at", F.when(F.col("level") >= n, F.slice("node_path", 1, n)))
            .join(own, F.col("_at") == F.col("_id"), "left")
            .withColumn("_hit", F.col("_hit") | F.coalesce("_mark", F.lit(False)))
            .drop("_at", "_id", "_mark")
        )
    return out


def delete_subtree(idx: DataFrame, ids: DataFrame, level: int | None = None) -> DataFrame:
    """Soft delete: clear records and flags of the nodes in ``ids``, on whatever level, and all below."""
    marked = mark_below(idx, ids, level)
    return marked.withColumn("doc", F.when(~F.col("_hit"), F.col("doc"))).withColumn(
        "qc", F.when(F.col("_hit"), _empty_qc()).otherwise(F.col("qc"))
    ).select(*INDEX_COLUMNS)


def apply_updates(idx: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace record and flags by path; ``updates`` is (node_path, doc, qc), one per node."""
    require_unique(updates, ["node_path"])
    new = updates.select(
        F.col("node_path").alias("_id"), F.col("doc").alias("_doc"), F.col("qc").alias("_qc"), F.lit(True).alias("_new")
    )
    return idx.join(new, F.col("node_path") == F.col("_id"), "left").select(
        *[
            F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("doc", "qc") else F.col(c)
            for c in INDEX_COLUMNS
        ]
    )


def clear_flags(idx: DataFrame) -> DataFrame:
    return idx.withColumn("qc", _empty_qc())


# ---------------------------------------------------------------- projects


def copy_project(idx: DataFrame, project: str) -> DataFrame:
    """An isolated copy of an index under another project name."""
    return idx.withColumn("project", F.lit(project))


def list_projects(idx: DataFrame) -> DataFrame:
    return idx.groupBy("project").agg(F.count(F.lit(1)).alias("n_nodes"))


def drop_project(idx: DataFrame, project: str) -> DataFrame:
    return idx.filter(~F.col("project").eqNullSafe(project))


def _token(project: Column) -> Column:
    """A folder's name for a project: never empty, and never read as a number."""
    return F.concat(F.lit("p_"), F.lower(F.hex(F.encode(project, "utf-8"))))


def save_projects(idx: DataFrame, path: str) -> None:
    """Write projects as partitions; only the partitions written are replaced."""
    with open_writers(idx.sparkSession):
        (
            idx.withColumn("_project", _token(F.col("project"))).withColumn("_type", F.col("data_type"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_project", "_type")
            .parquet(path)
        )


def load_projects(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """The stored index, or one project of it; other projects' files are not read."""
    schema = StructType([*INDEX_SCHEMA.fields, StructField("_project", StringType()), StructField("_type", StringType())])
    stored = spark.read.schema(schema).parquet(path)
    if project is not None:
        stored = stored.filter(F.col("_project") == _token(F.lit(project)))
    return stored.select(*INDEX_COLUMNS)


def drop_stored_project(spark: SparkSession, path: str, project: str) -> bool:
    """Delete a project of the stored index; false if it is not there. The other projects are untouched."""
    return delete_folder(spark, f"{path.rstrip('/')}/_project=p_{project.encode().hex()}")

