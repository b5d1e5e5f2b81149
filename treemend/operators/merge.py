"""Merging duplicates: subtrees of several records become one, by rewriting paths.

Records are settled level by level from the top. On each level the records
below one merged record meet by type and name; one of them stays, and the
others' children are settled with its children on the next level. What stays
but came from a duplicate is a moved root. The result is a map from old to new
paths of moved roots, wherever they are in the tree, and one prefix join takes
along all that stands below them.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemend.functions.docs import attr_text, attributes, set_attrs
from treemend.functions.values import data_key
from treemend.model import INDEX_COLUMNS, INDEX_SCHEMA, AccessDef, Rule, Taxonomy, TypeNode
from treemend.operators.index import has_doc, parent_of
from treemend.operators.set_rules import uniq_key
from treemend.scale import first_by, ordinal_in_group
from treemend.session import cut_lineage


def _nothing() -> Column:
    return F.create_map().cast("map<string,string>")


def _values(node: TypeNode) -> Column:
    """What a record's children's keys repeat, as map<string,string>: what the move changes from ``_set``, all else from ``_attrs``."""
    changed = {c for c, _ in node.parent_pairs()}
    pairs = [x for n in _wanted(node) for x in (F.lit(n), F.try_element_at("_set" if n in changed else "_attrs", F.lit(n)))]
    return F.create_map(*pairs) if pairs else _nothing()


def _texts(names: list[str]) -> Column:
    """The named attributes of the record as map<string,string>."""
    attrs = attributes(F.col("doc"))
    return F.create_map(*[x for n in names for x in (F.lit(n), attr_text(attrs, n))]) if names else _nothing()


def _wanted(node: TypeNode) -> list[str]:
    """Attributes of a record that its children's keys repeat."""
    return list(dict.fromkeys(p for child in node.children for _, p in child.parent_pairs()))


def _case(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = None
    for when, then in pairs:
        out = F.when(when, then) if out is None else out.when(when, then)
    if out is None:
        return otherwise
    return out if otherwise is None else out.otherwise(otherwise)


def _under(new: Column, old: Column, path: Column) -> Column:
    """``path``, which stands below ``old``, below ``new``."""
    return F.concat(new, F.slice(path, F.size(old) + 1, F.size(path)))


def merge_duplicates(idx: DataFrame, survivors: DataFrame, rule: Rule, taxonomy: Taxonomy, access: Mapping[str, AccessDef]) -> DataFrame:
    """Fold records with a survivor's uniqueness key into the survivor.

    ``survivors``: node_path, one per key; of several the lowest path. Below a
    merged record, records of one type and name become one: the survivor's own,
    or else the lowest path, re-keyed and moved below the survivor with all
    that stands below it. The others are cleared, and their children are merged
    with those of the record that stays, on any level: no record is lost whose
    name the merged record lacks at that place. The duplicates' nodes stay,
    cleared; the survivors lose the rule's flag. Records without flag or key,
    and subtrees without a duplicate, are untouched. The index is not written.
    """
    level = taxonomy.level_of(rule.data_type)
    top = taxonomy.find(rule.data_type)
    flagged = idx.filter((F.col("data_type") == rule.data_type) & has_doc() & F.array_contains("qc", rule.key))
    keyed = flagged.select("node_path", uniq_key(attributes(F.col("doc")), rule.params).alias("_key"))
    keep = keyed.join(survivors.select("node_path").distinct(), "node_path", "left_semi")
    keep = first_by(keep.select("_key", "node_path"), ["_key"], F.col("node_path")).select("_key", F.col("node_path").alias("_to"))
    # who merges into whom, survivors into themselves
    pairs = cut_lineage(keyed.join(keep, "_key").select(F.col("node_path").alias("_from"), "_to"))
    owner = F.when(F.col("level") >= level, F.slice("node_path", 1, level))
    # records travel once: every later step reads what it needs of this table
    tagged = cut_lineage(idx.withColumn("_owner", owner).join(pairs, F.col("_owner") == F.col("_from"), "left").drop("_owner"))
    region = tagged.filter("_from IS NOT NULL")

    moved, made = _settle(region, top, level, access)
    gone = F.col("_from").isNotNull() & (F.col("_from") != F.col("_to"))
    saved = F.coalesce(F.col("node_path") == F.col("_to"), F.lit(False))
    no_flags = F.array().cast("array<string>")
    out = tagged.withColumns({
        "doc": F.when(~F.coalesce(gone, F.lit(False)), F.col("doc")),
        "qc": F.when(gone, no_flags).when(saved, F.array_remove("qc", rule.key)).otherwise(F.col("qc")),
    }).select(*INDEX_COLUMNS)
    for part in (*made, *([_taken_along(region, moved, top, level, access)] if moved else [])):
        out = out.unionByName(part)
    return out


def _settle(region: DataFrame, top: TypeNode, level: int, access: Mapping[str, AccessDef]) -> tuple[DataFrame | None, list[DataFrame]]:
    """Moved roots (_old, _new, _type, _set, _keys, _lat, _lon, _project), and rows of group nodes that are made for them.

    ``_set`` holds the attributes that the move changes, ``_keys`` those that
    the children's keys repeat.
    """
    head = region.filter(F.col("node_path") == F.col("_to"))
    place = ["_stay", "_new", "_keys", "_lat", "_lon", "_project"]
    # records that stay and get others' children, where they stood and stand; and, below the top, records that are folded into them
    staying = cut_lineage(head.select(
        F.col("node_path").alias("_stay"), F.col("node_path").alias("_new"), _texts(_wanted(top)).alias("_keys"),
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("project").alias("_project"),
    ))
    folded = None
    nodes, moved, made = [top], [], []
    while nodes := [child for node in nodes for child in node.children]:
        level += 2
        deeper = any(node.children for node in nodes)
        by_name = {node.name: node for node in nodes}
        names = {n.name: list(dict.fromkeys([*access[n.name].keys, *_wanted(n)])) for n in nodes}
        kids = region.filter(F.col("data_type").isin(*by_name) & (F.col("level") == level) & has_doc() & F.col("data_name").isNotNull())
        if folded is None:
            kids = kids.withColumns({"_stay": F.col("_to"), "_foreign": (F.col("_from") != F.col("_to")).cast("int")})
        else:
            homes = staying.select(F.col("_stay").alias("_at"), "_stay", F.lit(0).alias("_foreign")).unionByName(folded.withColumn("_foreign", F.lit(1)))
            kids = kids.withColumn("_parent", F.slice("node_path", 1, level - 2)).join(homes, F.col("_parent") == F.col("_at"))
        texts = _case([(F.col("data_type") == n, _texts(wanted)) for n, wanted in names.items()], _nothing())
        kids = kids.select("_stay", "data_type", "data_name", "node_path", "_foreign", texts.alias("_attrs"), "latitude", "longitude")
        kids = cut_lineage(kids) if deeper and folded is not None else kids
        # of a name only the record that stays travels on, without its document
        row = F.struct("node_path", "_foreign", "_attrs", "latitude", "longitude")
        first = kids.groupBy("_stay", "data_type", "data_name").agg(F.min_by(row, F.struct("_foreign", "node_path")).alias("_first"), F.max("_foreign").alias("_any"))
        first = cut_lineage(first.filter("_any = 1").select("_stay", "data_type", "data_name", "_first.*"))

        new_keys = _case([  # what the parent's place makes of the keys
            (F.col("data_type") == n.name, F.create_map(*[x for c, p in n.parent_pairs() for x in (F.lit(c), F.try_element_at("_keys", F.lit(p)))]))
            for n in nodes if n.parent_pairs()
        ], _nothing())
        met = first.join(staying, "_stay").withColumn("_set", new_keys)
        own_keys = _case([(F.col("data_type") == n.name, _values(n)) for n in nodes if n.children], _nothing())
        arriving, groups = _numbered(region, met.filter("_foreign = 1"), nodes, access, level)
        arriving = cut_lineage(arriving.withColumn("_child_keys", own_keys))
        made.append(groups)
        moved.append(arriving.select(F.col("node_path").alias("_old"), "_to_path", F.col("data_type").alias("_type"), "_set", F.col("_child_keys").alias("_keys"), "_lat", "_lon", "_project"))
        if not deeper:
            break

        wins = first.select("_stay", "data_type", "data_name", F.col("node_path").alias("_wins"))
        lost = kids.filter("_foreign = 1").select("_stay", "data_type", "data_name", "node_path").join(wins, ["_stay", "data_type", "data_name"]).filter(F.col("node_path") != F.col("_wins"))
        folded = cut_lineage(lost.select(F.col("node_path").alias("_at"), F.col("_wins").alias("_stay")))
        hosts = folded.select(F.col("_stay").alias("_host")).distinct()
        host = lambda df: df.join(hosts, F.col("node_path") == F.col("_host"), "left_semi")
        stay = host(met.filter("_foreign = 0")).select(
            F.col("node_path").alias("_s"), _under(F.col("_new"), F.col("_stay"), F.col("node_path")).alias("_n"), own_keys.alias("_keys"), *_located(nodes), "_project",
        )
        come = host(arriving).select(F.col("node_path").alias("_s"), F.col("_to_path").alias("_n"), F.col("_child_keys").alias("_keys"), *_located(nodes), "_project")
        staying = cut_lineage(stay.toDF(*place).unionByName(come.toDF(*place)))
    whole = reduce(DataFrame.unionByName, moved) if moved else None
    return (whole.withColumnRenamed("_to_path", "_new") if whole is not None else None), made


def _numbered(region: DataFrame, arriving: DataFrame, nodes: list[TypeNode], access: Mapping[str, AccessDef], level: int) -> tuple[DataFrame, DataFrame]:
    """The records with ``_to_path``; rows of the group nodes that were missing.

    A record's group node is the one its new parent has for its type, or the
    next number there; records follow the last child, in the order of their
    new keys.
    """
    group_name = _case([(F.col("data_type") == n.name, F.lit(n.group_name)) for n in nodes])
    rank = _case([(F.col("data_type") == n.name, F.lit(i)) for i, n in enumerate(nodes)])
    wanted = arriving.select("_stay", "_new", "_project", "data_type").distinct().withColumns({"_group_name": group_name, "_rank": rank})
    groups = region.filter(F.col("level") == level - 1).select(F.col("node_path").alias("_g"), F.col("parent_path").alias("_p"), F.col("data_type").alias("_gt"))
    groups = groups.join(wanted.select("_stay").distinct(), F.col("_p") == F.col("_stay"), "left_semi")
    last = groups.groupBy(F.col("_p").alias("_lp")).agg(F.max(F.element_at("_g", -1)).alias("_last"))
    have = groups.groupBy(F.col("_p").alias("_hp"), "_gt").agg(F.min("_g").alias("_have"))
    wanted = wanted.join(have, (F.col("_stay") == F.col("_hp")) & (F.col("_group_name") == F.col("_gt")), "left").join(last, F.col("_stay") == F.col("_lp"), "left")
    # a few types a parent: those it lacks are numbered on
    missing = F.sum(F.when(F.col("_have").isNull(), 1).otherwise(0)).over(Window.partitionBy("_stay").orderBy("_rank"))
    path = F.when(F.col("_have").isNotNull(), _under(F.col("_new"), F.col("_stay"), F.col("_have"))).otherwise(
        F.concat("_new", F.array((F.coalesce("_last", F.lit(0)) + missing).cast("int")))
    )
    wanted = wanted.withColumn("_group", path)
    tails = region.filter(F.col("level") == level).groupBy(F.col("parent_path").alias("_tp")).agg(F.max(F.element_at("node_path", -1)).alias("_no"))
    tails = tails.join(wanted.filter("_have IS NOT NULL").select("_have"), F.col("_tp") == F.col("_have"), "left_semi")
    wanted = cut_lineage(wanted.join(tails.groupBy("_tp").agg(F.max("_no").alias("_tail")), F.col("_have") == F.col("_tp"), "left").select("_stay", "data_type", "_group_name", "_group", "_have", "_tail", "_project"))

    keys = _case([(F.col("data_type") == n.name, data_key([(k, F.coalesce(F.try_element_at("_set", F.lit(k)), F.try_element_at("_attrs", F.lit(k)))) for k in access[n.name].keys])) for n in nodes])
    rows = ordinal_in_group(arriving.withColumn("_key", keys), ["_stay", "data_type"], ["_key", "node_path"], "_n")
    rows = rows.join(wanted.select(F.col("_stay").alias("_ws"), F.col("data_type").alias("_wt"), "_group", "_tail"), (F.col("_stay") == F.col("_ws")) & (F.col("data_type") == F.col("_wt")))
    rows = rows.withColumn("_to_path", F.concat("_group", F.array((F.coalesce("_tail", F.lit(0)) + F.col("_n")).cast("int"))))
    made = wanted.filter("_have IS NULL").select(*_row(
        node_path=F.col("_group"), parent_path=parent_of(F.col("_group")), data_name=F.col("_group_name"), data_type=F.col("_group_name"), project=F.col("_project"),
    ))
    return rows, made


def _located(nodes: list[TypeNode]) -> list[Column]:
    """Where records stand below their new parent: there, or where they did."""
    here = _case([(F.col("data_type") == n.name, F.lit(True)) for n in nodes if n.use_parent_location], F.lit(False))
    return [F.when(here, F.col(above)).otherwise(F.col(own)).alias(above) for above, own in (("_lat", "latitude"), ("_lon", "longitude"))]


def _row(**values: Column) -> list[Column]:
    """Index columns; those not given are empty."""
    empty = {"qc": F.array().cast("array<string>"), "level": F.size(values["node_path"])}
    return [values.get(n, empty.get(n, F.lit(None))).cast(INDEX_SCHEMA[n].dataType).alias(n) for n in INDEX_COLUMNS]


def _taken_along(region: DataFrame, moved: DataFrame, top: TypeNode, level: int, access: Mapping[str, AccessDef]) -> DataFrame:
    """Rows of moved roots and of all below them at their new paths: re-keyed, without flags. Cleared records stay behind."""
    nodes = [n for n in top.walk() if n is not top]
    groups = [n.group_name for n in nodes]
    stays = has_doc() | F.col("data_type").isin(*groups)
    foreign = region.filter((F.col("_from") != F.col("_to")) & (F.col("level") > level) & stays)
    # the prefixes that are records' paths; at most one of them is a moved root
    steps = F.sequence(F.lit(level + 2), F.greatest("level", F.lit(level + 2)), F.lit(2))
    prefixes = foreign.select("node_path", "level", F.explode(F.transform(steps, lambda n: F.slice("node_path", F.lit(1), n))).alias("_at")).filter(F.size("_at") <= F.col("level"))
    # paths alone meet the roots; only what moves is read with its record
    taken = cut_lineage(prefixes.join(moved, F.col("_at") == F.col("_old")).select(F.col("node_path").alias("_row"), *moved.columns))
    rows = foreign.drop("project").join(taken, F.col("node_path") == F.col("_row"))
    path = _under(F.col("_new"), F.col("_old"), F.col("node_path"))
    docs, lats, lons, data_keys = [], [], [], []
    for root in nodes:
        for node, changes, at_root in _below(root):
            is_it = (F.col("_type") == root.name) & (F.col("data_type") == node.name)
            values = changes if node is not root else {c: F.try_element_at("_set", F.lit(c)) for c, _ in root.parent_pairs()}
            docs.append((is_it, set_attrs(F.col("doc"), values) if values else F.col("doc")))
            attrs = attributes(F.col("doc"))
            data_keys.append((is_it, data_key([(k, values.get(k, attr_text(attrs, k))) for k in access[node.name].keys])))
            if at_root:
                lats.append((is_it, F.col("_lat")))
                lons.append((is_it, F.col("_lon")))
    return rows.select(*_row(
        node_path=path, parent_path=parent_of(path), data_name=F.col("data_name"), data_type=F.col("data_type"), data_key=_case(data_keys), doc=_case(docs),
        latitude=_case(lats, F.col("latitude")), longitude=_case(lons, F.col("longitude")), project=F.col("_project"),
    ))


def _below(root: TypeNode):
    """(type, attributes that change with the root's keys, whether it stands where the root's new parent does) of a type and all below it."""

    def walk(node, changes, at_root):
        yield node, changes, at_root
        for child in node.children:
            from_parent = {c: changes[p] for c, p in child.parent_pairs() if p in changes}
            yield from walk(child, from_parent, at_root and child.use_parent_location)

    yield root, {}, root.use_parent_location
    first = {p: F.try_element_at("_keys", F.lit(p)) for p in _wanted(root)}
    for child in root.children:
        yield from walk(child, {c: first[p] for c, p in child.parent_pairs()}, root.use_parent_location and child.use_parent_location)
