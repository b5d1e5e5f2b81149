"""An index on disk: sorted by path, changed by layers.

The base is written once, sorted by a text key of the path: fixed-width hex, so
that keys sort like paths and an ancestor's key is a prefix. Subtree questions
are key ranges that reach the Parquet scan and skip files. A change writes only
the rows it makes, as a layer; a reader takes the newest row of each path, and
the base loses only the rows that a layer replaces. Compaction writes a new
base. There is one writer at a time; layers without their success mark do not
exist for readers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from treemend.model import INDEX_COLUMNS, INDEX_SCHEMA, AccessDef, TypeNode
from treemend.operators.edits import apply_edits
from treemend.operators.index import added_rows, apply_updates, children_of
from treemend.session import cut_lineage, delete_folder

_WIDTH = 8
_NAME = re.compile(r"layer-(\d{6})(?:-(.*))?")
# Paths a change names that are looked up by value in the scan, and subtrees by a range each; more are joined within the range they span.
FEW_PATHS = 1_000
FEW_RANGES = 16


def path_key(path: Column) -> Column:
    """Text that sorts like the path; the key of an ancestor is a prefix."""
    return F.array_join(F.transform(path, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), _WIDTH, "0")), "")


def key_of(path: Sequence[int]) -> str:
    return "".join(f"{p:0{_WIDTH}x}" for p in path)


def below(path: Sequence[int], include_self: bool = True) -> Column:
    """Key range of a subtree, as a scan can use it. ``g`` follows all hex digits."""
    low = key_of(path)
    if not low:
        return F.lit(True) if include_self else F.col("path_key") > ""
    start = F.col("path_key") >= low if include_self else F.col("path_key") > low
    return start & (F.col("path_key") < low + "g")


class IndexStore:
    """A stored index below one folder: ``base-<n>`` and the layers written since."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ files

    def _complete(self) -> list[str]:
        """Names of complete parts, sorted."""
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        root = jvm(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if fs.exists(jvm(f"{self.path}/{n}/_SUCCESS")))

    def _parts(self) -> tuple[str | None, list[tuple[int, str, str]]]:
        """The newest base, and (number, folder, commit) of the layers that came after it."""
        names = self._complete()
        bases = [n for n in names if n.startswith("base-")]
        since = int(bases[-1].split("-")[1]) if bases else -1
        layers = [(int(m[1]), n, m[2] or "") for n in names if (m := _NAME.fullmatch(n)) and int(m[1]) > since]
        return (bases[-1] if bases else None), layers

    def commits(self) -> set[str]:
        """Commit names of all layers that are still there, compacted ones among them."""
        return {m[2] for n in self._complete() if (m := _NAME.fullmatch(n)) and m[2]}

    def _next(self) -> int:
        return max([int(re.search(r"\d{6}", n)[0]) for n in self._complete()], default=-1) + 1

    # ------------------------------------------------------------ writing

    def create(self, idx: DataFrame, files: int | None = None) -> None:
        """The first base, or one that replaces everything; ``files`` of about equal size, else as many as its size asks for."""
        self._write_base(idx, files)

    def _write_base(self, idx: DataFrame, files: int | None = None) -> None:
        keyed = idx.select(path_key(F.col("node_path")).alias("path_key"), *INDEX_COLUMNS)
        ranges = keyed.repartitionByRange(files, "path_key") if files else keyed.repartitionByRange("path_key")
        ranges.sortWithinPartitions("path_key").write.mode("overwrite").parquet(f"{self.path}/base-{self._next():06d}")

    def commit(self, rows: DataFrame, name: str = "") -> bool:
        """Write changed and new rows (index columns) as a layer; false if a layer of that name is there already."""
        if name and not re.fullmatch(r"[A-Za-z0-9_.=-]+", name):
            raise ValueError(f"bad commit name {name!r}")
        if name and name in self.commits():
            return False
        keyed = rows.select(path_key(F.col("node_path")).alias("path_key"), *INDEX_COLUMNS)
        keyed.write.mode("overwrite").parquet(f"{self.path}/layer-{self._next():06d}" + (f"-{name}" if name else ""))
        return True

    def compact(self) -> None:
        """One base of all layers. Readers that have begun keep their files; ``clean`` removes them."""
        self._write_base(self.read())

    def clean(self, keep_commits: bool = True) -> None:
        """Remove bases and layers that a newer base holds; the folders of named commits may stay as their record."""
        base, layers = self._parts()
        live = {base, *(n for _, n, _ in layers)}
        for n in self._complete():
            m = _NAME.fullmatch(n)
            if n not in live and not (keep_commits and m and m[2]):
                delete_folder(self.spark, f"{self.path}/{n}")

    # ------------------------------------------------------------ reading

    def _scan(self, name: str, where: Column | None) -> DataFrame:
        schema = StructType([StructField("path_key", StringType()), *INDEX_SCHEMA.fields])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if where is None else rows.filter(where)

    def read(self, where: Column | None = None) -> DataFrame:
        """path_key and the index columns of the newest row of each path; ``where`` is on path_key or node_path alone."""
        base, layers = self._parts()
        if base is None:
            raise ValueError(f"no index at {self.path}")
        rows = self._scan(base, where)
        if not layers:
            return rows
        newer = [self._scan(n, where).withColumn("_layer", F.lit(number).cast(LongType())) for number, n, _ in layers]
        top = reduce(DataFrame.unionByName, newer)
        # what changed is small beside the base: AQE sends its keys to the base's tasks
        kept = rows.join(top.select("path_key"), "path_key", "left_anti")
        # a path has a row a layer at most; as a window, columns that nobody reads are not shuffled either
        later = F.lead("_layer").over(Window.partitionBy("path_key").orderBy("_layer"))
        return kept.unionByName(top.withColumn("_later", later).filter("_later IS NULL").drop("_layer", "_later"))

    def subtree(self, path: Sequence[int], include_self: bool = False) -> DataFrame:
        """All nodes below a node, from the files that hold them."""
        return self.read(below(path, include_self)).select(*INDEX_COLUMNS)

    def children(self, path: Sequence[int]) -> DataFrame:
        return children_of(self.subtree(path), list(path))

    def child_counts(self, path: Sequence[int]) -> DataFrame:
        """Children of a node with the number of their own direct children, from one read of the subtree."""
        size = len(path)
        near = self.subtree(path).filter(F.col("level") <= size + 2)
        kid = F.col("level") == size + 1
        one = near.groupBy(F.slice("node_path", 1, size + 1).alias("_kid")).agg(
            F.max(F.when(kid, F.struct(*INDEX_COLUMNS))).alias("_row"), F.count_if(~kid).alias("n_children"),
        )
        return one.filter("_row IS NOT NULL").select("_row.*", "n_children")

    def children_with_name(self, path: Sequence[int], name: str) -> DataFrame:
        return self.subtree(path).filter(F.col("data_name") == name)

    def named(self, paths: DataFrame) -> DataFrame:
        """The rows of the paths (node_path): by value in the scan where they are few."""
        keys = cut_lineage(paths.select(path_key(F.col("node_path")).alias("path_key")).distinct())
        few = [r["path_key"] for r in keys.limit(FEW_PATHS + 1).collect()]
        if len(few) <= FEW_PATHS:
            return self.read(F.col("path_key").isin(few)).select(*INDEX_COLUMNS)
        return self.read().join(keys, "path_key", "left_semi").select(*INDEX_COLUMNS)

    # ------------------------------------------------------------ changes

    def edit(self, edits: DataFrame, name: str = "") -> bool:
        """``apply_edits`` on the edited records alone, as a layer."""
        return self.commit(apply_edits(self.named(edits.select("node_path")), edits), name)

    def update(self, updates: DataFrame, name: str = "") -> bool:
        """``apply_updates`` on the updated records alone, as a layer."""
        return self.commit(apply_updates(self.named(updates.select("node_path")), updates), name)

    def clear(self, path: Sequence[int], name: str = "") -> bool:
        """Soft delete of a node and all below: their rows without record and flags, as a layer of tombstones."""
        rows = self.subtree(path, include_self=True)
        return self.commit(rows.withColumns({"doc": F.lit(None).cast("string"), "qc": F.array().cast("array<string>")}), name)

    def insert(self, inserts: DataFrame, node: TypeNode, access: AccessDef, name: str = "") -> bool:
        """``insert_docs`` (parent_path, doc); the new rows are a layer."""
        return False if name and name in self.commits() else self.commit(self.placed(inserts, node, access), name)

    def placed(self, inserts: DataFrame, node: TypeNode, access: AccessDef) -> DataFrame:
        """The rows that ``insert_docs`` adds: records beside their parents' own children, and group nodes that were missing.

        Only the parents, their groups and what stands in these is read, and
        where the parents are few, only from the files that hold them.
        """
        inserts = cut_lineage(inserts)
        owners = cut_lineage(inserts.select(F.col("parent_path").alias("_owner")).distinct())
        sizes = sorted(r["n"] for r in owners.select(F.size("_owner").alias("n")).distinct().collect())  # a few levels
        few = [r["_owner"] for r in owners.limit(FEW_RANGES + 1).collect()]
        if len(few) <= FEW_RANGES:
            where = reduce(lambda a, b: a | b, map(below, few), F.lit(False))
        else:
            span = owners.agg(F.min(path_key(F.col("_owner"))).alias("low"), F.max(path_key(F.col("_owner"))).alias("high")).first()
            where = (F.col("path_key") >= span["low"]) & (F.col("path_key") < span["high"] + "g")
        near = None
        for n in sizes:
            rows = self.read(where).filter(F.col("level").between(n, n + 2)).withColumn("_at", F.slice("node_path", 1, n))
            rows = rows.join(owners, F.col("_at") == F.col("_owner"), "left_semi").select("node_path", "parent_path", "data_type", "project", "latitude", "longitude")
            near = rows if near is None else near.unionByName(rows)
        if near is None:
            return self.read().select(*INDEX_COLUMNS).limit(0)
        near = near.dropDuplicates(["node_path"]) if len(sizes) > 1 else near
        return added_rows(cut_lineage(near), inserts, node, access)[0]
