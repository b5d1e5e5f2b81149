"""Incremental transfer: newly arrived files are loaded once each."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treemend.functions.docs import attr_text, attributes, complete, to_doc
from treemend.functions.geo import resolve_location
from treemend.functions.values import data_key
from treemend.model import INDEX_COLUMNS, AccessDef, Taxonomy
from treemend.operators.store import IndexStore
from treemend.scale import first_by, require_unique
from treemend.session import cut_lineage


def stream_ingest(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    checkpoint: str,
    load: Callable[[DataFrame, int], None],
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> None:
    """Process every file that arrived since the last run, then stop.

    The checkpoint records which files each batch covers, so a file is handed
    to ``load`` again only if its batch did not finish; ``load`` gets the batch
    id and has to give the same result when a batch is repeated.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.load(source)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A loader writing each batch to its own folder, so a repeated batch replaces itself."""

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return load


def load_into_index(
    store: IndexStore, taxonomy: Taxonomy, access: Mapping[str, AccessDef], data_type: str, order: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A loader that places each batch's records in a stored index, as one layer named by the batch.

    A batch that was committed before changes nothing. Rows of one key count
    once, the last by ``order`` (without it, by the row itself). A key that the
    index has replaces its record and drops its flags; a new key goes below its
    parent, whose batches come first: a record without parent fails its batch,
    which is then repeated. Keys of batches are met with the index's by one
    join on the data key, with neither records nor arrays; it also gives the rows
    whose records are replaced.
    """
    node, definition = taxonomy.find(data_type), access[data_type]
    if node.arrays:
        raise ValueError(f"{data_type} holds packed arrays: build the index from its tables")
    above = next((n for root in taxonomy.roots for n in root.walk() if node in n.children), None)

    def load(batch: DataFrame, batch_id: int) -> None:
        name = f"{data_type}-batch{batch_id}"
        if name in store.commits():
            return
        keys, rest = list(definition.keys), [c for c in batch.columns if c not in definition.keys]
        if order:
            last = first_by(batch, keys, F.col(order), last=True) if rest else batch.distinct()
        else:
            last = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else batch.distinct()
        rows = complete(last, definition).select(
            data_key([(k, F.col(k)) for k in definition.keys]).alias("_key"),
            (data_key([(p, F.col(c)) for c, p in node.parent_pairs()]) if above else F.lit("")).alias("_parent"),
            to_doc(*[F.col(c) for c in definition.columns]).alias("_doc"),
        )
        # the index is read once, without records: a key's place and row, and the parents'
        stay = [c for c in INDEX_COLUMNS if c not in ("doc", "qc")]
        nodes = store.read().select(*stay).filter(F.col("data_type").isin([data_type, *([above.name] if above else [])]))
        nodes = cut_lineage(nodes.filter(F.col("data_key").isNotNull()))
        own = nodes.filter(F.col("data_type") == data_type)
        met = cut_lineage(rows.join(own, F.col("_key") == F.col("data_key"), "left"))
        known = require_unique(met.filter("node_path IS NOT NULL"), ["node_path"])
        changed = known.withColumns({"doc": F.col("_doc"), "qc": F.array().cast("array<string>")})
        fresh = met.filter("node_path IS NULL").select("_key", "_parent", "_doc")
        if above:
            parents = nodes.filter(F.col("data_type") == above.name).select(F.col("node_path").alias("parent_path"), F.col("data_key").alias("_parent"))
            fresh = fresh.join(parents, "_parent", "left")
            missing = F.raise_error(F.concat(F.lit("no parent in the index: "), F.col("_parent"))).cast("array<int>")
            fresh = fresh.withColumn("parent_path", F.when(F.col("parent_path").isNotNull(), F.col("parent_path")).otherwise(missing))
        else:
            fresh = fresh.withColumn("parent_path", F.array().cast("array<int>"))
        if node.latitude:
            attrs = attributes(F.col("doc"))
            lat, lon = resolve_location(attr_text(attrs, node.latitude), attr_text(attrs, node.longitude))
            changed = changed.withColumns({"latitude": lat, "longitude": lon})
        made = store.placed(fresh.select("parent_path", F.col("_doc").alias("doc")), node, definition)
        store.commit(changed.select(*INDEX_COLUMNS).unionByName(made), name)

    return load
