"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most ``radius`` bits agree on all bits of some
``m - radius`` of ``m`` bit groups. Each choice of groups deals the distinct
fingerprints out by those bits; within such a stretch they are ordered by
population count and cut into tiles, and two tiles are compared (exclusive or
and bit counts, all against all) only if their population counts can be
within the radius. The more fingerprints, the more groups, so stretches stay
small; any number of groups is exact. A tile gives a spanning forest of its
links, not all pairs. Components come from rounds of joins.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import arrow_rows, only, prepare
from treemend.llm.components import components
from treemend.session import cut_lineage

RADIUS = 4
SHINGLE = 4
BITS = 64
TILE = 2048
# Stretches are meant to hold about this many fingerprints.
STRETCH = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 of word shingles (A-Z lowered, split at ASCII blanks); no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` with ``_fp``, a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("_fp", of(F.col("text").cast("string")))


def bit_groups(fingerprints: int, radius: int = RADIUS) -> list[int]:
    """Masks, one of which two fingerprints within the radius agree on; as many bits each as the number asks for."""
    want = max(1.0, np.log2(max(fingerprints, 1) / STRETCH))
    for groups in range(radius + 1, BITS // 2):
        if BITS * (groups - radius) / groups >= want or groups >= 3 * radius:
            break
    edges = np.linspace(0, BITS, groups + 1).round().astype(int)
    parts = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, groups - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def tile_links(values: np.ndarray, radius: int, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``values``, or of those between ``values`` and ``others``.

    ``values`` (and ``others``) are distinct and ordered by population count.
    """
    left, right = [], []
    whole = values if others is None else np.concatenate([values, others])
    parent = np.arange(len(whole))
    offset = 0 if others is None else len(values)
    others = values if others is None else others

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pa_, pb = np.bitwise_count(values).astype(int), np.bitwise_count(others).astype(int)
    step = 256
    for i in range(0, len(values), step):
        a = values[i : i + step]
        lo = np.searchsorted(pb, pa_[i] - radius) if offset else i
        hi = np.searchsorted(pb, pa_[min(i + step, len(values)) - 1] + radius, "right")
        for j in range(lo, hi, TILE):
            b = others[j : min(j + TILE, hi)]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            for p, q in zip((x + i).tolist(), (y + j + offset).tolist()):
                if p != q and (p_ := root(p)) != (q_ := root(q)):
                    parent[q_] = p_
                    left.append(p)
                    right.append(q)
    return whole[left], whole[right]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links that join exactly the fingerprints within the radius of each other, directly or along links.

    ``fps`` holds distinct longs in ``_fp``. A stretch longer than ``TILE`` is
    dealt out as pairs of tiles (population count and hash), so a very common
    pattern of bits is many tasks.
    """
    masks = bit_groups(fps.count(), radius)
    keyed = fps.select("_fp", F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("_t", "_v"))
    keyed = keyed.withColumn("_pop", F.bit_count("_fp").cast("int"))
    sizes = keyed.groupBy("_t", "_v", "_pop").agg(F.count(F.lit(1)).alias("_n"))
    stretch = sizes.groupBy("_t", "_v").agg(
        F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_pop", F.ceil(F.col("_n") / TILE).cast("int")))).alias("_tiles")
    )
    keyed = keyed.join(stretch.where("_all > 1"), ["_t", "_v"])
    whole = keyed.where(F.col("_all") <= TILE).select("_fp", "_pop", F.xxhash64("_t", "_v").alias("_key"), "_t", "_v", F.lit("").alias("_pair"), F.lit(0).alias("_side"))
    # a long stretch: each tile meets itself and every tile at most the radius above it
    hot = keyed.where(F.col("_all") > TILE).withColumn("_tile", F.pmod(F.xxhash64("_fp"), F.col("_tiles")[F.col("_pop")]).cast("int"))
    near = F.flatten(F.transform(
        F.filter(F.map_keys("_tiles"), lambda p: F.abs(p - F.col("_pop")) <= radius),
        lambda p: F.transform(F.sequence(F.lit(0), F.col("_tiles")[p] - 1), lambda t: F.struct(p.alias("p"), t.alias("t"))),
    ))
    me = F.struct(F.col("_pop").alias("p"), F.col("_tile").alias("t"))
    name = lambda s: F.concat_ws(".", s["p"].cast("string"), s["t"].cast("string"))
    hot = hot.withColumn("_o", F.explode(near)).withColumn("_me", me).select(
        "_fp", "_pop", "_t", "_v",
        F.when(F.col("_me") <= F.col("_o"), F.concat_ws("-", name(F.col("_me")), name(F.col("_o")))).otherwise(F.concat_ws("-", name(F.col("_o")), name(F.col("_me")))).alias("_pair"),
        F.when(F.col("_me") == F.col("_o"), 0).when(F.col("_me") < F.col("_o"), 1).otherwise(2).alias("_side"),
    )
    hot = hot.select("_fp", "_pop", F.xxhash64("_t", "_v", "_pair").alias("_key"), "_t", "_v", "_pair", "_side")
    dealt = whole.unionByName(hot).repartition("_key").sortWithinPartitions("_key", "_t", "_v", "_pair", "_side", "_pop", "_fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table):
            cols = [table.column(n).to_numpy() for n in ("_key", "_t", "_v", "_side")]
            fp = table.column("_fp").to_numpy().view(np.uint64)
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            out = []
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(fp)]):
                side = cols[3][a:b]
                split = a + int(np.searchsorted(side, 2))
                if b - a > 1 and (side[0] == 0 or a < split < b):
                    out.append(tile_links(fp[a:b], radius) if side[0] == 0 else tile_links(fp[a:split], radius, fp[split:b]))
            if out:
                yield arrow_rows({k: np.concatenate([o[i] for o in out]).view(np.int64) for i, k in enumerate(("u", "v"))}, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index("_key")).to_numpy()
            # all but the last run of keys is complete
            start = int(np.searchsorted(keys, keys[-1]))
            if start or (held and held[-1].column("_key")[0].as_py() != keys[0]):
                yield from emit(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            held.append(batch.slice(start))
        if held:
            yield from emit(pa.Table.from_batches(held))

    return dealt.select("_key", "_t", "_v", "_side", "_fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links, itself included.

    Every row is a document; repeated rows fall together. Null and empty texts
    have fingerprint 0 and are linked like any other. A null id is in its
    component but names none; a component of null ids has a null id. An empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    prints = cut_lineage(with_fingerprints(only(docs, "doc_id", "text"), shingle).select("doc_id", "_fp"))
    return prints.join(component_ids(prints, radius), "_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def component_ids(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """_fp, _root (a fingerprint of the component), component_id, for each distinct fingerprint."""
    distinct = cut_lineage(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")))
    roots = components(links(distinct.select("_fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left")
    named = cut_lineage(named.select("_fp", "_least", F.coalesce("root", "_fp").alias("_root")))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return named.join(least, "_root").select("_fp", "_root", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The documents, one of each component: the one with the smallest id, null ids last.

    Of rows that share an id, the first in the order they are written stays.
    """
    prepare(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    # narrow rows decide; the place of a row in its written chunk tells repeated rows apart
    marked = with_fingerprints(docs.select(whole, "doc_id", "text"), shingle).select("_doc", "doc_id", "_fp", F.monotonically_increasing_id().alias("_row"))
    kept = cut_lineage(marked)
    narrow = kept.select("doc_id", "_fp", "_row")
    narrow = narrow.join(component_ids(narrow, radius).select("_fp", "_root"), "_fp")
    best = narrow.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("_best"))
    return kept.join(best.select(F.col("_best._row").alias("_row")), "_row", "left_semi").select("_doc.*")
