"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target number of words. Whole copies of a source come
first; the rest of its budget is fitted on the histogram of exact document
lengths: a proportional share of every length, then a bounded-knapsack
dynamic programme over the few words that remain. Which documents of a length
go in is settled by a seeded hash. Only histograms and sums leave the rows;
a length that a third of all documents share is cut by hash buckets, so that
no task ranks a whole length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemend.llm.common import prepare, word_count
from treemend.scale import ordinal_in_group
from treemend.session import cut_lineage

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
SEED = 20240101
BUCKET_BITS = 12
# Words the proportional share leaves to the dynamic programme at least.
DP_WORDS = 4000


def source_key(source: Column) -> Column:
    """A text that is never null and keeps the order: sources by code point, null last."""
    return F.when(source.isNull(), F.lit("~null")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """_source, source_size, target from (_source, source_size).

    Weights repeat along the sources. A target is min(most * size, level *
    weight), with the level at which all targets add up to all sizes; each
    round computes it over the sources below their limit, until none is above.
    """
    ranked = ordinal_in_group(sizes, [], ["_source"], "_i").withColumn(
        "_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_i") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = cut_lineage(ranked)
    limit, level = most * F.col("source_size"), 0.0
    while True:
        under = limit > level * F.col("_w")
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(~under, limit)).alias("held"), F.sum(F.when(under, F.col("_w"))).alias("w")
        ).first()
        if not row["all"] or not row["w"]:
            break
        new = (row["all"] - (row["held"] or 0)) / row["w"]
        if new <= level:
            break
        level = new
    return ranked.select("_source", "source_size", F.least(limit.cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take so that their words come to the budget, or as near as found.

    Every length first gives its share, then single documents are added where
    the share was cut most (long ones first, so that short ones are left to choose from), until about ``DP_WORDS`` words remain. The dynamic
    programme finds the largest sum of the documents left that fits; one more
    document goes in if that ends nearer.
    """
    total = float((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros_like(counts)
    budget = min(budget, total)
    share = counts * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    left = int(round(budget)) - int((lengths * take).sum())
    for more in (1, None):
        for i in np.lexsort((-lengths, -(share - np.floor(share)))):
            room = left - (DP_WORDS if more else 0)
            n = min(int(counts[i] - take[i]), room // int(lengths[i]) if room > 0 else 0, more or counts[i])
            if more is None and lengths[i] <= DP_WORDS:
                n = min(n, max(0, (left - DP_WORDS) // int(lengths[i])))
            if n > 0:
                take[i] += n
                left -= n * int(lengths[i])
    if left > 0:
        best, chosen = _knapsack(lengths, counts - take, left)
        take, left = take + chosen, left - best
    spare = np.flatnonzero(take < counts)
    if left > 0 and len(spare):
        i = spare[np.argmin(np.abs(lengths[spare] - left))]
        if abs(lengths[i] - left) < left:
            take[i] += 1
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[int, np.ndarray]:
    """Largest reachable sum up to the budget, and the counts that reach it (bounded counts by binary splitting)."""
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps = []
    for i in np.flatnonzero((counts > 0) & (lengths <= budget)):
        n, part = min(int(counts[i]), budget // int(lengths[i])), 1
        while n > 0:
            part = min(part, n)
            steps.append((int(i), part, reach))
            reach |= (reach << (int(lengths[i]) * part)) & mask
            n, part = n - part, part * 2
        if reach >> budget & 1:
            break
    best = at = reach.bit_length() - 1
    chosen = np.zeros_like(counts)
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            chosen[i] += part
            at -= int(lengths[i]) * part
    return best, chosen


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, size: Column | None = None, pick: Column | None = None
) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, with size, source_size, target and copies (0 to ``most``).

    ``size`` defaults to the words of ``text`` (null: 0), ``pick`` to a seeded
    hash of id and text. Null sources are one source, the last. Empty texts
    have size 0 and go along with whole copies only. Repeated rows are
    documents of their own; rows with equal hash are told apart by nothing, so
    either may be taken. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        source_key(F.col("source")).alias("_source"),
        (word_count(F.col("text")) if size is None else size).alias("size"),
        (F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")) if pick is None else pick).alias("_hash"),
    ).withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - BUCKET_BITS).cast("int"))
    counts = cut_lineage(rows.groupBy("_source", "size", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    lengths = counts.groupBy("_source", "size").agg(F.sum("_n").alias("_n"))
    wanted = cut_lineage(targets(lengths.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, most))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    wanted = wanted.withColumn("_whole", whole.cast("int")).withColumn(
        "_rest", F.when(F.col("_whole") < most, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(0.0)
    )

    def fit(hist: pd.DataFrame) -> pd.DataFrame:
        hist = hist.sort_values("size", ignore_index=True)
        hist["_take"] = fit_budget(hist["size"].to_numpy(np.int64), hist["_n"].to_numpy(np.int64), float(hist["_rest"].iloc[0]))
        return hist[["_source", "size", "_take"]]

    # one row per distinct length of a source: at most the square root of twice its words
    takes = (
        lengths.where("size > 0").join(wanted.select("_source", "_rest"), "_source")
        .groupBy("_source").applyInPandas(fit, "_source string, size long, _take long")
    )
    upto = Window.partitionBy("_source", "size").orderBy("_bucket")
    cut = (
        counts.join(takes, ["_source", "size"], "left")
        .withColumn("_need", F.coalesce("_take", F.lit(0)) - (F.sum("_n").over(upto) - F.col("_n")))
        .select("_source", "size", "_bucket", F.greatest(F.lit(0), F.least("_need", "_n")).alias("_need"), "_n")
        .join(wanted.select("_source", "source_size", "target", "_whole"), "_source")
    )
    cut = cut_lineage(cut)
    keys = ["_source", "size", "_bucket"]
    # one shuffle of the rows, at every size: the cuts grow with the rows and are never broadcast
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    ranked = rows.join(cut.hint("merge"), keys).withColumn("_one", (rank <= F.col("_need")).cast("int"))
    return ranked.select("row", "size", "source_size", "target", (F.col("_whole") + F.col("_one")).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    mix = mix_sources(docs, **options).where("copies > 0")
    return mix.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of a document, repeats counted)."""
    narrow = cut_lineage(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("_words"), F.xxhash64(F.lit(options.get("seed", SEED)), F.col("doc_id"), F.col("text")).alias("_pick")
    ))
    mix = mix_sources(narrow, size=F.col("_words"), pick=F.col("_pick"), **options)
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
