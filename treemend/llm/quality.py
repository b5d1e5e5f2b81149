"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of a whole text are standardised and mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel. Each task
sums its part of the normal equations; Spark adds the parts block by block,
and the driver solves one system of fixed size. Raw scores of a separate fold
are counted in bins of fixed width, and pool-adjacent-violators turns the bins
into probabilities.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import prepare
from treemend.session import cut_lineage

FEATURES = 384
RIDGE = 1e-4
SEED = 11
BINS_PER_UNIT = 1024
# Share of the learnable labels (by id hash) that calibrates and does not fit.
CALIBRATION_PART = 5
_BLOCK = 32

_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate((b" \t\n\v\f\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*@^~+=<>_\\/", b"|[]{}"), 1):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 8
N_CLASSES = 9
NAMES = [
    "log_chars", "log_words", "log_lines", *(f"class_{i}" for i in range(N_CLASSES)), "mean_word", "spread_word", "long_words", "short_words",
    "distinct_words", "top_word", "top_three", "word_entropy", "distinct_lines", "line_words", "upper_words", "marked_words", "sentence_words",
    "same_as_last", "distinct_pairs",
]


def statistics(text: str | None) -> list[float]:
    """The numbers a text is judged by; all 0 for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES) / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    common = [c for _, c in counts.most_common(3)]
    shares = np.fromiter(counts.values(), np.float64, len(counts)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    ends = np.bincount(_CLASS[last], minlength=N_CLASSES)
    first = np.fromiter((w[0] for w in words), np.uint8, n)
    upper = sum(map(bytes.isupper, words))
    pairs = len(set(zip(words, words[1:])))
    capital = int(((first >= 65) & (first <= 90)).sum())
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), *classes, lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths <= 3).mean(),
        len(counts) / n ** 0.8, common[0] / n, sum(common) / n, float(-(shares * np.log2(shares)).sum()) / max(1.0, np.log2(n)),
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), upper / n, (ends[5] + ends[6] + ends[7]) / n, capital / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, (pairs + 1) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``_x``, the statistics of the text."""

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(t), np.float32) for t in texts])

    return docs.withColumn("_x", of(F.col("text").cast("string")))


@dataclass
class Scorer:
    """Everything a score needs."""

    mean: np.ndarray
    spread: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    chance: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.projection + self.phase
        return np.hstack([np.sqrt(2.0 / len(self.phase)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights if self.weights is not None else np.full(len(x), 0.5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.chance)


def summed(rows: DataFrame, part, blocks: int) -> np.ndarray:
    """The sum over all rows of ``part(features, labels)``, a matrix of fixed size, added block by block in Spark."""

    def run(batches):
        total = None
        for b in batches:
            if len(b):
                m = part(np.stack(b["_x"]).astype(np.float64), b["_y"].to_numpy(np.float64))
                total = m if total is None else total + m
        if total is not None:
            parts = np.array_split(total, blocks)
            yield pd.DataFrame({"k": range(blocks), "v": [p.tobytes() for p in parts]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [b["k"].iloc[0]], "v": [sum(np.frombuffer(v) for v in b["v"]).tobytes()]})

    got = rows.select("_x", "_y").mapInPandas(run, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(got, key=lambda r: r["k"])]) if got else np.zeros(0)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and chances of the pooled blocks, which never fall.

    Half an example on each side keeps the chances off 0 and 1. That moves small
    blocks more than large ones, so a block takes at least what the one before has.
    """
    blocks: list[list[float]] = []
    for row in zip(x * n, total, n):
        blocks.append(list(row))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], np.maximum.accumulate((b[:, 1] + 0.5) / (b[:, 2] + 1.0))


def fit_quality(examples: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Scorer:
    """A scorer from rows (_x, _y, _calibrate). No row at all gives 0.5 for every text.

    Without rows to calibrate on, those that were fitted calibrate. Equal raw
    scores share a bin, so ties get one score.
    """
    d = len(NAMES)
    rng = np.random.default_rng(SEED)
    scorer = Scorer(np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, features)), rng.uniform(0, 2 * np.pi, features))
    fit, late = examples.where("NOT _calibrate"), examples.where("_calibrate")
    sums = summed(fit, lambda x, y: np.stack([np.full(d, len(x)), x.sum(0), (x * x).sum(0)]).ravel(), 1)
    if not len(sums):
        return scorer
    n, s, q = sums.reshape(3, d)
    scorer.mean = s / n
    scorer.spread = np.sqrt(np.maximum(q / n - scorer.mean**2, 1e-12)) + 1e-6

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = scorer.cosines(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]]).ravel()

    m = features + 1
    system = summed(fit, equations, _BLOCK).reshape(m, m + 1)
    scorer.weights = np.linalg.solve(system[:, :m] + ridge * n[0] * np.eye(m) / m, system[:, m])
    data = examples.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("int")
    def bin_of(x: pd.Series) -> pd.Series:
        raw = data.value.raw(np.stack(x).astype(np.float64)) if len(x) else np.zeros(0)
        return pd.Series(np.clip(np.round(raw * BINS_PER_UNIT), -2 * BINS_PER_UNIT, 3 * BINS_PER_UNIT).astype(np.int32))

    # at most five units' worth of bins
    bins = (late if late.limit(1).count() else fit).select(bin_of("_x").alias("b"), "_y").groupBy("b").agg(F.sum("_y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    x, y, n = (np.array(v, float) for v in zip(*bins))
    scorer.knots, scorer.chance = isotonic(x / BINS_PER_UNIT, y, n)
    return scorer


def score_quality(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, with ``score`` (0 to 1).

    ``labels`` are (doc_id, quality); null ids and null labels are left out,
    repeated ids count once with their mean. ``learn`` is a condition on the
    id: which labels may be learned from. Null and empty texts have all
    statistics 0 and get the score of that point. Only statistics of the text
    go into a score.
    """
    spark = prepare(docs.sparkSession)
    rows = cut_lineage(with_statistics(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "_x"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("_y"))
    if learn is not None:
        known = known.where(learn(F.col("doc_id")))
    part = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")) % CALIBRATION_PART == 0
    examples = cut_lineage(rows.select(F.col("row.doc_id").alias("doc_id"), "_x").join(known, "doc_id").select("_x", "_y", part.alias("_calibrate")))
    scorer = spark.sparkContext.broadcast(fit_quality(examples))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(scorer.value.scores(np.stack(x).astype(np.float64)) if len(x) else np.zeros(0))

    return rows.select("row", score("_x").alias("score"))
