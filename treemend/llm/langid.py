"""Language identification by interpolated Kneser-Ney character models.

One model per language, orders 1 to ``ORDER``, built in a task of its own.
N-grams are packed into one integer and mixed by a bijection, so the sorted
arrays of a model hold hashes that never collide, each with its interpolated
log2 probability; an n-gram that the language has not seen backs off to its
suffix with the weight of its context. A text gets the language of the lowest
cross-entropy per character. It is rejected when that is above a limit
calibrated on all texts of the language, each read by a model of the half of
them that it is not in.
"""

from __future__ import annotations

import functools
import io
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treemend.llm.common import arrow_rows, pieces_of, prepare
from treemend.scale import broadcast_if_small
from treemend.session import cut_lineage

ORDER = 4
# n-grams that a task holds before it hands on their counts.
HELD_GRAMS = 2_000_000
# Spreads above its language's mean at which a text is rejected: see strangeness().
REJECT_SPREADS = 8.0
# Least spread of a language's documents, in bits per character, whatever their length.
LEAST_SPREAD = 0.05
UNKNOWN, EDGE = 1, 2
_LETTER_BITS = 15
# Letters of one language with a number of their own, the most common ones; its other letters are one unknown.
LETTERS = (1 << _LETTER_BITS) - 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Letters(dict):
    """Character -> what a text is read as: letters in lower case, anything else a blank."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        self[code] = c if unicodedata.category(chr(code))[0] == "L" else " "
        return self[code]


_LETTERS = _Letters()


def clean(text: str) -> str:
    return " " + " ".join(text.translate(_LETTERS).split()) + " "


def has_letter(cleaned: str) -> bool:
    return len(cleaned) > 2


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, each behind an edge mark, and the texts' ends."""
    joined = chr(EDGE) + chr(EDGE).join(texts) if texts else ""
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))


@dataclass
class Model:
    """A language: its sorted alphabet, and per order sorted hashes, log2 probabilities, contexts and log2 back-off weights.

    ``base`` is log2 p of any character before any count, the same for all
    languages. ``limit``: see strangeness().
    """

    language: str
    alphabet: np.ndarray
    base: float
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    limit: np.ndarray

    def log2p(self, grams: np.ndarray, order: int) -> np.ndarray:
        """log2 p of the last character of each packed n-gram."""
        if order == 0:
            return np.full(len(grams), self.base, np.float32)
        at, hit = find(self.hashes[order - 1], mix(grams))
        out = self.logp[order - 1][at] if len(self.logp[order - 1]) else np.zeros(len(grams), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            g = grams[miss]
            lower = self.log2p(g & np.uint64((1 << (_LETTER_BITS * (order - 1))) - 1), order - 1)
            c_at, c_hit = find(self.contexts[order - 1], mix(g >> np.uint64(_LETTER_BITS)))
            out[miss] = lower + np.where(c_hit, self.backoff[order - 1][c_at], 0) if len(self.backoff[order - 1]) else lower
        return out


def numbers(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """A language's numbers of code points: letters from 3 on, one number for all others, the edge mark's own."""
    at, hit = find(alphabet, points)
    return np.where(points == EDGE, np.uint64(EDGE), np.where(hit, at.astype(np.uint64) + np.uint64(3), np.uint64(UNKNOWN)))


class Evidence:
    """Texts as distinct n-grams of code points, looked up once in each model."""

    def __init__(self, cleaned: list[str]):
        flat, ends = codes(cleaned)
        self.starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.lengths = ends - self.starts - 1
        self.points, local = np.unique(flat, return_inverse=True)
        windows = last_letters(local, local[flat == EDGE][:1], ORDER)
        self.columns, self.inverse = distinct_rows(windows, len(self.points))

    def bits(self, model: Model) -> np.ndarray:
        """Bits per character of each text."""
        known = numbers(self.points, model.alphabet)
        grams = np.zeros(len(self.columns[0]), np.uint64)
        for back, column in enumerate(self.columns):
            grams |= known[column] << np.uint64(_LETTER_BITS * back)
        per = model.log2p(grams, ORDER).astype(np.float64)[self.inverse]
        per[self.starts] = 0
        return -np.add.reduceat(per, self.starts) / np.maximum(self.lengths, 1) if len(per) else np.zeros(0)


def last_letters(ids: np.ndarray, edge: np.ndarray, order: int) -> list[np.ndarray]:
    """The character at each place and the ``order`` - 1 before it; before an edge mark there are only edge marks."""
    out, seen = [ids], ids == edge if len(edge) else np.zeros(len(ids), bool)
    for back in range(1, order):
        before = np.concatenate([np.repeat(edge, min(back, len(ids))), ids[:-back]])
        before = np.where(seen, edge, before) if len(edge) else before
        seen = seen | (before == edge)
        out.append(before)
    return out


def distinct_rows(columns: list[np.ndarray], below: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of small numbers, as columns, and which of them each row is."""
    if below <= 1 << (64 // len(columns)):
        width = 64 // len(columns)
        key = np.zeros(len(columns[0]), np.uint64)
        for k, c in enumerate(columns):
            key |= c.astype(np.uint64) << np.uint64(width * k)
        found, inverse = np.unique(key, return_inverse=True)
        return [((found >> np.uint64(width * k)) & np.uint64((1 << width) - 1)).astype(np.int64) for k in range(len(columns))], inverse
    found, inverse = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    return list(found.T), inverse.ravel()


def pack(models: list[Model]) -> bytes:
    out = io.BytesIO()
    arrays = {f"{k}_{n}{i}": a for k, m in enumerate(models) for n, held in (("h", m.hashes), ("p", m.logp), ("c", m.contexts), ("b", m.backoff)) for i, a in enumerate(held)}
    np.savez(
        out, languages=np.array([m.language for m in models]), base=np.array([m.base for m in models]), limits=np.array([m.limit for m in models]),
        **{f"{k}_alphabet": m.alphabet for k, m in enumerate(models)}, **arrays,
    )
    return out.getvalue()


@functools.lru_cache(maxsize=2)
def unpack(data: bytes) -> list[Model]:
    z = np.load(io.BytesIO(data))
    return [
        Model(str(name), z[f"{k}_alphabet"], float(z["base"][k]), *[[z[f"{k}_{n}{i}"] for i in range(ORDER)] for n in "hpcb"], limit=z["limits"][k])
        for k, name in enumerate(z["languages"])
    ]


def cross_entropies(models: list[Model], cleaned: list[str]) -> np.ndarray:
    """Bits per character, a row per text and a column per language."""
    evidence = Evidence(cleaned)
    return np.stack([evidence.bits(m) for m in models], axis=1)


def find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (0 where absent) and whether each is there."""
    if not len(sorted_hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_hashes, wanted)
    at[at == len(sorted_hashes)] = 0
    hit = sorted_hashes[at] == wanted
    at[~hit] = 0
    return at, hit


def packed(ids: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters at each place in one integer."""
    out = np.zeros(len(ids), np.uint64)
    for back, letters in enumerate(last_letters(ids, np.array([EDGE], np.uint64), order)):
        out |= letters << np.uint64(_LETTER_BITS * back)
    return out


def count_letters(texts: DataFrame) -> DataFrame:
    """lang, c, count over (lang, text): in how many texts a character stands, lower-cased."""
    schema = pa.schema([("lang", pa.string()), ("c", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, Counter()).update(set(text.lower()))
            for lang, found in by.items():
                yield arrow_rows({"lang": [lang] * len(found), "c": list(found), "n": list(found.values())}, schema)

    return texts.select("lang", "text").mapInArrow(run, "lang string, c string, n long").groupBy("lang", "c").agg(F.sum("n").alias("count"))


def count_grams(texts: DataFrame, alphabets: dict[str, np.ndarray]) -> DataFrame:
    """lang, gram, n0, n1 over (lang, text, half): counts of highest-order n-grams in either half, summed per task, then per n-gram."""
    schema = pa.schema([("lang", pa.string()), ("half", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
    known = texts.sparkSession.sparkContext.broadcast(alphabets)

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

    def rows(held: dict):
        for (lang, half), parts in held.items():
            grams, n = summed(parts)
            yield arrow_rows({"lang": [lang] * len(grams), "half": [half] * len(grams), "gram": grams.view(np.int64), "n": n}, schema)

    def run(batches):
        held: dict[tuple[str, int], list] = {}
        size = 0
        for batch in batches:
            langs, values, halves = (batch.column(i).to_pylist() for i in range(3))
            for a, b in pieces_of(values):
                by: dict[tuple[str, int], list] = {}
                for lang, half, text in zip(langs[a:b], halves[a:b], values[a:b]):
                    by.setdefault((lang, half), []).append(clean(text))
                for key, cleaned in by.items():
                    flat, _ = codes(cleaned)
                    grams = packed(numbers(flat, known.value[key[0]]), ORDER)
                    found = np.unique(grams[flat != EDGE], return_counts=True)
                    held.setdefault(key, []).append(found)
                    size += len(found[0])
                if size > HELD_GRAMS:
                    held = {key: [summed(parts)] for key, parts in held.items()}
                    size = sum(len(g) for [(g, _)] in held.values())
                    if 2 * size > HELD_GRAMS:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    counted = texts.select("lang", "text", "half").mapInArrow(run, "lang string, half int, gram long, n long")
    of = lambda half: F.sum(F.when(F.col("half") == half, F.col("n")).otherwise(0)).alias(f"n{half}")
    return counted.groupBy("lang", "gram").agg(of(0), of(1))


def kneser_ney(grams: np.ndarray, counts: np.ndarray, letters: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order 1..ORDER: n-grams, interpolated p, contexts, back-off weights, of one language.

    The highest order uses counts; a lower order uses how many different
    characters precede an n-gram. The discount is n1 / (n1 + 2 n2).
    """
    shift = np.uint64(_LETTER_BITS)
    levels = [(grams, counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        suffix = levels[0][0] & np.uint64((1 << (_LETTER_BITS * order)) - 1)
        distinct, n = np.unique(suffix, return_counts=True)
        levels.insert(0, (distinct, n.astype(np.float64)))
    out, lower = [], (np.zeros(1, np.uint64), np.array([1.0 / (letters + 2)]))
    for order, (g, n) in enumerate(levels, 1):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.1, 0.95))
        contexts, which = np.unique(g >> shift, return_inverse=True)
        total = np.bincount(which, n)
        weight = discount * np.bincount(which) / total
        suffix = g & np.uint64((1 << (_LETTER_BITS * (order - 1))) - 1)
        p_lower = lower[1][np.searchsorted(lower[0], suffix)]
        p = (n - discount) / total[which] + weight[which] * p_lower
        out.append((g, p, contexts, weight))
        lower = (g, p)
    return out


def build(language: str, grams: np.ndarray, counts: np.ndarray, alphabet: np.ndarray, letters: int) -> Model:
    """A language's sorted arrays from its sorted n-grams; ``letters`` are those of all languages together."""
    hashes, logp, contexts, backoff = [], [], [], []
    for g, p, ctx, weight in kneser_ney(grams, counts, letters):
        by, by_ctx = np.argsort(mix(g)), np.argsort(mix(ctx))
        hashes.append(mix(g)[by])
        logp.append(np.log2(p[by]).astype(np.float32))
        contexts.append(mix(ctx)[by_ctx])
        backoff.append(np.log2(weight[by_ctx]).astype(np.float32))
    base = -float(np.log2(letters + 2.0))
    return Model(language, alphabet, base, hashes, logp, contexts, backoff, np.array([-base, LEAST_SPREAD**2, 1.0]))


def different_texts(learn: DataFrame) -> DataFrame:
    """(lang, text, half): repeated rows once, texts dealt into halves by hash. Only texts with copies are shuffled."""
    on = ["lang", "_h", "_g"]
    rows = learn.select("lang", "text", F.xxhash64(F.lit(7), "text").alias("_h"), F.xxhash64(F.lit(11), "text").alias("_g"))
    copies = broadcast_if_small(cut_lineage(rows.groupBy(*on).count().where("count > 1").select(*on)))
    # the hashes only tell which texts may have copies
    found = rows.join(copies, on, "left_anti").select(*rows.columns).unionByName(rows.join(copies, on, "left_semi").select(*rows.columns).distinct())
    return found.select("lang", "text", (F.col("_h") < 0).cast("int").alias("half"))


def fit_languages(learn: DataFrame) -> bytes | None:
    """Packed models from (lang, text), one per language; None if there is nothing to learn from.

    Rows with a null language, a null text or no letter teach nothing, repeated
    rows teach once; an empty table gives no model. All characters of all other
    texts are counted. Two more models of each language, of either half of its
    texts, calibrate the rejection limit on the other half. Models hold every
    n-gram seen and go to the driver and to the tasks, one set of three at a
    time: their size follows the number of different n-grams of each language.
    """
    spark = prepare(learn.sparkSession)
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    texts = different_texts(learn)
    common = count_letters(texts).withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "c"))).where(F.col("_n") <= LETTERS)
    alphabets = {r["lang"]: np.unique([32, *map(ord, r["cs"])]) for r in common.groupBy("lang").agg(F.collect_list("c").alias("cs")).toLocalIterator()}
    if not alphabets:
        return None
    total = len(set().union(*(a.tolist() for a in alphabets.values())))
    known = spark.sparkContext.broadcast(alphabets)

    def models_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gram", key=lambda g: g.to_numpy(np.int64).view(np.uint64))
        grams = rows["gram"].to_numpy(np.int64).view(np.uint64)
        halves = rows["n0"].to_numpy(np.int64), rows["n1"].to_numpy(np.int64)
        found = [(i, n > 0, n) for i, n in enumerate((*halves, sum(halves))) if n.any()]
        return pd.DataFrame({"lang": key[0], "part": i, "model": pack([build(key[0], grams[has], n[has], known.value[key[0]], total)])} for i, has, n in found)

    # a language's different n-grams are one task's work
    built = cut_lineage(count_grams(texts, alphabets).groupBy("lang").applyInPandas(models_of, "lang string, part int, model binary"))
    part = lambda i: [unpack.__wrapped__(bytes(r["model"]))[0] for r in built.where(F.col("part") == i).orderBy("lang").toLocalIterator()]
    seen: dict[tuple[str, int], np.ndarray] = {}
    for half in (0, 1):
        for key, sums in strangeness(spark, part(half), texts.where(F.col("half") != half)).items():
            seen[key] = seen.get(key, 0) + sums
    models = part(2)
    for m in models:
        own = [sums for (lang, _), sums in sorted(seen.items()) if lang == m.language]
        if own:
            m.limit = np.array(variance_parts(*np.array(own).T))
    return pack(models)


def strangeness(spark, models: list[Model], texts: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Per language and octave of length: texts, sums of 1 / n, of the cross-entropy and its square, of texts that the models have not seen.

    A language's limit (mean, between, within) is their mean cross-entropy and
    the two parts of its variance. Documents differ in style by ``between``,
    however long they are; on top of that the cross-entropy of n characters
    varies by ``within`` / n. A text is rejected when it lies
    ``REJECT_SPREADS`` spreads, the root of between + within / n, above the
    mean. Texts meet in octaves of length, so the driver sees some thirty rows
    a language.
    """
    data = spark.sparkContext.broadcast(pack(models))

    def run(batches):
        by_name = {m.language: m for m in unpack(data.value)}
        for b in batches:
            langs, values = b["lang"].tolist(), b["text"].tolist()
            for x, y in pieces_of(values):
                own: dict[str, list[str]] = {}
                for lang, c in zip(langs[x:y], map(clean, values[x:y])):
                    if lang in by_name and has_letter(c):
                        own.setdefault(lang, []).append(c)
                for lang, cleaned in own.items():
                    h, n = Evidence(cleaned).bits(by_name[lang]), np.array(list(map(len, cleaned)), float)
                    yield pd.DataFrame({"k": lang, "o": np.log2(n).astype(int), "c": 1.0, "r": 1 / n, "h": h, "hh": h * h})

    sums = texts.select("lang", "text").mapInPandas(run, "k string, o int, c double, r double, h double, hh double").groupBy("k", "o").agg(*[F.sum(x).alias(x) for x in ("c", "r", "h", "hh")])
    return {(r["k"], r["o"]): np.array([r["c"], r["r"], r["h"], r["hh"]]) for r in sums.toLocalIterator()}


def variance_parts(c: np.ndarray, r: np.ndarray, h: np.ndarray, hh: np.ndarray) -> tuple[float, float, float]:
    """mean, between, within from sums per group of like length: texts, 1 / n, cross-entropy and its square.

    The mean weighs texts by their fitted precision, and the squared
    deviations are fitted by between + within / n, each group with the
    precision that fit implies; a few rounds settle both. Neither part falls
    below its floor.
    """
    floors = np.array([LEAST_SPREAD**2, 1.0])
    x = np.stack([np.ones(len(c)), r / c], axis=1)
    parts = floors
    for _ in range(50):
        v = x @ parts
        mean = (h / v).sum() / (c / v).sum()
        off = np.maximum(0.0, hh / c - 2 * mean * h / c + mean * mean)
        w = c / (v * v)
        (aa, ab), (_, bb) = (x * w[:, None]).T @ x
        ya, yb = (x * w[:, None]).T @ off
        det = aa * bb - ab * ab
        free = np.array([bb * ya - ab * yb, aa * yb - ab * ya]) / det if det > 1e-9 * aa * bb else np.array([-1.0, -1.0])
        if (free < floors).any():
            # one part at its floor, the other by itself; the better of both
            ends = [np.array([floors[0], max(floors[1], (yb - floors[0] * ab) / bb)]), np.array([max(floors[0], (ya - floors[1] * ab) / aa), floors[1]])]
            free = min(ends, key=lambda p: (w * (off - x @ p) ** 2).sum())
        parts = (parts + free) / 2
    return float(mean), float(parts[0]), float(parts[1])


def language_column(model: bytes | None):
    """text -> struct<lang, score, rejected>, a function of columns.

    ``und``, score 0 and rejected for null texts and texts without a letter,
    and for all texts without a model; equal cross-entropies: the first
    language by name;
    score is the posterior of the best language over the first 100 characters'
    worth of evidence, so it stays short of certain for short texts.
    """
    from pyspark.sql import SparkSession

    data = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        lang, score, rejected = ["und"] * len(values), np.zeros(len(values)), np.ones(len(values), bool)
        if data.value is not None:
            models = unpack(data.value)
            limits = np.array([m.limit for m in models])
            for a, b in pieces_of(values):
                cleaned = [clean(t) if isinstance(t, str) else "" for t in values[a:b]]
                rows = [i for i, c in enumerate(cleaned) if has_letter(c)]
                if not rows:
                    continue
                h = cross_entropies(models, [cleaned[i] for i in rows])
                best = h.argmin(1)
                n = np.array([len(cleaned[i]) for i in rows], float)
                low = h[np.arange(len(rows)), best]
                odds = np.exp2(-np.minimum(n, 100)[:, None] * (h - low[:, None]))
                mean, between, within = limits[best].T
                for i, k, s, r in zip(rows, best, 1 / odds.sum(1), low > mean + REJECT_SPREADS * np.sqrt(between + within / n)):
                    lang[a + i], score[a + i], rejected[a + i] = models[k].language, s, r
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return lambda text: of(text.cast("string"))
