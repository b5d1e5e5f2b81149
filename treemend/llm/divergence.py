"""Source divergence audit: how far the term shares of sources of one language lie apart.

Terms are counted by sorting pointers, not strings: the bytes of many texts lie
one after another in an Arrow buffer, a pointer marks each term's start, and a
multikey quicksort orders the pointers of a slice by the terms they point to,
eight bytes at a time. Runs of equal terms then give the documents and the
counts per source, since pointers keep the order of their groups and texts.
Spark sums the runs of all slices.

Shares are whole numbers, and all arithmetic is exact. Sums over terms for
pairs of sources are built from the terms that one of the two has; for all
others the share depends on the source alone. Terms are dealt out by hash and
sources in tiles, so no task holds all terms of a language or all pairs.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treemend.llm.common import arrow_rows, prepare
from treemend.scale import ordinal_in_group
from treemend.session import cut_lineage

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
# Bytes of text whose pointers are sorted together.
SLICE_BYTES = 16_000_000
# Pointers up to which a part is sorted at once instead of being parted around a pivot.
BASE = 1 << 15
# Bytes of a term that are compared eight at a time; the rest of longer ones is compared whole.
DEEP = 64
# Sources of a tile's side, and entries of a tile that are held before they are summed.
TILE = 256
HELD = 100_000

_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)


class Pointers:
    """Starts and lengths of the terms in ``bytes``, which are in lower case and 0 where no term is; padded by 8."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        inside = low != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        borders = offsets[(offsets > 0) & (offsets < len(low))]
        first[borders] = inside[borders]  # a term ends with its text
        ends = np.zeros(len(low) + 1, bool)
        ends[1:] = inside
        ends[1:-1] &= ~inside[1:] | first[1:]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(ends) - self.start
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.bytes = np.concatenate([low, np.zeros(8, np.uint8)])
        self._eights = np.lib.stride_tricks.sliding_window_view(self.bytes, 8) if len(low) else None

    def eight(self, which: np.ndarray, depth: int) -> np.ndarray:
        """The terms' bytes from ``depth`` on as one number each, 0 behind their ends; ordered as the bytes are."""
        left = np.clip(self.length[which] - depth, 0, 8)
        at = np.where(left > 0, self.start[which] + depth, 0)
        number = np.ascontiguousarray(self._eights[at]).view(">u8").ravel().astype(np.uint64)
        cut = ((8 - left) * 8).astype(np.uint64)
        return np.where(left > 0, number >> np.minimum(cut, 56) << np.minimum(cut, 56), 0)

    def rest(self, at: int, depth: int) -> bytes:
        return self.bytes[self.start[at] + depth : self.start[at] + self.length[at]].tobytes()


def multikey_quicksort(p: Pointers) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, equal terms in the order of pointers, and which begin a new term."""
    order, fresh = np.empty(len(p.start), np.int64), np.ones(len(p.start), bool)
    parts = [(np.arange(len(p.start)), 0, 0)]  # pointers, the bytes they agree on, the place of the first
    while parts:
        which, depth, at = parts.pop()
        if len(which) <= BASE or depth >= DEEP:
            order[at : at + len(which)], fresh[at : at + len(which)] = _sort_part(p, which, depth)
            continue
        key = p.eight(which, depth)
        sample = np.sort(key[:: len(which) // 99 + 1])
        pivot = sample[len(sample) // 2]
        less, equal, more = which[key < pivot], which[key == pivot], which[key > pivot]
        middle = at + len(less)
        parts += [(less, depth, at), (more, depth, middle + len(equal))]
        if pivot & np.uint64(0xFF):
            parts.append((equal, depth + 8, middle))
        else:  # the terms end within these bytes: all equal
            order[middle : middle + len(equal)] = equal
            fresh[middle + 1 : middle + len(equal)] = False
    return order, fresh


def _sort_part(p: Pointers, which: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for pointers that agree up to ``depth``: sorted eight bytes at a time, runs that are still equal further on."""
    which, run = which.copy(), np.zeros(len(which), np.int64)
    todo = np.arange(len(which))
    while len(todo) > 1 and depth < DEEP:
        key = p.eight(which[todo], depth)
        by = np.lexsort((key, run[todo])) if depth or run.any() else np.argsort(key, kind="stable")
        which[todo], key, own = which[todo[by]], key[by], run[todo]
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        number = todo[np.flatnonzero(new)][np.cumsum(new) - 1]
        run[todo] = number  # a run is named by the place of its first pointer
        same = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        todo = todo[(same > 1) & ((key & np.uint64(0xFF)) != 0)]
        depth += 8
    if len(todo) > 1:
        rest = sorted((int(run[t]), p.rest(which[t], depth), i) for i, t in enumerate(todo))
        which[todo] = which[todo[[i for _, _, i in rest]]]
        before, number = None, 0
        for t, (r, term, _) in zip(todo, rest):
            number = number if before == (r, term) else t
            run[t], before = number, (r, term)
    return which, np.r_[True, run[1:] != run[:-1]][: len(run)]


def slice_counts(groups: list[tuple[str, str]], texts: pa.Array) -> dict[str, list]:
    """lang, source, term, n, docs of the texts of a slice, summed per group and term."""
    codes: dict[tuple[str, str], int] = {}
    code = np.array([codes.setdefault(g, len(codes)) for g in groups], np.int64)
    by = np.argsort(code, kind="stable")
    texts, code = texts.take(pa.array(by)), code[by]
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    p = Pointers(data, offsets - offsets[0])
    if not len(p.start):
        return {}
    order, fresh = multikey_quicksort(p)
    text = p.text[order]
    group = code[text]
    first = np.flatnonzero(fresh | np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.r_[first, len(order)])
    docs = np.add.reduceat((fresh | np.r_[True, text[1:] != text[:-1]]).astype(np.int64), first)
    raw, heads = p.bytes.tobytes(), order[fresh]
    terms = pa.array([raw[s : s + n] for s, n in zip(p.start[heads].tolist(), p.length[heads].tolist())], pa.binary()).cast(pa.string())
    which = pa.array(group[first])
    names = list(codes)
    return {
        "lang": pa.array([g[0] for g in names]).take(which), "source": pa.array([g[1] for g in names]).take(which),
        "term": terms.take(pa.array(np.cumsum(fresh)[first] - 1)), "n": counts, "docs": docs,
    }


def term_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        groups, texts, size = [], [], 0

        def counted():
            out = slice_counts(groups, pa.concat_arrays(texts))
            groups.clear()
            texts.clear()
            if out:
                yield arrow_rows(out, schema)

        for batch in batches:
            column = batch.column(2).cast(pa.large_binary())
            lengths = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            begin = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > slice_bytes:
                    texts.append(column.slice(begin, i - begin))
                    groups += names[begin:i]
                    begin, size = i, 0
                    yield from counted()
                size += n
            texts.append(column.slice(begin))
            groups += names[begin:]
        if groups:
            yield from counted()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*named).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count, total, kept):
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for any long."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 1)).cast("decimal(38,0)")
    return F.call_function("div", top, (wide(total) + wide(kept)).cast("decimal(38,0)")) + 1


def distance(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(shares: np.ndarray, there: np.ndarray, alone: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over terms of (p - q)^2 / q, beyond what it is for terms that neither source has: a row per left, a column per right source.

    ``shares`` (terms x sources) holds ``alone``, the share of a source without
    the term, where ``there`` is false.
    """
    base = (alone[left][:, None] - alone[right]) ** 2 // alone[right]
    out = np.zeros(base.shape, np.int64)
    for i, g in enumerate(left):
        rows = there[:, g]
        p, q = shares[rows, g][:, None], shares[rows][:, right]
        out[i] += ((p - q) ** 2 // q - base[i]).sum(0)
    for j, s in enumerate(right):
        rows = there[:, s]
        p, q = shares[rows][:, left], shares[rows, s][:, None]
        out[:, j] += np.where(there[rows][:, left], 0, (p - q) ** 2 // q - base[:, j]).sum(0)
    return out


class Tile:
    """Sums of one tile of sources over the terms of one part."""

    def __init__(self, diagonal: bool):
        self.diagonal = diagonal
        self.names: list[list[str]] = [[], []]
        self.alone: list[list[int]] = [[], []]
        self.column: dict[tuple[int, int], int] = {}
        self.entries: list[tuple[int, int, int]] = []
        self.kept = self.terms = 0
        self.sums: list[np.ndarray] | None = None
        self.last = None

    def source(self, side: int, number: int, name: str, alone: int, kept: int) -> None:
        self.column[side, number] = len(self.names[side])
        self.names[side].append(name)
        self.alone[side].append(alone)
        self.kept = kept

    def add(self, term: str, side: int, number: int, p: int) -> None:
        if term != self.last:
            if len(self.entries) >= HELD or self.terms * len(self.column) >= 4 * HELD * 16:
                self.settle()
            self.last, self.terms = term, self.terms + 1
        self.entries.append((self.terms - 1, self.column[side, number] + side * len(self.names[0]), p))

    def ways(self) -> list[tuple[np.ndarray, np.ndarray]]:
        a, b = np.arange(len(self.names[0])), np.arange(len(self.names[1])) + len(self.names[0])
        return [(a, a)] if self.diagonal else [(a, b), (b, a)]

    def settle(self) -> None:
        alone = np.array(self.alone[0] + self.alone[1], np.int64)
        if self.sums is None:
            self.sums = [np.zeros((len(x), len(y)), np.int64) for x, y in self.ways()]
        if self.entries:
            t, c, p = np.array(self.entries, np.int64).T
            shares, there = np.tile(alone, (self.terms, 1)), np.zeros((self.terms, len(alone)), bool)
            shares[t, c], there[t, c] = p, True
            for total, (x, y) in zip(self.sums, self.ways()):
                total += pair_sums(shares, there, alone, x, y)
        self.entries, self.terms, self.last = [], 0, None

    def rows(self, first_part: bool):
        """(way, left source, its name, right sources, sums) of the tile; the first part adds the terms that neither source has, and names."""
        self.settle()
        names, alone = self.names[0] + self.names[1], np.array(self.alone[0] + self.alone[1], np.int64)
        for way, (total, (x, y)) in enumerate(zip(self.sums, self.ways())):
            if first_part:
                total = total + self.kept * ((alone[x][:, None] - alone[y]) ** 2 // alone[y])
            items = [names[s] for s in y] if first_part else None
            for i, g in enumerate(x):
                yield way, i, names[g], items, total[i]


def pair_divergence(entries: DataFrame, groups: DataFrame, parts: int, tile: int = TILE) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language.

    ``entries``: lang, _no, term, p of the terms a source has. ``groups``: lang,
    source, _no (from 1), _sources, _kept, _alone.
    """
    part = F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("_part")
    has = entries.select("lang", part, "_no", "_sources", "term", "p", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("_kept"))
    # a source's share of terms it does not have goes to every part, ahead of the terms
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")
    heads = groups.select("lang", every, "_no", "_sources", F.lit("").alias("term"), F.col("_alone").alias("p"), "source", "_kept")
    own = ((F.col("_no") - 1) / tile).cast("int")
    others = F.explode(F.sequence(F.lit(0), ((F.col("_sources") - 1) / tile).cast("int")))
    tiles = heads.unionByName(has).withColumn("_own", own).withColumn("_other", others)
    names = ("_part", "lang", "_a", "_b", "_side", "_no", "term", "p", "source", "_kept")
    placed = tiles.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other"), "_side": (F.col("_own") > F.col("_other")).cast("int")}).select(*names)
    dealt = placed.repartition(parts, "_part").sortWithinPartitions("_part", "lang", "_a", "_b", "term", "_side", "_no")
    keys = ["lang", "_a", "_b", "_way", "_i"]
    schema = pa.schema([
        ("lang", pa.string()), *[(n, pa.int32()) for n in keys[1:]], ("source", pa.string()), ("items", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())),
    ])

    def run(batches):
        now, at = None, None

        def done():
            if now is not None:
                out = defaultdict(list)
                for row in now.rows(at[0] == 0):
                    for name, v in zip(schema.names, (*at[1:], *row)):
                        out[name].append(v)
                if out:
                    yield arrow_rows(out, schema)

        for batch in batches:
            for part, lang, a, b, side, no, term, p, source, kept in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, lang, a, b) != at:
                    yield from done()
                    at, now = (part, lang, a, b), Tile(a == b)
                if term:
                    now.add(term, side, no, p)
                else:
                    now.source(side, no, source, p, kept)
        yield from done()

    # a row per part, tile and left source; added up row by row
    sums = dealt.mapInArrow(run, "lang string, _a int, _b int, _way int, _i int, source string, items array<string>, sums array<long>")
    result = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def add(batches):
        at, items, total, source = None, None, None, None

        def done():
            if at is not None:
                out = [(i, v) for i, v in zip(items, total.tolist()) if i != source]
                if out:
                    yield arrow_rows({"lang": [at[0]] * len(out), "source": [source] * len(out), "item": [i for i, _ in out], "value": [v for _, v in out]}, result)

        for batch in batches:
            for *key, name, names, values in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    yield from done()
                    at, items, total, source = key, None, 0, name
                total, items = total + np.array(values, np.int64), items or names
        yield from done()

    met = sums.repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(add, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, slice_bytes: int = SLICE_BYTES, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the distance of a source's shares from those of each other
    source of its language, 0 where the language keeps no term. Part ``term``:
    the ``top`` terms that a source has more of than its language. A term is
    kept where ``min_docs`` rows of the language have it. Null texts have no
    terms; null languages and sources are those named ''. Repeated rows, null
    ids among them, count each. Ties are ranked by the item's UTF-8 bytes. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = prepare(docs.sparkSession)
    counts = cut_lineage(term_counts(docs, slice_bytes))
    kept = cut_lineage(counts.groupBy("lang", "term").agg(F.sum("n").alias("_in_lang"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= min_docs).drop("_docs"))
    has = cut_lineage(counts.drop("docs").join(kept, ["lang", "term"]))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    numbered = ordinal_in_group(docs.select(*group).distinct(), ["lang"], ["source"], "_no")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("_kept"), F.sum("_in_lang").alias("_lang_total"))
    sources = numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("_sources"))
    totals = has.groupBy("lang", "source").agg(F.sum("n").alias("_total"))
    groups = numbered.join(sources, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["_kept", "_lang_total", "_total"])
    none = F.lit(0).cast("long")
    groups = cut_lineage(groups.withColumn("_alone", F.when(F.col("_kept") > 0, share(none, F.col("_total"), F.col("_kept"))).otherwise(F.lit(1).cast("long"))))
    full = has.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("_total"), F.col("_kept")))
    full = cut_lineage(full.select("lang", "source", "term", "_no", "_sources", "p", share(F.col("_in_lang"), F.col("_lang_total"), F.col("_kept")).alias("q")))
    terms = full.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = pair_divergence(full, groups, parts, tile).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(best)
