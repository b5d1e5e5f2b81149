"""Substring dedup: words in windows that occur elsewhere are removed, found by FM-indexes.

A window's key is the least hash of its word groups, so equal windows have
equal keys. Consecutive windows with one key are a region; a region's windows
can only repeat in regions of the same key. Regions whose key occurs once are
done. The others go to shards by key; each shard builds a compressed FM-index
over its regions and streams them through backward search, which reports the
runs of windows that occur more than once. Keys with very many regions are
split further: there the unit is the single window, sent by the hash of its
words, and equal windows of a task travel as one with their number. An index
tells words apart as they are, not by hashes; windows of split keys are named
by 120 bits of two hashes.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import arrow_rows, pieces_of, prepare
from treemend.llm.fmindex import FMIndex
from treemend.session import cut_lineage

WINDOW = 35
GROUP = 8
# Windows of one region at most; longer runs of one key are several regions.
REGION = 64
# Regions of one key, about a million words, up to which one task indexes a key whole; beyond, windows are the unit.
HOT_REGIONS = 20_000
# Distinct windows of hot keys that a task holds before it sends them on.
HELD_WINDOWS = 40_000
# Words of one FM-index, about: what a task holds at a time.
SHARD_WORDS = 600_000
# Words whose hashes one Python worker remembers, none longer than this.
CACHE_WORDS = 300_000
CACHE_CHARS = 64


class WordHashes(dict):
    """XXH64 of words seen before; forgets all when full, and keeps no long word."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    m = len(h) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(31))


def window_keys(h: np.ndarray, window: int, group: int) -> np.ndarray:
    """The key of the window that starts at each word: the least hash of its word groups; and those hashes."""
    groups = least = _rolled(h, group)
    span, want = 1, window - group + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    return least, groups


def regions(h: np.ndarray, ends: np.ndarray, window: int, group: int) -> tuple[np.ndarray, ...]:
    """(text, start in the text, windows, key, twice) of the regions of texts that lie one after another and end at ``ends``.

    ``twice`` tells that the key's word group is there more than once, as it is where a region's own windows repeat.
    """
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.astype(np.uint64), none
    key, groups = window_keys(h, window, group)
    text = np.searchsorted(ends, np.arange(len(key)), "right")
    valid = np.arange(len(key)) + window <= ends[text]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])]
    at = np.arange(len(key))
    run = np.maximum.accumulate(np.where(fresh, at, 0))
    fresh |= (at - run) % REGION == 0
    fresh &= valid
    begin = np.flatnonzero(fresh)
    stop = np.flatnonzero(valid & np.r_[fresh[1:] | ~valid[1:], True])
    starts, n = np.r_[0, ends[:-1]], stop - begin + 1
    if not len(begin):
        return none, none, none, none.astype(np.uint64), none
    inside = n + window - group
    first = np.r_[0, np.cumsum(inside)[:-1]]
    same = groups[np.arange(inside.sum()) + np.repeat(begin - first, inside)] == np.repeat(key[begin], inside)
    twice = np.add.reduceat(same, first, dtype=np.int64) > 1
    return text[begin], begin - starts[text[begin]], n, key[begin], twice.astype(np.int64)


def _scan(docs: DataFrame, window: int, group: int) -> DataFrame:
    """doc_id, _k1, _k2 (the text's hashes), n_words, kept_sha256 of all words, and the text's regions: _at (start * 256 + twice * 128 + windows) and _key."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("bigint", "int"):
        docs, kind = docs.withColumn("doc_id", F.col("doc_id").cast("string")), "string"
    schema = pa.schema([
        ("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("_k1", pa.int64()), ("_k2", pa.int64()), ("n_words", pa.int64()),
        ("kept_sha256", pa.string()), ("_at", pa.list_(pa.int64())), ("_key", pa.list_(pa.int64())),
    ])

    def run(batches):
        import hashlib

        hashes = word_hashes()
        for batch in batches:
            ids, k1, k2, texts = (c.to_pylist() for c in batch.columns)
            for a, b in pieces_of(texts):
                out, flat, ends = defaultdict(list), [], []
                for i in range(a, b):
                    words = words_of(texts[i])
                    flat += map(hashes.__getitem__, words)
                    ends.append(len(flat))
                    row = (ids[i], k1[i], k2[i], len(words), hashlib.sha256(b" ".join(words)).hexdigest())
                    for name, value in zip(schema.names, row):
                        out[name].append(value)
                which, at, n, key, twice = regions(np.array(flat, np.uint64), np.array(ends), window, group)
                cut = np.searchsorted(which, np.arange(b - a + 1)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(cut, pa.array(v))
                arrays = [pa.array(out[f.name], f.type) for f in schema][:5] + [lists(at * 256 + twice * 128 + n), lists(key.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", *text_keys(text), text.alias("text"))
    return keyed.mapInArrow(run, f"doc_id {kind}, _k1 long, _k2 long, n_words long, kept_sha256 string, _at array<long>, _key array<long>")


def text_keys(text):
    return F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("_k2")


def _units(candidates: DataFrame, window: int) -> DataFrame:
    """_unit, _k1, _k2, _start, _n, _w, words of regions; of hot keys, windows: _k1 null, _start a second hash, _w their number in the task, as far as it holds them."""
    schema = pa.schema([(n, pa.int64()) for n in ("_unit", "_k1", "_k2", "_start", "_n", "_w")] + [("_words", pa.binary())])

    def run(batches):
        many: dict[bytes, int] = {}

        def held():
            out = defaultdict(list)
            for w, copies in many.items():
                for name, v in zip(schema.names, (_window_hash(w), None, None, _second_hash(w), 1, copies, w)):
                    out[name].append(v)
            many.clear()
            if out:
                yield arrow_rows(out, schema)

        for batch in batches:
            out = defaultdict(list)
            for row in batch.to_pylist():
                words = words_of(row["text"])
                if len(many) >= HELD_WINDOWS:
                    yield from held()
                for r in row["_regions"]:
                    start, n = r["at"] // 256, r["at"] % 128
                    if r["hot"]:
                        for s in range(start, start + n):
                            w = b" ".join(words[s : s + window])
                            many[w] = many.get(w, 0) + row["_copies"]
                    else:
                        value = (r["key"], row["_k1"], row["_k2"], start, n, row["_copies"], b" ".join(words[start : start + n + window - 1]))
                        for name, v in zip(schema.names, value):
                            out[name].append(v)
            if out:
                yield arrow_rows(out, schema)
        yield from held()

    return candidates.mapInArrow(run, "_unit long, _k1 long, _k2 long, _start long, _n long, _w long, _words binary")


def _window_hash(words: bytes) -> int:
    return int(np.array(xxhash.xxh64_intdigest(words, 3), np.uint64).astype(np.int64))


def _second_hash(words: bytes) -> int:
    """56 bits that the first hash does not tell."""
    return xxhash.xxh3_64_intdigest(words, 5) >> 8


def repeated_runs(units: list[dict], window: int) -> list[tuple[int, int, int]]:
    """(unit, first, last): runs of windows that occur more than once among the units, by one FM-index over the distinct ones."""
    distinct: dict[bytes, int] = {}
    which, weights = [], []
    for u in units:
        at = distinct.setdefault(u["_words"], len(distinct))
        if at == len(weights):
            weights.append(0)
        weights[at] += u["_w"]
        which.append(at)
    split = [w.split(b" ") for w in distinct]
    number: dict[bytes, int] = {}
    symbols = np.array([number.setdefault(x, len(number) + 1) for s in split for x in s], np.int64)
    index = FMIndex(symbols, np.array(list(map(len, split))), np.array(weights), REGION + window)
    runs = defaultdict(list)
    for s, a, b in zip(*(x.tolist() for x in index.repeated_windows(window))):
        runs[s].append((a, b))
    return [(i, a, b) for i, s in enumerate(which) for a, b in runs[s]]


def _search(units: DataFrame, window: int) -> DataFrame:
    """_unit, _k1, _k2, _from, _to: words of a text (end exclusive), or for windows of hot keys the window's two hashes in _unit and _from."""
    dealt = units.repartition("_unit").sortWithinPartitions("_unit")
    schema = pa.schema([(n, pa.int64()) for n in ("_unit", "_k1", "_k2", "_from", "_to")])

    def found(held: list[dict]):
        out = defaultdict(list)
        for i, a, b in repeated_runs(held, window):
            u = held[i]
            for name, v in zip(schema.names, (u["_unit"], u["_k1"], u["_k2"], u["_start"] + a, u["_start"] + b + window)):
                out[name].append(v)
        if out:
            yield arrow_rows(out, schema)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                # a shard ends between two keys
                if size >= SHARD_WORDS and row["_unit"] != last:
                    yield from found(held)
                    held, size = [], 0
                held.append(row)
                size += row["_n"] + window - 1
                last = row["_unit"]
        if held:
            yield from found(held)

    return dealt.mapInArrow(run, "_unit long, _k1 long, _k2 long, _from long, _to long")


def _hot_windows(candidates: DataFrame, window: int) -> DataFrame:
    """_unit, _second, _k1, _k2, _from of every window of hot keys."""
    schema = pa.schema([(n, pa.int64()) for n in ("_unit", "_second", "_k1", "_k2", "_from")])

    def run(batches):
        for batch in batches:
            out = defaultdict(list)
            for row in batch.to_pylist():
                words = words_of(row["text"])
                for r in (r for r in row["_regions"] if r["hot"]):
                    start, n = r["at"] // 256, r["at"] % 128
                    for s in range(start, start + n):
                        w = b" ".join(words[s : s + window])
                        for name, v in zip(schema.names, (_window_hash(w), _second_hash(w), row["_k1"], row["_k2"], s)):
                            out[name].append(v)
            if out:
                yield arrow_rows(out, schema)

    return candidates.mapInArrow(run, "_unit long, _second long, _k1 long, _k2 long, _from long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, hot: int = HOT_REGIONS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: each word in a window whose words also start anywhere else is removed.

    Windows are judged on the input; the same document counts as elsewhere.
    Null texts have no words; texts shorter than a window lose none. Copies of
    a text, repeated rows and rows with null ids among them, count each. No
    words left: the hash of the empty text. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    scan = cut_lineage(_scan(docs, window, group))
    places = scan.select("_k1", "_k2", F.explode(F.arrays_zip("_at", "_key")).alias("_r")).select("_k1", "_k2", "_r._at", "_r._key")
    shared = places.groupBy("_key").agg(F.sum(1 + F.shiftright("_at", 7).bitwiseAND(F.lit(1))).alias("_n")).where("_n > 1")
    # by text: which of its regions may repeat, how many copies it has, and one row to read it from
    texts = scan.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_copies"), F.min("doc_id").alias("_id"))
    may = places.join(shared, "_key").groupBy("_k1", "_k2").agg(
        F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_key").alias("key"), (F.col("_n") > hot).alias("hot"))).alias("_regions")
    )
    wanted = may.join(texts, ["_k1", "_k2"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select("doc_id", *text_keys(text), text.alias("text"))
    one = source.join(wanted, ["_k1", "_k2"]).where(F.col("doc_id").cast("string").eqNullSafe(F.col("_id").cast("string")))
    candidates = cut_lineage(one.select("_k1", "_k2", "text", "_regions", "_copies"))
    found = cut_lineage(_search(_units(candidates, window), window))
    spans = found.where("_k1 IS NOT NULL").select("_k1", "_k2", "_from", "_to")
    if shared.where(F.col("_n") > hot).limit(1).count():
        repeated = found.where("_k1 IS NULL").select("_unit", F.col("_from").alias("_second")).distinct()
        spans = spans.union(_hot_windows(candidates, window).join(repeated, ["_unit", "_second"]).select("_k1", "_k2", "_from", (F.col("_from") + window).alias("_to")))
    spans = spans.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_from", "_to")).alias("_spans"))
    schema = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("n_removed", pa.int64()), ("_sha", pa.string())])

    def cut(batches):
        import hashlib

        for batch in batches:
            out = defaultdict(list)
            for row in batch.to_pylist():
                words = words_of(row["text"])
                edge = np.zeros(len(words) + 1, np.int64)
                for s in row["_spans"]:
                    edge[s["_from"]] += 1
                    edge[s["_to"]] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                for name, v in zip(schema.names, (row["_k1"], row["_k2"], int(gone.sum()), hashlib.sha256(kept).hexdigest())):
                    out[name].append(v)
            if out:
                yield arrow_rows(out, schema)

    kept = candidates.select("_k1", "_k2", "text").join(spans, ["_k1", "_k2"]).mapInArrow(cut, "_k1 long, _k2 long, n_removed long, _sha string").distinct()
    return scan.select("doc_id", "_k1", "_k2", "n_words", "kept_sha256").join(kept, ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("_sha", "kept_sha256").alias("kept_sha256")
    )
