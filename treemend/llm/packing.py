"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens; pieces go to
sequences. The instance is the histogram of piece lengths (at most
``capacity`` numbers, whatever the corpus), so the driver solves it whole:
sets that provably dominate every alternative are fixed first, the rest is
packed best fit, longest first, over groups of equal bins. Spark counts,
numbers pieces of one length without gathering them, and looks their places
up.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treemend.llm.common import arrow_rows, prepare
from treemend.session import cut_lineage

CAPACITY = 4096
END_ID = 1
# Bytes of words and of pre-tokens, with their ids, that one Python worker remembers, about; longer ones are not remembered.
CACHE_BYTES = 80_000_000
CACHE_CHARS = 64
# Letters whose normal form, lower case and class are the same everywhere; other words go through the whole tokenizer.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


class WordIds(dict):
    """Little-endian ids of white-space separated words; forgets all when full, and keeps no long word.

    The tokenizer never joins characters across a blank, so a text's ids are
    its words' ids one after another; and a word's are its pre-tokens'. Both
    are remembered, since most words of a corpus have been seen before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = models.BPE(model["vocab"], merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.parts: dict[str, bytes] = {}
        self.held = {"words": 0, "parts": 0}

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            ids = b"".join([self.parts.get(p) or self.part(p) for p in _PRE_TOKEN.findall(word.lower())])
        else:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self.keep("words", self, word, ids)
        return ids

    def keep(self, what: str, memory: dict, text: str, ids: bytes) -> None:
        if len(text) <= CACHE_CHARS:
            size = 180 + 4 * len(text) + len(ids)
            if self.held[what] + size > CACHE_BYTES:
                memory.clear()
                self.held[what] = 0
            memory[text] = ids
            self.held[what] += size

    def part(self, pre_token: str) -> bytes:
        spelt = pre_token if pre_token.isascii() else pre_token.translate(self.as_bytes)
        ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        self.keep("parts", self.parts, pre_token, ids)
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker, kept from task to task."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (_chunk, _rank): the task and the number among its pieces of that length."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = pa.schema([
        ("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_chunk", pa.int32()), ("_rank", pa.int64()),
    ])
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, seen, chunk = word_ids(tokenizer_path), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            out = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py() or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    for name, value in zip(schema.names, (doc, piece, at // 4, length, zlib.crc32(part), chunk, seen[length])):
                        out[name].append(value)
                    seen[length] += 1
            if out:
                yield arrow_rows(out, schema)

    types = f"doc_id {kind if kind in ('bigint', 'int') else 'string'}, piece int, start long, length long, ids_crc32 long, _chunk int, _rank long"
    source = docs.select(F.col("doc_id") if kind in ("bigint", "int") else F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return source.mapInArrow(run, types)


def _smallest(counts: np.ndarray, but: int, above: int = 0, most: int = 3) -> list[int]:
    """The smallest items longer than ``above``, one item of length ``but`` set aside."""
    got: list[int] = []
    for length in np.flatnonzero(counts[above + 1 :])[: most + 1] + above + 1:
        got += [int(length)] * min(most, int(counts[length]) - (length == but))
        if len(got) >= most:
            break
    return got[:most]


def _dominant(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with one item of length j that dominates every feasible set with it, or None if this test proves none."""
    small = _smallest(counts, j)
    if not small or j + small[0] > capacity:
        return (j,)
    rest = counts.copy()
    rest[j] -= 1
    fits = np.flatnonzero(rest[: capacity - j + 1])
    best = int(fits[-1])
    # the largest partner fills the bin, or no two items fit beside j
    if j + best == capacity or len(small) < 2 or j + small[0] + small[1] > capacity:
        return (j, best)
    if len(small) > 2 and j + sum(small) <= capacity:
        return None
    # at most two items fit beside j: the fullest pair, by each item's largest partner
    room = capacity - j
    pair = 0
    for x in fits[::-1]:
        y = np.flatnonzero(rest[: min(x, room - x) + 1]) if x < room else fits[:0]
        y = y[:-1] if len(y) and y[-1] == x and rest[x] < 2 else y
        if len(y):
            pair = max(pair, int(x + y[-1]))
    if best >= pair:
        return (j, best)
    rest[best] -= 1
    third = np.flatnonzero(rest[: room - best + 1])
    if not len(third):
        return None
    b = int(third[-1])
    longer = _smallest(counts, j, above=b, most=2)
    # any other pair has a shorter item of at most b, so {j, best, b} dominates it
    return (j, best, b) if len(longer) < 2 or j + sum(longer) > capacity else None


def dominance_reduction(counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict, int]], np.ndarray]:
    """Fixed bins as (items by length, how many such bins), and what is left of the counts.

    A proof for one item holds for as many copies as there are: taking items
    away never makes a dominated set feasible.
    """
    counts, fixed = counts.copy(), []
    for _ in range(8):
        before = len(fixed)
        for j in np.flatnonzero(counts)[::-1]:
            while counts[j]:
                found = _dominant(counts, int(j), capacity)
                if found is None:
                    break
                items: dict[int, int] = defaultdict(int)
                for x in found:
                    items[x] += 1
                many = min(int(counts[x]) // c for x, c in items.items())
                for x, c in items.items():
                    counts[x] -= many * c
                fixed.append((dict(items), many))
        if len(fixed) == before:
            break
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict, int]]:
    """Best fit, longest first, on groups of equal bins: a group splits at most once per length."""
    open_bins: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, items: dict, many: int) -> None:
        if many:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((items, many))

    for length in map(int, np.flatnonzero(counts)[::-1]):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                items, many = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, items, many = capacity, {}, -(-left // (capacity // length))
            each = room // length
            full = min(many, left // each)
            part = left - full * each if full < many else 0
            put(room - each * length, {**items, length: each}, full)
            if part:
                put(room - part * length, {**items, length: part}, 1)
            put(room, items, many - full - bool(part))
            left -= full * each + part
    return [g for groups in open_bins.values() for g in groups]


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Places by (length, number among equals): sorted range keys with first sequence, pieces per bin and offset."""
    fixed, left = dominance_reduction(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for items, many in fixed + best_fit(left, capacity):
        offset = 0
        for length, each in items.items():
            rows.append(((length << 44) + used[length], used[length], sequence, each, offset))
            used[length] += many * each
            offset += length * each
        sequence += many
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("key", "first", "sequence", "each", "offset"))}


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows and null ids are
    packed like any other row. An empty table gives no rows. Ties between equal
    lengths are settled by where their rows were read. Other columns of
    ``docs`` are not read.
    """
    spark = prepare(docs.sparkSession)
    pieces = cut_lineage(token_pieces(docs, tokenizer_path, capacity, end_id))
    per_chunk = pieces.groupBy("_chunk", "length").agg((F.max("_rank") + 1).alias("_n"))
    per_chunk = cut_lineage(per_chunk)
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_chunk.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = per_chunk.select("_chunk", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        p, length, number = plan.value, length.to_numpy(), number.to_numpy()
        at = np.searchsorted(p["key"], (length << 44) + number, "right") - 1
        nth = number - p["first"][at]
        return pd.DataFrame({"sequence_id": p["sequence"][at] + nth // p["each"][at], "offset": p["offset"][at] + nth % p["each"][at] * length})

    # the counts grow with the tasks: never broadcast
    placed = pieces.join(first.hint("merge"), ["_chunk", "length"]).withColumn("_at", place("length", F.col("_before") + F.col("_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
