"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Tokenizer A gives character offsets, tokenizer B spans of its proto (the
installed sentencepiece calls the immutable proto ``proto``). Where a span
ends at a whole character and the next begins there, it is a coarse cut;
between coarse cuts, in characters of several bytes and in byte-fallback
tokens, the tokens' decoded bytes settle the ends.

Neither tokenizer joins characters across one blank between two others, so a
text is aligned stretch by stretch and stretches met before are remembered.
So is a text with single line breaks between others, where no token of either
goes on before or after a line break: a stretch begins with the break then.
Marks at the end of a new stretch, such as a full stop, are aligned apart from
the letters or digits before them, which may have been met without.
Pairs are counted over the corpus by Spark. The most frequent pairs, a bounded
number, are looked up from a broadcast; the rest is joined, so neither a hot
pair nor a long list of rare ones meets in one task.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import operator
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched, chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import arrow_rows, pieces_of, prepare
from treemend.session import cut_lineage

# Most frequent pairs that are broadcast: 12 bytes each. Any other pair is joined.
FREQUENT_PAIRS = 1 << 18
# Bytes of remembered stretches per Python worker, about; longer stretches are not remembered.
CACHE_BYTES = 200_000_000
CACHE_CHARS = 64
# Characters of new stretches that go through the tokenizers at once; many at once leave the processor's caches.
ALIGNED_CHARS = 5_000
# Characters of a text aligned at a time.
WINDOW_CHARS = 1_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" (?:(?<=\s )|(?=\s|$))")
_ODD_BREAK = re.compile(r"(?<!\S)\n|\n(?!\S)")
_CUT_LINES = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
# Marks that A's pattern parts from letters and digits before them; an apostrophe may begin 's or 'll.
MARKS = r"""!"#$%&()*+,./:;<=>?@[\]^_`{|}~-"""
# Marks at an end that are remembered.
MOST_MARKS = 10_000
# What a stretch gives that a tokenizer does not give back byte by byte.
_FAULTY: tuple = ()


def byte_alphabet() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def token_ends(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: their spans' ends where those are coarse cuts, else the cut before and the decoded bytes since."""
    begin, end = spans.T
    coarse = (end > begin) & (np.r_[begin[1:], end[-1:]] == end)
    decoded = np.cumsum(sizes)
    before = np.maximum.accumulate(np.where(coarse, np.arange(len(end)), -1))
    since = np.where(before >= 0, end[before] - decoded[before], 0)
    return np.where(coarse, end, since + decoded)


class Aligner(dict):
    """Stretch of text -> (groups, packed pairs, tokens of A + tokens of B << 32), nothing of it where bytes differ."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.b_size = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b_size)
        ]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b_size)):
            raise ValueError("tokenizer B has pieces that go on after a blank")
        self.lines = not any(re.search(r"\S\n|\n\S", t.decode("utf-8", "replace")) for t in self.a_bytes + self.b_bytes)
        self.pair = np.dtype("<i4" if len(self.a_bytes) * self.b_size < 1 << 31 else "<i8")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, table)), np.int64) for table in (self.a_bytes, self.b_bytes))
        # ids as text: of A before another and last in a group, of B likewise
        self.texts = [f"{i}{end}" for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(table))]
        self.text_sizes = np.array(list(map(len, self.texts)), np.int64)
        special = set(self.a.get_added_tokens_decoder())
        tokens = [t for i, t in enumerate(self.a_bytes) if i not in special]
        tokens += [t for i, t in enumerate(self.b_bytes) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        # letters and digits that a token of either joins with a mark
        self.joined = {c for t in tokens for c in re.findall(rf"([^\W_])[{re.escape(MARKS)}]", t.decode("utf-8", "replace"))}
        self.marks: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.held = 0

    def align(self, stretches: list[str], between: str = " ") -> list[tuple]:
        """Stretches one after another, a blank before each, as both tokenizers see them; or a line break, after a first that is left out."""
        lead = between != " "
        if lead:
            stretches = ["x", *stretches]
        text = between.join(stretches)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        encoding, proto = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text, return_type="proto")
        # an attribute of a message is dear: each is read once
        a_ids, pieces = encoding.ids, list(proto.pieces)
        b_ids = [p.id for p in pieces]
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            # one stretch is at fault, if there are several: the others count
            stretches = stretches[lead:]
            return [_FAULTY] if len(stretches) == 1 else [e for s in stretches for e in self.align([s], between)]
        a_spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        b_spans = np.array([[p.begin for p in pieces], [p.end for p in pieces]], np.int64).T + 1
        points = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.r_[0, np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))]  # from characters to bytes
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        _, a_cut, b_cut = np.intersect1d(token_ends(at[a_spans], self.a_sizes[a]), token_ends(b_spans, self.b_sizes[b]), assume_unique=True, return_indices=True)
        pairs = (a[a_cut] * self.b_size + b[b_cut]).astype(self.pair).tobytes()
        a_from, b_from = np.r_[0, a_cut + 1], np.r_[0, b_cut + 1]
        # the groups' tokens one after another, A's and then B's, with what follows each: the texts of all groups in a row
        flat = np.empty(len(a) + len(b), np.int64)
        flat[np.arange(len(a)) + np.repeat(b_from[:-1], np.diff(a_from))] = a
        flat[np.arange(len(b)) + np.repeat(a_from[1:], np.diff(b_from))] = b + 2 * len(self.a_bytes)
        flat[a_cut + b_from[:-1]] += len(self.a_bytes)
        flat[b_cut + a_from[1:]] += self.b_size
        texts = "".join(map(self.texts.__getitem__, flat.tolist()))
        starts = np.r_[0, np.cumsum(self.text_sizes[flat])]
        # a stretch ends where the tokens of both have its last byte
        last = at[np.cumsum([len(s) + 1 for s in stretches])]
        stops = np.r_[0, np.searchsorted(np.cumsum(self.a_sizes[a])[a_cut], last) + 1]
        tokens = np.diff(a_from[stops]) + (np.diff(b_from[stops]) << 32)
        ends, bytes_at = starts[a_from[stops] + b_from[stops]].tolist(), (stops * self.pair.itemsize).tolist()
        return [(texts[f : t - 1], pairs[g:h], n) for f, t, g, h, n in zip(ends, ends[1:], bytes_at, bytes_at[1:], tokens.tolist())][lead:]

    def remember(self, keys: list[str], entries: list[tuple]) -> None:
        """Keep the short ones. Where half the memory is full, what was kept before and is not met again is forgotten."""
        if keys and max(map(len, keys)) > CACHE_CHARS:
            short = [len(t) <= CACHE_CHARS for t in keys]
            keys, entries = list(compress(keys, short)), list(compress(entries, short))
        # pairs take less than the groups' text
        size = 350 * len(keys) + 2 * sum(map(len, keys)) + 2 * sum(map(len, [e[0] for e in entries if e]))
        if self.held + size > CACHE_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        if size <= CACHE_BYTES // 2:
            self.update(zip(keys, entries))
            self.held += size

    def learn(self, stretches: set) -> dict[str, tuple]:
        """Entries of stretches that are not at hand: met longer ago, or aligned, some thousand characters at a time; the short ones are remembered."""
        out = {s: e for s in stretches if (e := self.older.get(s)) is not None} if self.older else {}
        self.remember(list(out), list(out.values()))
        new, cut = set(), {}
        for s in stretches.difference(out):
            if s.__class__ is tuple:
                out[s] = self.align(list(s))[0]
            elif s.isalnum():
                new.add(s)
            # blanks at an end would run together with those between stretches, and B reads a low line as a blank
            elif not s or "▁" in s or s[s[0] == "\n" :] != s.strip():
                out[s] = self.align([s[1:]], "\n")[0] if s[:1] == "\n" else self.align([s])[0]
                self.remember([s], [out[s]])
            else:
                head = s.rstrip(MARKS)
                if head and head != s and head[-1].isalnum() and head[-1] not in self.joined:
                    cut[s] = head
                else:
                    new.add(s)
        heads = {}
        for head in set(cut.values()) - new:
            entry = self.get(head) or out.get(head) or self.older.get(head)
            if entry:
                heads[head] = entry
            else:
                new.add(head)
        plain, lines = [s for s in new if s[0] != "\n"], [s for s in new if s[0] == "\n"]
        for some, between in ((plain, " "), (lines, "\n")):
            for a, b in pieces_of(some, ALIGNED_CHARS):
                entries = self.align(some[a:b] if between == " " else [s[1:] for s in some[a:b]], between)
                out.update(zip(some[a:b], entries))
                self.remember(some[a:b], entries)
        marks = self.marks_after({s[len(head) :] for s, head in cut.items()})
        for some in batched(cut.items(), 1000):
            entries = []
            for s, head in some:
                e, f = heads.get(head) or out[head], marks[s[len(head) :]]
                entries.append((e[0] + ";" + f[0], e[1] + f[1], e[2] + f[2]) if e and f else _FAULTY)
            some = [s for s, _ in some]
            out.update(zip(some, entries))
            self.remember(some, entries)
        return out

    def marks_after(self, ends: set[str]) -> dict[str, tuple]:
        """Entries of marks after a letter: what they add to it."""
        out = {m: e for m in ends if (e := self.marks.get(m))}
        for some in batched(ends.difference(out), 500):
            x, *entries = self.align(["x", *["x" + m for m in some]])
            out.update((m, (e[0][len(x[0]) + 1 :], e[1][len(x[1]) :], e[2] - x[2]) if x and e else _FAULTY) for m, e in zip(some, entries))
        if len(self.marks) > MOST_MARKS:
            self.marks.clear()
        self.marks.update((m, e) for m, e in islice(out.items(), MOST_MARKS) if len(m) <= CACHE_CHARS)
        return out


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, kept from task to task."""
    return Aligner(a_path, b_path)


def windows(text: str, most: int = WINDOW_CHARS) -> Iterator[str]:
    """The text in parts of ``most`` characters and up to the next single blank between others, without these blanks."""
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def stretches_of(text: str, lines: bool = True) -> list:
    """The text cut at single blanks between other characters, and before single line breaks if ``lines``; a break at its beginning is no such cut."""
    odd = text[0] == " " or _ODD.search(text)
    if not lines or "\n" not in text:
        found = _CUT.split(text) if odd else text.split(" ")
    elif odd or _ODD_BREAK.search(text):
        found = _CUT_LINES.split(text)
    else:
        return text.replace("\n", " \n").split(" ")
    return [(found[0],), *found[1:]] if text[0] == "\n" else found


def align_text(known: Aligner, parts: Iterator[list[str]], fresh: dict, met: list[tuple] | None = None) -> tuple:
    """(tokens of A, tokens of B, groups, links, sha256 of the groups, distinct pairs, how often each) of a text, its stretches window by window.

    ``met`` has the only window's entries as far as they were remembered.
    """
    digest, counts, totals = hashlib.sha256(), [], 0
    for n, stretches in enumerate(parts):
        entries = list(map(known.get, stretches)) if met is None else met
        if not all(entries):
            entries = [fresh.get(s) if e is None else e for s, e in zip(stretches, entries)]
        if None in entries:
            new = known.learn({s for s, e in zip(stretches, entries) if e is None})
            entries = [new[s] if e is None else e for s, e in zip(stretches, entries)]
        if not all(entries):  # a faulty one
            counts = []
            break
        digest.update((";" if n else "").encode() + ";".join([e[0] for e in entries]).encode())
        totals += sum([e[2] for e in entries])
        counts.append(np.unique(np.frombuffer(b"".join([e[1] for e in entries]), known.pair), return_counts=True))
    if not counts:
        none = np.zeros(0, known.pair)
        return 0, 0, 0, 0, "", none, none.astype(np.int64)
    pairs, which = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    times = np.bincount(which, np.concatenate([c for _, c in counts])).astype(np.int64)
    links = int(times.sum())
    return totals & 0xFFFFFFFF, totals >> 32, links, links, digest.hexdigest(), pairs, times


def align_batch(known: Aligner, cut: list) -> list[tuple]:
    """align_text of texts; what texts of one window have new is learned together."""
    # some hundred thousand small tuples without cycles, which the collector would visit again and again
    collects = gc.isenabled()
    gc.disable()
    try:
        met = [list(map(known.get, parts[0])) if isinstance(parts, list) else None for parts in cut]
        fresh = known.learn({s for parts, entries in zip(cut, met) if entries for s in compress(parts[0], map(operator.not_, entries))}.difference(known))
        return [align_text(known, parts, fresh, entries) for parts, entries in zip(cut, met)]
    finally:
        if collects:
            gc.enable()


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links as _pairs (id of A * size of B + id of B) with _times."""
    kind = dict(docs.dtypes)["doc_id"]
    kind = kind if kind in ("bigint", "int") else "string"
    source = docs.select(F.col("doc_id").cast(kind), F.col("text").cast("string"))
    key = pa.int32() if aligner(a_path, b_path).pair.itemsize == 4 else pa.int64()
    schema = pa.schema([
        ("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.string()), ("_pairs", pa.list_(key)), ("_times", pa.list_(pa.int64())),
    ])

    def run(batches):
        known = aligner(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces_of(texts):
                # stretches that the shorter texts of a batch share are aligned once; a long text is cut window by window
                cut = [[stretches_of(t, known.lines)] if t and len(t) <= WINDOW_CHARS else (stretches_of(w, known.lines) for w in windows(t)) if t else () for t in texts[a:b]]
                rows = [(i, *row) for i, row in zip(ids[a:b], align_batch(known, cut))]
                out = dict(zip(schema.names, zip(*rows)))
                yield arrow_rows(out, schema)

    types = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<{'int' if key == pa.int32() else 'long'}>, _times array<long>"
    return source.mapInArrow(run, types)


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and their counts: all pairs from a count on, as low as leaves at most ``most`` of them."""
    octave = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in counts.groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect():  # some hundred rows
        if total + r["count"] > most:
            break
        least, total = r["o"], total + r["count"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(octave >= least).select("pair", "n").toArrow()
    pairs, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    by = np.argsort(pairs)
    return pairs[by], n[by]


def alignment_report(docs: DataFrame, a_path: str, b_path: str, most: int = FREQUENT_PAIRS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers read a blank and the text. Groups end where a token of
    each ends; the two tokens that end there are a link, so groups and links
    are equally many. A pair's count is how many links of all rows hold it;
    n_best counts the links whose count is the highest of their id of B, ties
    included. Null and empty texts, and texts that a tokenizer does not give
    back byte by byte, have no tokens: zeros and ''. Repeated rows and null
    ids count like any other row. An empty table gives no rows. Other columns
    of ``docs`` are not read. A stretch without a single blank, however long,
    is encoded at once.
    """
    spark = prepare(docs.sparkSession)
    rows = cut_lineage(aligned(docs, a_path, b_path)).withColumn("_row", F.monotonically_increasing_id())
    b_size = aligner(a_path, b_path).b_size
    links = rows.select(F.explode(F.arrays_zip("_pairs", "_times")).alias("l")).select(F.col("l._pairs").cast("long").alias("pair"), F.col("l._times").alias("times"))
    counts = cut_lineage(links.groupBy("pair").agg(F.sum("times").alias("n")))
    best = np.zeros(b_size, np.int64)
    for r in counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("n")).toLocalIterator():  # a row per id of B at most
        best[r["b"]] = r["n"]
    shared = spark.sparkContext.broadcast((*frequent(counts, most), best))
    schema = pa.schema([("_row", pa.int64()), ("_best", pa.int64()), ("_sum", pa.int64()), ("_rare", pa.list_(pa.int64())), ("_rare_times", pa.list_(pa.int64()))])

    def look_up(batches):
        pairs, n, most_of = shared.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy().astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            keys = lists.flatten().to_numpy().astype(np.int64)
            count = np.zeros(len(keys), np.int64)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                count = np.where(pairs[at] == keys, n[at], 0)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, row, count * times)
            np.add.at(bests, row, np.where((count > 0) & (count == most_of[keys % b_size]), times, 0))
            rare = count == 0
            cut = np.r_[0, np.cumsum(np.bincount(row[rare], minlength=len(sizes)))].astype(np.int32)
            lists_of = lambda v: pa.ListArray.from_arrays(cut, pa.array(v[rare]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bests), pa.array(sums), lists_of(keys), lists_of(times)], schema=schema)

    found = cut_lineage(rows.select("_row", "_pairs", "_times").mapInArrow(look_up, "_row long, _best long, _sum long, _rare array<long>, _rare_times array<long>"))
    rare = found.select("_row", F.explode(F.arrays_zip("_rare", "_rare_times")).alias("l")).select("_row", F.col("l._rare").alias("pair"), F.col("l._rare_times").alias("times"))
    high = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("high"))
    joined = rare.join(counts.withColumn("b", F.col("pair") % b_size).join(high, "b"), "pair")
    more = joined.groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("_sum2"), F.sum(F.when(F.col("n") == F.col("high"), F.col("times")).otherwise(0)).alias("_best2"))
    totals = found.select("_row", "_best", "_sum").join(more, "_row", "left")
    return rows.drop("_pairs", "_times").join(totals, "_row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("_best") + F.coalesce("_best2", F.lit(0))).alias("n_best"), (F.col("_sum") + F.coalesce("_sum2", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
