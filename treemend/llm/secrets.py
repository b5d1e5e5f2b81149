"""Secret scans in SQL expressions.

Base patterns give spans; strings that look random add more: Shannon entropy
in a sliding window, by character class, with counts updated character by
character; long strings and many matches are walked in parts, so that a text's
time grows with its length. Base spans and allow-listed pieces are cut out of a string, and what
is left between them is scored piece by piece; strings and pieces that are
harmless as a whole add nothing.
A span's place comes from the texts between matches: split() and
regexp_extract_all() walk the same matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import prepare

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# Runs of 32 and more are the same matches as all runs, the short ones dropped.
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_SECRET, MIN_ACCESS = 8, 16

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Character class -> (what the whole string consists of, least entropy of a window in bits).
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", 2.9),
    "upper": (r"^[A-Z0-9_=-]+$", 3.3),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.7),
}
# Strings that are no secrets as a whole: no digit or no letter, UUIDs.
HARMLESS = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
# Pieces that are no secrets: alphabets and placeholders, one character over and over. What stands around them is scored.
ALLOW_LIST = (r"(?i)abcdefgh|01234567|12345678|example|sample|dummy|placeholder|changeme|lorem", r"(.)\1{7,}")
REPLACEMENT = "[secret]"


# Elements of an array that are walked at a time, and window starts of a string: what a step copies stays as small.
CHUNK = 256
STRETCH = 16384


def _bound(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    none = F.slice(F.array(items), 1, 0)
    parts = F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(items) > 0, parts).otherwise(none)


def _walk(items: Column, start: Column, step, kind: str) -> Column:
    """What ``step(position, item)`` -> (next position, output or null) gives for the items in order, without the nulls.

    Outputs are collected chunk by chunk: an output is copied some hundred
    times, not once for each that follows.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, item: Column) -> Column:
        position, out = step(a["p"], item)
        return F.struct(position.alias("p"), F.when(out.isNotNull(), F.array_append(a["o"], out)).otherwise(a["o"]).alias("o"))

    def chunk(a: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(a["p"].alias("p"), none.alias("o")), one)
        return _bound(inner, lambda r: F.struct(r["p"].alias("p"), F.array_append(a["o"], r["o"]).alias("o")))

    return F.aggregate(_chunks(items), F.struct(start.alias("p"), F.array().cast(f"array<array<{kind}>>").alias("o")), chunk, lambda a: F.flatten(a["o"]))


_MATCH = "struct<s:int,e:int,m:string>"
_PIECE = "struct<s:int,m:string>"


def _found(df: DataFrame, pattern: str, out: str, text: str = "_text") -> DataFrame:
    """Add array<struct<s, e, m>>: start, end and text of each leftmost non-overlapping match."""
    df = df.withColumn("_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)))

    def step(p: Column, x: Column):
        start = p + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        return end, F.when(x["m"].isNotNull(), F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))

    parts = F.arrays_zip(F.col("_g").alias("g"), F.col("_m").alias("m"))
    walked = _walk(F.col("_parts"), F.lit(0), step, _MATCH)
    df = df.withColumn("_parts", F.when(F.size("_m") > 0, parts))
    return df.withColumn(out, F.when(F.size("_m") > 0, walked).otherwise(F.array().cast(f"array<{_MATCH}>"))).drop("_m", "_g", "_parts")


def _least_entropy(candidate: Column) -> Column:
    """The class's least entropy; the narrowest class that holds the whole string counts."""
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(least)
    return least


# Counts of a window's characters stand in whole numbers, 5 bits each: a window has at most 20 of one.
_BITS, _PER_LONG, _FIRST = 5, 12, ord("+")
_LONGS = (ord("z") - _FIRST) // _PER_LONG + 1


def _hot_stretch(candidate: Column, bits: Column) -> Column:
    """struct<lo, hi>: first and last end (1-based) of a window with at least that entropy; lo 0 if there is none.

    One fold over the characters, each entering the window as another leaves
    it. The state holds the counts and the sum of c * log2(c), which a step
    changes by one term for either character; the entropy of a full window is
    log2(W) - sum / W. A long string is folded stretch by stretch, which
    overlap by less than a window.
    """
    w = WINDOW
    terms = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(w + 2)])
    code = lambda chars, i: F.ascii(F.get(chars, i - 1)) - _FIRST

    def fold(chars: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            return _bound(F.struct(code(chars, i).alias("e"), F.when(i > w, code(chars, i - w)).alias("l")), lambda x: moved(a, i, x["e"], x["l"]))

        def count(a: Column, c: Column) -> Column:
            word = F.lit(0).cast("long")
            for k in reversed(range(_LONGS)):
                word = F.when(c < (k + 1) * _PER_LONG, a[f"c{k}"]).otherwise(word)
            return F.call_function("shiftright", word, c % _PER_LONG * _BITS).bitwiseAND(F.lit(31)).cast("int")

        def moved(a: Column, i: Column, enters: Column, leaves: Column) -> Column:
            before = F.struct(count(a, enters).alias("e"), F.when(leaves.isNotNull(), count(a, leaves) + (leaves == enters).cast("int")).alias("l"))
            one = lambda c, k: F.when(F.floor(c / _PER_LONG) == k, F.call_function("shiftleft", F.lit(1).cast("long"), c % _PER_LONG * _BITS)).otherwise(F.lit(0).cast("long"))
            words = [(a[f"c{k}"] + one(enters, k) - one(leaves, k)).alias(f"c{k}") for k in range(_LONGS)]

            def counted(n: Column) -> Column:
                total = a["t"] + F.get(terms, n["e"] + 1) - F.get(terms, n["e"]) + F.when(n["l"].isNotNull(), F.get(terms, n["l"] - 1) - F.get(terms, n["l"])).otherwise(0.0)
                return F.struct(total.alias("t"), ((i >= w) & (F.lit(math.log2(w)) - total / w >= bits)).alias("hot"))

            return _bound(_bound(before, counted), lambda r: F.struct(
                *words, r["t"].alias("t"), F.when(r["hot"] & (a["lo"] == 0), i).otherwise(a["lo"]).alias("lo"), F.when(r["hot"], i).otherwise(a["hi"]).alias("hi"),
            ))

        start = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(_LONGS)], F.lit(0.0).alias("t"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))

    last = ((F.length(candidate) - w) / STRETCH).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: _bound(
        _bound(F.split(F.substr(candidate, k * STRETCH + 1, F.lit(STRETCH + w - 1)), ""), fold),
        lambda h: F.struct(F.when(h["lo"] > 0, h["lo"] + k * STRETCH).alias("lo"), F.when(h["lo"] > 0, h["hi"] + k * STRETCH).alias("hi")),
    ))
    return _bound(parts, lambda p: F.struct(
        F.coalesce(F.array_min(F.transform(p, lambda h: h["lo"])), F.lit(0)).alias("lo"), F.coalesce(F.array_max(F.transform(p, lambda h: h["hi"])), F.lit(0)).alias("hi"),
    ))


def _outside(candidate: Column, spans: Column) -> Column:
    """array<struct<s, m>>: the candidate's pieces of ``WINDOW`` characters or more outside the sorted spans, each with its start."""

    def step(p: Column, b: Column):
        piece = F.struct(p.alias("s"), F.substr(candidate["m"], p - candidate["s"] + 1, b["s"] - p).alias("m"))
        return F.greatest(p, b["e"]), F.when(b["s"] - p >= WINDOW, piece)

    end = F.array(F.struct(candidate["e"].alias("s"), candidate["e"].alias("e")))
    cuts = F.transform(F.filter(spans, lambda b: (b["s"] < candidate["e"]) & (candidate["s"] < b["e"])), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))
    return _bound(F.concat(cuts, end), lambda c: _walk(c, candidate["s"], step, _PIECE))


def _all_outside(candidates: Column, spans: Column) -> Column:
    """The pieces of all candidates, in order; each chunk of them is held against the spans that reach into it."""

    def part(chunk: Column) -> Column:
        low, high = F.element_at(chunk, 1)["s"], F.element_at(chunk, -1)["e"]
        near = F.filter(spans, lambda b: (b["s"] < high) & (low < b["e"]))
        return _bound(near, lambda n: F.flatten(F.transform(chunk, lambda x: _outside(x, n))))

    return F.flatten(F.transform(_chunks(candidates), part))


def _without(piece: Column, pattern: str) -> Column:
    """array<struct<s, m>>: what the pattern's matches leave of a piece, from ``WINDOW`` characters on."""

    def step(p: Column, part: Column):
        left = part["left"]
        return p + F.length(left) + F.coalesce(F.length(part["match"]), F.lit(0)), F.when(F.length(left) >= WINDOW, F.struct(p.alias("s"), left.alias("m")))

    parts = F.arrays_zip(F.split(piece["m"], pattern, -1).alias("left"), F.regexp_extract_all(piece["m"], F.lit(pattern), F.lit(0)).alias("match"))
    return _bound(parts, lambda z: _walk(z, piece["s"], step, _PIECE))


def _harmless(text: Column) -> Column:
    return F.greatest(*[text.rlike(p) for p in HARMLESS])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, with ``base`` and ``spans``: sorted array<struct<s, k, e>>.

    s and e are code points (end exclusive), k the position in ``KINDS``. Null
    texts are empty and, like texts without a match, give empty arrays. Rows
    are judged one by one, so repeated rows and null ids need no rule.
    """
    prepare(docs.sparkSession)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = _found(_found(_found(_found(df, ASSIGN, "_assign"), ACCESS, "_access"), HEX, "_hex"), CANDIDATE, "_try")
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    df = df.select(
        "row", "_try",
        F.array_sort(F.concat(
            F.transform(F.filter("_assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= MIN_SECRET), span(0)),
            F.transform(F.filter("_access", lambda x: F.length(x["m"]) >= MIN_ACCESS), span(1)),
            F.transform("_hex", span(2)),
        )).alias("base"),
    )
    df = df.withColumn("_try", F.filter("_try", lambda x: ~_harmless(x["m"])))
    df = df.withColumn("_try", _all_outside(F.col("_try"), F.col("base")))
    for pattern in ALLOW_LIST:
        df = df.withColumn("_try", F.flatten(F.transform("_try", lambda x: _without(x, pattern))))  # noqa: B023
    suspect = F.filter("_try", lambda x: ~_harmless(x["m"]))
    df = df.withColumn("_try", F.transform(suspect, lambda x: F.struct(x["s"].alias("s"), _bound(_least_entropy(x["m"]), lambda bits: _hot_stretch(x["m"], bits)).alias("h"))))
    more = F.transform(
        F.filter("_try", lambda x: x["h"]["lo"] > 0),
        lambda x: F.struct((x["s"] + x["h"]["lo"] - WINDOW).alias("s"), F.lit(3).alias("k"), (x["s"] + x["h"]["hi"]).alias("e")),
    )
    return df.select("row", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scan_secrets(docs).select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with each stretch of spans replaced; n_chars follows the text where the table has it."""
    df = scan_secrets(docs).withColumn("_text", F.col("row.text"))
    # walk the spans by start: copy what lies before one, then the replacement, unless the stretch goes on
    last = F.struct(F.length("_text").alias("s"), F.lit(None).cast("int").alias("e"))
    stops = F.concat(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.array(last))

    def copied(p: Column, x: Column, text: Column, offset: Column):
        before = F.substr(text, p - offset + 1, x["s"] - p)
        return F.greatest(p, F.coalesce(x["e"], x["s"])), F.when(x["s"] >= p, F.when(x["e"].isNull(), before).otherwise(F.concat(before, F.lit(REPLACEMENT))))

    def chunk(a: Column, part: Column) -> Column:
        # the text from here to the chunk's end: what its steps look for is near
        end = F.array_max(F.transform(part, lambda x: F.coalesce(x["e"], x["s"])))
        inner = lambda text: F.aggregate(
            part, F.struct(a["p"].alias("p"), F.array().cast("array<string>").alias("o")),
            lambda b, x: _bound(F.struct(*[c.alias(n) for n, c in zip("po", copied(b["p"], x, text, a["p"]))]), lambda r: F.struct(
                r["p"].alias("p"), F.when(r["o"].isNotNull(), F.array_append(b["o"], r["o"])).otherwise(b["o"]).alias("o"))),
        )
        return _bound(_bound(F.substr(F.col("_text"), a["p"] + 1, F.greatest(end - a["p"], F.lit(0))), inner), lambda r: F.struct(
            r["p"].alias("p"), F.array_append(a["o"], F.array_join(r["o"], "")).alias("o")))

    walk = F.aggregate(_chunks(stops), F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("o")), chunk, lambda a: F.array_join(a["o"], ""))
    df = df.withColumn("_text", F.when(F.size("spans") > 0, walk).otherwise(F.col("_text")))
    changed = {"text": F.col("_text"), "n_chars": F.when(F.size("spans") > 0, F.length("_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return df.select(*[changed[c].cast(t).alias(c) if c in changed else F.col(f"row.`{c}`") for c, t in docs.dtypes])
