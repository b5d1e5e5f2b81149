"""License scans by a generalised suffix automaton of licence words.

All templates and phrases are read into one automaton. A text streams through
it word by word: after each word the automaton knows the longest run of words
that ends there and stands in some template. Runs that cannot go on and have at
least ``MIN_MATCH`` words are matches. Matches that follow each other in text
and template, with small gaps in both, are chained; a chain that covers enough
of a template is a span with the template's label. Phrases that must stand
whole are read off the automaton's state at each word.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemend.llm.common import arrow_rows, prepare

# Phrases that count wherever their words stand one after another.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public licence texts: notices and the sentences by which they are known.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
)
# Words of a match at least; words that text or template may have between chained matches; share of a template that earns its label.
MIN_MATCH = 4
GAP = 8
COVERED = 0.6
# Bytes of a text that are split into words at a time.
WINDOW_BYTES = 1 << 20
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(raw: bytes, size: int = WINDOW_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, window by window: ASCII letters in lower case, digits, and whatever is not ASCII."""
    rest = b""
    for at in range(0, len(raw), size):
        block = rest + raw[at : at + size].translate(_WORD_BYTES)
        cut = block.rfind(b" ") + 1 if at + size < len(raw) else len(block)
        rest = block[cut:]
        yield block[:cut].split()


def words(text: str) -> tuple[bytes, ...]:
    return tuple(w for window in words_of(text.encode("utf-8", "surrogatepass")) for w in window)


class Automaton:
    """Generalised suffix automaton: states with next words, suffix links, and the length of their longest run."""

    def __init__(self, texts: list[tuple[bytes, ...]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
        # where the runs of a state end: (text, words up to there)
        ends: list[set] = [set() for _ in self.next]
        for t, text in enumerate(texts):
            at = 0
            for j, word in enumerate(text, 1):
                at = self.next[at][word]
                ends[at].add((t, j))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            ends[self.link[v]] |= ends[v]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _state(self, length: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state of p's runs and ``word``, cut off from the longer runs that share their ends."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, word)
        return new

    def state_of(self, run: tuple[bytes, ...]) -> int:
        at = 0
        for word in run:
            at = self.next[at][word]
        return at


class Scanner:
    """Templates and phrases in one automaton; reads texts."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: dict[str, str], min_match: int = MIN_MATCH, gap: int = GAP, covered: float = COVERED):
        self.min_match, self.gap, self.covered = min_match, gap, covered
        self.texts = [words(t) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.phrases = [(words(p), label) for p, label in phrases.items()]
        self.automaton = Automaton([*self.texts, *[p for p, _ in self.phrases]])
        # phrases that a state's runs end with, if long enough: its own and those of its shorter runs
        own = defaultdict(list)
        for run, label in self.phrases:
            own[self.automaton.state_of(run)].append((len(run), label))
        link = self.automaton.link
        self.marks: list[list] = [[] for _ in link]
        for v in sorted(range(1, len(link)), key=self.automaton.length.__getitem__):
            self.marks[v] = own[v] + self.marks[link[v]]

    def read(self, windows: Iterator[list[bytes]]) -> dict:
        """n_words, places of phrases, and spans of templates of one text."""
        after, link, length, marks, least = self.automaton.next, self.automaton.link, self.automaton.length, self.marks, self.min_match
        root, chains = after[0], Chains(self)
        state = run = n = n_base = 0
        first = last = None
        base_labels = set()
        for window in windows:
            for word in window:
                if not state:
                    state = root.get(word, 0)
                    run = 1 if state else 0
                else:
                    to = after[state].get(word)
                    if to is None:
                        if run >= least:
                            chains.add(n, run, state)
                        while to is None and state:
                            state = link[state]
                            run = length[state]
                            to = after[state].get(word)
                    state = to or 0
                    run = run + 1 if state else 0
                n += 1
                if state and marks[state]:
                    for size, label in marks[state]:
                        if run >= size:
                            n_base += 1
                            base_labels.add(label)
                            first = n - size if first is None else min(first, n - size)
                            last = n - size if last is None else max(last, n - size)
        if run >= least:
            chains.add(n, run, state)
        return {"n_words": n, "n_base": n_base, "first_word": first, "last_word": last, "base_labels": base_labels, "spans": chains.spans(), "best": chains.best}


class Chains:
    """Chains of matches, template by template, as they come in.

    A chain's worth is the number of the template's words that it covers. A
    match goes on the best chain that ends at most ``gap`` words before it in
    text and template; words that both cover count once.
    """

    def __init__(self, scanner: Scanner):
        self.scanner = scanner
        # per template: chain ends (text end, template end, words covered, text start) of the group that can still grow
        self.open: dict[int, list[tuple[int, int, int, int]]] = {}
        self.done: list[tuple[int, int, int, float]] = []
        self.best = 0.0

    def add(self, end: int, run: int, state: int) -> None:
        gap, texts = self.scanner.gap, self.scanner.texts
        for template, t_end in self.scanner.automaton.ends[state]:
            if template >= len(texts):
                continue
            group = self.open.setdefault(template, [])
            start, t_start = end - run, t_end - run
            if group and group[-1][0] < start - gap:
                self._close(template)
                group = self.open.setdefault(template, [])
            worth, begin = run, start
            for x_end, y_end, words_in, x_start in reversed(group):
                if x_end < start - gap:  # chains stand in the order of their ends
                    break
                if x_end < end and y_end < t_end and y_end >= t_start - gap:
                    both = words_in + run - max(0, x_end - start, y_end - t_start)
                    if both > worth:
                        worth, begin = both, x_start
            group.append((end, t_end, worth, begin))
            self.best = max(self.best, worth / len(texts[template]))

    def _close(self, template: int) -> None:
        """Spans of a group: the best chain first, then the best of those that do not overlap it."""
        taken: list[tuple[int, int]] = []
        size = len(self.scanner.texts[template])
        for end, _, worth, begin in sorted(self.open.pop(template), key=lambda g: (-g[2], g[0])):
            if worth < self.scanner.covered * size:
                break
            if all(end <= a or begin >= b for a, b in taken):
                taken.append((begin, end))
                self.done.append((begin, end, template, worth / size))

    def spans(self) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) by place."""
        for template in list(self.open):
            self._close(template)
        return [(self.scanner.labels[t], a, b, share) for a, b, t, share in sorted(self.done)]


@functools.lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple, min_match: int, gap: int, covered: float) -> Scanner:
    """One per Python worker, kept from task to task."""
    return Scanner(templates, dict(phrases), min_match, gap, covered)


def license_spans(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, gap: int = GAP, covered: float = COVERED) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts every place of every phrase, overlapping ones too;
    ``first_word`` and ``last_word`` are the smallest and largest start, null
    without a place. ``labels`` adds those of spans that cover ``covered`` of
    a template. The score is 1 where a phrase stands, else the largest share
    of any template that a chain covers; equal chains at one place: the first
    found. Null and empty texts have no words and score 0. Repeated rows and
    null ids give a row each; an empty table gives none. Other columns of
    ``docs`` are not read. No state outlives a text, and a text is read in
    windows.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    kind = kind if kind in ("bigint", "int") else "string"
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("upto", pa.int64()), ("covered", pa.float64())])
    longs = ("n_words", "n_base", "first_word", "last_word")
    schema = pa.schema([
        ("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), *[(n, pa.int64()) for n in longs],
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)),
    ])
    settings = (tuple(templates), tuple(phrases.items()), min_match, gap, covered)

    def run(batches):
        scanner = _scanner(*settings)
        for batch in batches:
            out = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = scanner.read(words_of(text.as_py() or b""))
                labels = found["base_labels"] | {s[0] for s in found["spans"]}
                out["doc_id"].append(doc)
                for name in longs:
                    out[name].append(found[name])
                out["base_labels"].append(",".join(sorted(found["base_labels"])))
                out["labels"].append(",".join(sorted(labels)))
                out["score"].append(1.0 if found["n_base"] else min(1.0, found["best"]))
                out["spans"].append([dict(zip(("label", "first", "upto", "covered"), s)) for s in found["spans"]])
            if out:
                yield arrow_rows(out, schema)

    types = f"doc_id {kind}, {', '.join(f'{n} long' for n in longs)}, base_labels string, labels string, score double, spans array<struct<label:string,first:long,upto:long,covered:double>>"
    return docs.select(F.col("doc_id").cast(kind), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, types)
