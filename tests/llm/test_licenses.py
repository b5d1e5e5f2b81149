import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import doc

from treemend.llm.licenses import COVERED, PHRASES, TEMPLATES, Automaton, Scanner, license_spans, words, words_of

TOY = (("x", "a b c d e f g h"), ("y", "c d e f p q r s t u"), ("y", "a b a b a b c"), ("z", "d e f g h a b c"))
TOY_PHRASES = {"a b": "ab", "b a b": "bab", "e f g": "efg", "q": "q"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def brute(text, templates, phrases, min_match=4, gap=8):
    """Every place of every phrase; matching statistics and chains by trying everything."""
    x = plain_words(text)
    places = [(i, label) for p, label in phrases.items() for q in [plain_words(p)] for i in range(len(x) - len(q) + 1) if x[i : i + len(q)] == q]
    texts = [plain_words(t) for _, t in templates] + [plain_words(p) for p in phrases]
    runs = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    longest = [max((n for n in range(1, i + 2) if tuple(x[i - n + 1 : i + 1]) in runs), default=0) for i in range(len(x))]
    best, labels = 0.0, {label for _, label in places}
    for (label, _), t in zip(templates, texts):
        ends = []
        for i, n in enumerate(longest):
            if n < min_match or (i + 1 < len(x) and longest[i + 1] == n + 1):
                continue
            for b in range(n, len(t) + 1):
                if t[b - n : b] == x[i - n + 1 : i + 1]:
                    ends.append((i + 1, b, n))
        worth = []
        for k, (e, b, n) in enumerate(ends):
            w = n
            for (e2, b2, _), w2 in zip(ends[:k], worth):
                if e2 < e and b2 < b and e2 >= e - n - gap and b2 >= b - n - gap:
                    w = max(w, w2 + n - max(0, e2 - (e - n), b2 - (b - n)))
            worth.append(w)
        share = max(worth, default=0) / len(t)
        best = max(best, share)
        if share >= COVERED:
            labels.add(label)
    starts = [i for i, _ in places]
    return (len(x), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places})),
            ",".join(sorted(labels)), 1.0 if places else min(1.0, best))


def scanned(scanner, text, size=1 << 20):
    f = scanner.read(words_of(text.encode(), size))
    labels = f["base_labels"] | {s[0] for s in f["spans"]}
    return (f["n_words"], f["n_base"], f["first_word"], f["last_word"], ",".join(sorted(f["base_labels"])), ",".join(sorted(labels)), 1.0 if f["n_base"] else min(1.0, f["best"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g h p q r s t u - zz A É".split()), max_size=60), st.integers(1, 40))
def test_scan_is_brute_force(tokens, size):
    text = " ".join(tokens)
    toy = Scanner(TOY, TOY_PHRASES)
    assert scanned(toy, text, size) == brute(text, TOY, TOY_PHRASES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a b c d e", "f g h", "c d e f", "p q r s", "t u", "x", "a b a b", "d e f g h a"]), max_size=25), st.randoms())
def test_pieces_of_templates_are_chained_as_by_brute_force(pieces, random):
    no_phrases = {"n o n e": "none"}
    assert scanned(Scanner(TOY, no_phrases), " ".join(pieces)) == brute(" ".join(pieces), TOY, no_phrases)


def test_automaton_knows_every_run_and_where_it_ends():
    rng = np.random.default_rng(1)
    texts = [tuple(bytes([97 + int(c)]) for c in rng.integers(0, 3, n)) for n in (12, 1, 20, 12)]
    a = Automaton([*texts, texts[0]])
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                want = {(k, e) for k, u in enumerate([*texts, texts[0]]) for e in range(j - i, len(u) + 1) if u[e - (j - i) : e] == t[i:j]}
                assert set(a.ends[a.state_of(t[i:j])]) == want


def test_whole_templates_earn_their_labels():
    scanner = Scanner(TEMPLATES, PHRASES)
    for label, text in TEMPLATES:
        f = scanner.read(words_of(f"some words before it. {text} And some after.".encode()))
        assert label in {s[0] for s in f["spans"]}
        own = max((s for s in f["spans"] if s[0] == label), key=lambda s: s[2] - s[1])
        assert own[1:3] == (4, 4 + len(words(text))) and own[3] == 1.0


def test_report(docs):
    texts = [
        None, "", "- . -", "CC BY-NC 4.0 and cc  by, cc\nby", "General Public License", "This is general. public license", "ALL rights RESERVEDé all rights reserved",
        "Released under the MIT licence", "Licensed under the Apache License, Version 2.0.", "the the the", "Permission is hereby granted, free of charge, to nobody",
        " ".join(["x"] * 50), "cc by " * 3,
    ]
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(3, texts[3]), doc(None, "cc by")]
    got = license_spans(docs(rows)).collect()
    want = [(r[0], *brute(r[1] or "", TEMPLATES, PHRASES)) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted(want, key=key)
    assert license_spans(docs([])).collect() == []


def test_long_texts_take_time_in_proportion():
    scanner, text = Scanner(TEMPLATES, PHRASES), (TEMPLATES[3][1] + " between two copies stand some words ") * 4_000
    began = time.time()
    f = scanner.read(words_of(text.encode()))
    assert time.time() - began < 20 and len([s for s in f["spans"] if s[0] == "mit"]) == 4_000
    assert scanner.read(words_of(("语" * 400_000).encode()))["n_words"] == 1
