import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import doc

from treemend.llm import divergence as module
from treemend.llm.divergence import Pointers, divergence, multikey_quicksort, pair_sums, slice_counts, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs=3, top=200):
    rows = [((r[2] or ""), (r[3] or ""), plain_terms(r[1])) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in docs.items() if n >= min_docs}
        total = Counter(t for r in own for t in r[2] if t in kept)
        by = defaultdict(Counter)
        for _, s, terms in own:
            by[s].update(t for t in terms if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in by.items():
            pairs = [(sum(f(share(c, t), share(by[o], t)) for t in kept), o) for o in by if o != s]
            terms = [(f(share(c, t), share(total, t)), t) for t in c if share(c, t) > share(total, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def made(n, seed=5):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "naïve", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "日本", "É", "é", "x1y", "_", "9", "l" * 70 + "a", "l" * 70 + "b", "l" * 64]
    rows = []
    for i in range(n):
        text = None if i % 17 == 0 else " ".join(rng.choice(words, rng.integers(0, 12)))
        rows.append(doc(i, text, [None, "", "en", "en", "de"][rng.integers(0, 5)], [None, "", "a", "a", "b", "ü"][rng.integers(0, 6)]))
    return rows + [doc(None, "the the of", "en", "only"), doc(3, "zz", "xx", "a"), doc(3, "", "xx", "b"), doc(4, None, "yy", "c")] + rows[:5]


@pytest.mark.parametrize("slice_bytes,tile", [(16_000_000, 256), (60, 2), (1, 1)])
def test_divergence_is_brute_force(docs, monkeypatch, slice_bytes, tile):
    rows = made(150)
    got = divergence(docs(rows), top=4, slice_bytes=slice_bytes, tile=tile).collect()
    assert sorted(map(tuple, got)) == brute(rows, top=4)


def test_empty_table(docs):
    assert divergence(docs([])).collect() == []


def pointers(texts):
    data = [t.encode() for t in texts]
    return Pointers(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbé日 .Z\x00"), max_size=40), max_size=12), st.sampled_from([1, 4, 100, 1 << 15]), st.sampled_from([0, 8, 16, 64]))
def test_sort_of_pointers(texts, base, deep):
    old = module.BASE, module.DEEP
    module.BASE, module.DEEP = base, deep
    try:
        p = pointers(texts * 9)
        order, fresh = multikey_quicksort(p) if len(p.start) >= 1 else (np.zeros(0, int), np.zeros(0, bool))
    finally:
        module.BASE, module.DEEP = old
    terms = [p.rest(i, 0) for i in range(len(p.start))]
    assert terms == [t.encode() for x in texts * 9 for t in plain_terms(x)]
    assert order.tolist() == sorted(range(len(terms)), key=lambda i: (terms[i], i))
    ranked = [terms[i] for i in order]
    assert fresh.tolist() == [i == 0 or ranked[i] != ranked[i - 1] for i in range(len(ranked))]
    assert p.text.tolist() == [i for i, x in enumerate(texts * 9) for _ in plain_terms(x)]


def test_large_slices_part_around_pivots():
    rng = np.random.default_rng(2)
    words = np.array(["w" * int(n) + chr(97 + int(c)) for n, c in zip(rng.integers(0, 40, 300), rng.integers(0, 26, 300))])
    texts = [" ".join(rng.choice(words, 500)) for _ in range(200)]
    groups = [("en", f"s{i % 7}") for i in range(200)]
    out = slice_counts(groups, pa.array([t.encode() for t in texts], pa.large_binary()))
    got = {(s, t): (n, d) for s, t, n, d in zip(out["source"].to_pylist(), out["term"].to_pylist(), out["n"].tolist(), out["docs"].tolist())}
    n, d = Counter(), Counter()
    for (_, s), t in zip(groups, texts):
        n.update((s, w) for w in t.split())
        d.update((s, w) for w in set(t.split()))
    assert got == {k: (n[k], d[k]) for k in n}


def test_counts_of_long_texts(docs):
    long = "Straße " * 300_000 + "x" * 2_000_000
    got = {r["term"]: (r["n"], r["docs"]) for r in term_counts(docs([doc(1, long), doc(2, "straße")]), slice_bytes=1_000_000).collect()}
    assert got == {"straße": (300_001, 2), "x" * 2_000_000: (1, 1)}


def test_sums_over_terms_that_few_sources_have():
    rng = np.random.default_rng(8)
    alone = rng.integers(1, 50, 9)
    there = rng.random((40, 9)) < 0.2
    shares = np.where(there, rng.integers(1, 10**9, (40, 9)), alone)
    left, right = np.arange(4), np.arange(4, 9)
    want = [[sum(int(shares[t, g] - shares[t, s]) ** 2 // int(shares[t, s]) for t in range(40)) - 40 * int((alone[g] - alone[s]) ** 2 // alone[s]) for s in right] for g in left]
    assert pair_sums(shares, there, alone, left, right).tolist() == want
