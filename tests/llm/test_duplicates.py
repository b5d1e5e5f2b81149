import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_rows import doc

from treemend.llm.components import components
from treemend.llm.fmindex import FMIndex
from treemend.llm.simhash import bit_groups, drop_near_duplicates, fingerprint, links, near_duplicates, tile_links
from treemend.llm.substrings import remove_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", "  \t", "One", "one two three", "A b\x0bC  d É é E", "x y " * 300, "a\x85b\xa0c d e f g"):
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [0, 1, 1000, 10**6, 10**9, 10**12, 10**15])
def test_some_group_of_bits_agrees(n):
    masks = bit_groups(n)
    rng = np.random.default_rng(1)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    values = np.unique(np.concatenate([seeds ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4)))) for _ in range(30)]))
    values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    every = [(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ a) <= 4]]
    u, v = tile_links(values, 4)
    nodes = list(map(int, values))
    assert len(u) < len(nodes) and roots(every, nodes) == roots(list(zip(u.tolist(), v.tolist())), nodes)


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_in_short_and_long_stretches(spark, monkeypatch, tile):
    """With tiles of 8 every stretch is dealt out as tile pairs."""
    monkeypatch.setattr("treemend.llm.simhash.TILE", tile)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 62, 6).astype(np.uint64)
    values = np.unique(np.concatenate([seeds ^ np.uint64(sum(1 << int(b) for b in rng.choice(62, 5))) for _ in range(25)] + [seeds]))
    nodes = values.astype(np.int64).tolist()
    every = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if bin(a ^ b).count("1") <= 4]
    got = [(r["u"], r["v"]) for r in links(spark.createDataFrame([(x,) for x in nodes], "_fp long")).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in got)
    assert roots(every, nodes) == roots(got, nodes)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(1000, 1100)] + [(5, 5), (9, 8), (8, 9), (-3, 8)] + rng.integers(2000, 2200, (150, 2)).tolist()
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([tuple(map(int, p)) for p in pairs], "u long, v long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == roots([p for p in pairs if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


BASE = " ".join(f"w{i}" for i in range(400))


def near_rows():
    return [
        doc(10, BASE), doc(4, BASE.replace("w7 ", "changed ")), doc(3, BASE.upper()), doc(8, "something else entirely here now"),
        doc(9, None), doc(2, ""), doc(11, " \n"), doc(None, BASE), doc(8, "something else entirely here now"), doc(12, "é " * 30000), doc(13, "short"),
    ]


def test_near_duplicates(docs):
    rows = near_rows()
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(docs(rows)).collect())
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = roots([(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4], range(len(rows)))
    least = {k: min((rows[i][0] for i in root if root[i] == k and rows[i][0] is not None), default=None) for k in set(root.values())}
    assert got == Counter((r[0], f"{prints[i]:016x}", least[root[i]]) for i, r in enumerate(rows))
    assert near_duplicates(docs([], "doc_id long, text string, lang string, source string, n_chars long")).count() == 0


def test_one_of_each_group_stays(docs):
    df = docs(near_rows() + [doc(None, "only null ids here"), doc(None, "only null ids here")])
    kept = drop_near_duplicates(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and {r["_fp"] for r in kept.collect()} == {4}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 8), (False, 12), (False, 13), (True, 0)]


def plain_windows(sequences, weights, window):
    counts = Counter()
    for s, w in zip(sequences, weights):
        for i in range(len(s) - window + 1):
            counts[tuple(s[i : i + window])] += int(w)
    return {(k, i) for k, s in enumerate(sequences) for i in range(len(s) - window + 1) if counts[tuple(s[i : i + window])] >= 2}


def test_fm_index_windows():
    rng = np.random.default_rng(5)
    for trial in range(80):
        window, sigma = int(rng.integers(3, 8)), int(rng.integers(2, 6)) if trial % 2 else 40
        seqs = [rng.integers(1, sigma + 1, rng.integers(1, 40)) for _ in range(rng.integers(1, 20))]
        for _ in range(len(seqs) // 2):
            s = seqs[rng.integers(len(seqs))].copy()
            s[rng.integers(len(s))] = 1
            seqs.append(s)
        weights = rng.integers(1, 3, len(seqs))
        index = FMIndex(np.concatenate(seqs), np.array(list(map(len, seqs))), weights, 64)
        got = [(int(k), i) for k, a, b in zip(*index.repeated_windows(window)) for i in range(a, b + 1)]
        assert len(got) == len(set(got)) and set(got) == plain_windows(seqs, weights, window)


def test_matching_statistics():
    text = np.array([1, 2, 3, 1, 2, 4, 5])
    index = FMIndex(text, np.array([7]), np.array([1]), 16)
    ends = np.arange(1, 8)
    assert index.matching_statistics(np.zeros(7, int), ends, np.zeros(7, int)).tolist() == [1, 2, 0, 1, 2, 0, 0]


def plain_removal(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passages():
    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    shared = [fresh(n) for n in (35, 36, 60, 200)]
    rows = [doc(i, f"{fresh(int(rng.integers(0, 60)))} {shared[i % 4]}\n{fresh(int(rng.integers(0, 60)))}") for i in range(24)]
    rows += [doc(100, shared[3]), doc(101, "ha " * 90), doc(102, "x y z " * 30), doc(103, fresh(34)), doc(104, None), doc(105, ""), doc(None, shared[2]), doc(106, fresh(50)), doc(106, fresh(50))]
    text = fresh(80)
    return rows + [doc(107, text), doc(107, text), doc(108, " ".join(shared[2].split()[:34])), doc(109, shared[2].split()[0] + " é " + shared[2]), doc(110, fresh(6000) + " " + shared[0])]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substring_removal(docs, hot):
    """With ``hot`` at 2, keys that three regions share are searched window by window."""
    rows = passages()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs(rows), hot=hot).collect())
    assert got == plain_removal(rows, 35)
    assert sum(n for _, _, n, _ in got) > 1000


def test_substring_removal_of_nothing(docs):
    assert remove_repeats(docs([], "doc_id long, text string, lang string, source string, n_chars long")).count() == 0
    rows = [doc(1, "a b c"), doc(2, None)]
    assert Counter(tuple(r) for r in remove_repeats(docs(rows)).collect()) == plain_removal(rows, 35)


def test_short_windows_on_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = Counter(tuple(r) for r in remove_repeats(df, window=9, group=3).collect())
    assert got == plain_removal([tuple(r) for r in df.collect()], 9)
    assert defaultdict(int, got)
