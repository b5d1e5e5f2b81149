import numpy as np
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import doc

from treemend.llm import alignment
from treemend.llm.alignment import Aligner, alignment_report, byte_alphabet, stretches_of, windows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALIGNER = Aligner(A, B)
TEXTS = [
    "", None, "a", " a", "a ", "  two  blanks ", "Hello 日本 x 🙂 end", "naïve café — £5", "<|endoftext|> <s> </s> <0x0A>", "tab\tand\nline\r\n\n  x",
    "▁ low line", "don't we'll I'm '' 's", "x" * 3000, "日本語のテキスト" * 50, "👍🏽👩‍👩‍👧 zero​width", "a b 　 c \x85 d \x1c e", "́ accent ́", "12 345 6,7 8.9",
]


def align_text(known, text, fresh, most=10**9):
    return alignment.align_text(known, map(stretches_of, windows(text, most)) if text else (), fresh)


def brute_text(text):
    """Both whole encodings and every byte end, without stretches or spans."""
    letters = byte_alphabet()
    if not text:
        return [], [], []
    raw = (" " + text).encode()
    a, b = ALIGNER.a.encode(" " + text, add_special_tokens=False), ALIGNER.b.encode(text)
    a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(p[3:-1], 16)]) if ALIGNER.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, ALIGNER.b.id_to_piece(i)) for i in b)]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return [], [], []
    ends = []
    for tokens in (a_bytes, b_bytes):
        at, own = 0, []
        for t in tokens:
            at += len(t)
            own.append(at)
        ends.append(own)
    return list(zip(a.ids, ends[0])), list(zip(b, ends[1])), sorted(set(ends[0]) & set(ends[1]))


def brute(texts):
    per, counts = [], Counter()
    for t in texts:
        a, b, cuts = brute_text(t)
        links = [(x, y) for x, e in a for y, f in b if e == f] if len(a) < 500 else [(dict((e, x) for x, e in a)[c], dict((e, x) for x, e in b)[c]) for c in cuts]
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= c) for side in (a, b)))
            low = c
        counts.update(links)
        per.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    high = defaultdict(int)
    for (_, y), n in counts.items():
        high[y] = max(high[y], n)
    return [(na, nb, ng, len(links), sum(counts[p] == high[p[1]] for p in links), sum(counts[p] for p in links), sha) for na, nb, ng, links, sha in per]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé日🙂▁́'’\n\t\x1c .,09<|>s "), max_size=40))
def test_stretches_give_what_whole_texts_give(text):
    na, nb, groups, _, sha, pairs, times = align_text(ALIGNER, text, {})
    a, b, cuts = brute_text(text)
    assert (na, nb, groups) == (len(a), len(b), len(cuts))
    ends = dict((e, i) for i, e in a), dict((e, i) for i, e in b)
    expected = Counter(ends[0][c] * ALIGNER.b_size + ends[1][c] for c in cuts)
    assert dict(zip(pairs.tolist(), times.tolist())) == expected
    assert bool(sha) == bool(a)


@pytest.mark.parametrize("most", [0, 7, alignment.FREQUENT_PAIRS])
def test_report_is_brute_force(docs, most):
    rows = [doc(i, t) for i, t in enumerate(TEXTS + TEXTS[6:9])] + [doc(3, " a"), doc(None, "Hello Hello Hello")]
    got = alignment_report(docs(rows), A, B, most).collect()
    want = brute([r[1] for r in rows])
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_empty_table(docs):
    assert alignment_report(docs([]), A, B).collect() == []


def test_windows_of_a_long_text():
    text = "alpha beta  gamma\ndelta 日本 🙂 " * 400
    whole = align_text(ALIGNER, text, {})
    assert list(windows(text, 100))[0] == text[: text.index(" ", 100)] or " " not in text[100]
    assert " ".join(windows(text, 100)) == text
    plain = lambda found: [x.tolist() if hasattr(x, "tolist") else x for x in found]
    assert plain(align_text(ALIGNER, text, {}, 100)) == plain(whole)
    assert whole[:3] == tuple(map(len, brute_text(text)))


def test_a_full_memory_of_stretches_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_BYTES", 2_000)
    small = Aligner(A, B)
    for _ in range(2):
        for t in TEXTS:
            assert align_text(small, t or "", {})[:5] == align_text(ALIGNER, t or "", {})[:5]
    assert small.held <= 2_000


def test_a_stretch_reads_its_pieces_once():
    """Groups, pairs and counts from one pass over B's pieces, as by hand."""
    import public_tokenizers

    from treemend.llm.alignment import Aligner

    known = Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    encode, passes = known.b, []

    class Proto:
        def __init__(self, text):
            self.made = encode.encode(text, return_type="proto")

        @property
        def pieces(self):
            passes.append(1)
            return self.made.pieces

    known.b = type("B", (), {"encode": lambda self, text, return_type: Proto(text)})()
    stretches = ["Well", "unbelievable", "\u00e9t\u00e9", "x"]
    got = known.align(stretches)
    assert len(passes) == 1
    for s, (groups, pairs, tokens) in zip(stretches, got):
        a, b = known.a.encode(" " + s, add_special_tokens=False).ids, encode.encode(s)
        sides = [g.split("|") for g in groups.split(";")]
        assert [int(i) for x, _ in sides for i in x.split(",")] == a and [int(i) for _, x in sides for i in x.split(",")] == b
        assert (tokens & 0xFFFFFFFF, tokens >> 32) == (len(a), len(b))
        ends = [(int(x.split(",")[-1]), int(y.split(",")[-1])) for x, y in sides]
        assert [divmod(int(k), known.b_size) for k in np.frombuffer(pairs, known.pair)] == ends


class Watched:
    """Tokenizer B that keeps what it was given."""

    def __init__(self, known):
        self.b, self.texts = known.b, []

    def encode(self, text, **how):
        self.texts.append(text)
        return self.b.encode(text, **how)


def watched():
    known = Aligner(A, B)
    known.b = Watched(known)
    return known, known.b.texts


def is_brute(known, text):
    na, nb, groups, _, _, pairs, times = align_text(known, text, {})
    a, b, cuts = brute_text(text)
    ends = dict((e, i) for i, e in a), dict((e, i) for i, e in b)
    assert (na, nb, groups) == (len(a), len(b), len(cuts))
    assert dict(zip(pairs.tolist(), times.tolist())) == Counter(ends[0][c] * ALIGNER.b_size + ends[1][c] for c in cuts)


def test_stretches_met_again_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_BYTES", 40_000)
    known, given = watched()
    for n in range(40):
        is_brute(known, "recurrent " + " ".join(f"w{n}x{i}" for i in range(20)))
        assert known.held <= 20_000
    assert sum("recurrent" in t for t in given) == 1


def test_line_breaks_and_marks_part_stretches_met_before():
    known, given = watched()
    is_brute(known, "one two.\nthree")
    before = len(given)
    is_brute(known, "one.\nthree two")
    assert len(given) == before


@pytest.mark.parametrize("text", ["\nfoo bar\nfoo", "\n", "foo\n", "foo\n\nbar.\nbaz", "foo \nbar\n baz", "\n\nfoo bar", "a².\nb³, x'.", "foo\r\nbar", "foo\x1c\nbar", "foo\n▁ bar\nfoo", "foo\n▁", "it's.\n's", "x.y.\n.z"])
def test_odd_line_breaks(text):
    known = Aligner(A, B)
    for t in (text, "foo bar " + text, text + " foo.", text):
        is_brute(known, t)
        assert align_text(known, t, {}, 3)[:5] == align_text(ALIGNER, t, {})[:5]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1é²½日'.,#_…®\n\n\r\x85 \x1c  "), max_size=30))
def test_line_breaks_and_marks_are_brute_force(text):
    is_brute(ALIGNER, text)
