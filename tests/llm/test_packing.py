import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import doc
from tokenizers import Tokenizer

from treemend.llm.packing import WordIds, best_fit, dominance_reduction, pack_documents, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "a", "Don't stop, it's 3am!", "ÉÈ ß Straße naïve", "<|endoftext|>x y<|startoftext|>", "a\tb\n\nc\x0bd\x85e\xa0f", "x　y \x1c z",
    "İstanbul ½ ٣٤ ① é é", "日本語 テスト 👍🏽 zero​width", "a'S b'RE '' ''t", "÷×µª º" * 20, "w" * 5000,
])
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(WordIds(PATH).ids(text), "<u4").tolist() == plain_ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abÀéßÿ'’s.,!? \n\t\x1c09<|>endoftx "), max_size=60))
def test_ids_of_any_text(text):
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == plain_ids(text)


WORDS = WordIds(PATH)


def fewest(items, capacity):
    """Brute force over bins, largest item first."""
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(items):
            return
        if i == len(items):
            best = min(best, len(rooms))
            return
        for r in {x for x in rooms if x >= items[i]}:
            put(i + 1, sorted(_less(rooms, r, items[i])))
        put(i + 1, sorted([*rooms, capacity - items[i]]))

    put(0, [])
    return best


def _less(rooms, room, item):
    rooms = list(rooms)
    rooms.remove(room)
    return [*rooms, room - item]


def test_fixed_sets_lose_nothing():
    rng = np.random.default_rng(3)
    fixed_some = 0
    for _ in range(150):
        capacity = int(rng.integers(6, 16))
        items = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, left = dominance_reduction(counts, capacity)
        fixed_some += bool(fixed)
        rest = [x for x in range(capacity, 0, -1) for _ in range(int(left[x]))]
        assert sum(m for _, m in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        for bins, _ in fixed:
            assert sum(k * v for k, v in bins.items()) <= capacity
    assert fixed_some > 100


def test_best_fit_packs_all_within_capacity():
    rng = np.random.default_rng(4)
    for _ in range(50):
        counts = np.bincount(rng.integers(1, 65, 500), minlength=65)
        groups = best_fit(counts, 64)
        packed = np.zeros(65, int)
        for items, many in groups:
            assert sum(k * v for k, v in items.items()) <= 64
            for k, v in items.items():
                packed[k] += v * many
        assert (packed == counts).all()
        used = sum(m for _, m in groups)
        assert used <= -(-int((counts * np.arange(65)).sum()) // 64) * 1.1 + 1


def test_places_cover_each_piece_once():
    counts = np.bincount(np.random.default_rng(5).integers(1, 33, 300), minlength=33)
    plan = plan_bins(counts, 32)
    taken = defaultdict(list)
    for length in range(1, 33):
        for number in range(counts[length]):
            at = np.searchsorted(plan["key"], (length << 44) + number, "right") - 1
            nth = number - plan["first"][at]
            taken[int(plan["sequence"][at] + nth // plan["each"][at])].append((int(plan["offset"][at] + nth % plan["each"][at] * length), length))
    for spans in taken.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 32
    assert sorted(taken) == list(range(len(taken)))


def check(rows, got, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_seq.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    want = defaultdict(list)
    for r in rows:
        ids = np.array([*plain_ids(r[1] or ""), 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r[0]].append((piece, at, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


def test_documents(docs):
    rows = [doc(1, "one two three"), doc(2, None), doc(3, ""), doc(4, "long text " * 400), doc(5, "one two three"), doc(5, "one two three"), doc(None, "no id"), doc(7, "a" * 3000)]
    check(rows, pack_documents(docs(rows), PATH, 64).collect(), 64)
    assert pack_documents(docs([], "doc_id long, text string, lang string, source string, n_chars long"), PATH).count() == 0


def test_pieces_of_exact_capacity(docs):
    n = len(plain_ids("word"))
    rows = [doc(i, " ".join(["word"] * k)) for i, k in enumerate((15 // n, 31 // n, 16 // n))]
    check(rows, pack_documents(docs(rows), PATH, 16).collect(), 16)


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = pack_documents(df, PATH).collect()
    check(rows, got, 4096)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 4096) + 2


def test_pairs_that_fill_a_bin_are_fixed():
    fixed, left = dominance_reduction(np.bincount([60] * 5 + [4] * 9, minlength=65), 64)
    assert ({60: 1, 4: 1}, 5) in fixed and left.sum() in (0, 4)
