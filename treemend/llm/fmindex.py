"""A compressed FM-index over word sequences: Burrows-Wheeler text in a wavelet matrix, searched backwards.

Many searches run side by side: every step extends all of them by one word.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start places of the suffixes, sorted by their first ``depth`` symbols (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    known = 1
    while True:
        shifted = np.zeros(n, np.int64)
        shifted[: n - known] = rank[known:] + 1 if known < n else 0
        key = rank * (int(rank.max()) + 2) + shifted
        order = np.argsort(key, kind="stable")
        step = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, step[1:] != step[:-1]])
        rank, known = new, known * 2
        if known >= depth or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Bit-packed levels with running counts per 64 bits; gives how often a symbol occurs before a place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        n = len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        at = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = (at >> np.uint32(level)) & np.uint32(1)
            packed = np.packbits(np.r_[bits.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed))[:-1]].astype(np.int64))
            self.zeros.append(n - int(bits.sum()))
            at = np.concatenate([at[bits == 0], at[bits == 1]])
        self.base = self._down(np.arange(sigma, dtype=np.uint32), np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))
            set_ = (symbols >> np.uint32(self.levels - 1 - k)) & np.uint32(1)
            at = np.where(set_ == 1, self.zeros[k] + ones, at - ones)
        return at

    def before(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.base[symbols]


class FMIndex:
    """Index over sequences of symbols (1 and up), each with a weight; ``depth`` is the longest search."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int):
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.text = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
        inside = np.ones(len(self.text), bool)
        inside[starts + lengths] = False
        self.text[inside] = sequences
        self.starts, self.lengths = starts, lengths
        sigma = int(self.text.max()) + 1
        order = suffix_order(self.text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))])
        self.matrix = WaveletMatrix(self.text[order - 1], sigma)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with one symbol more on the left."""
        both = self.matrix.before(np.r_[symbols, symbols].astype(np.uint32), np.r_[lo, hi]) + np.r_[self.first[symbols], self.first[symbols]]
        return both[: len(lo)], both[len(lo) :]

    def matching_statistics(self, which: np.ndarray, ends: np.ndarray, stop: np.ndarray, least: int = 2) -> np.ndarray:
        """For places in indexed sequences: how many symbols before ``ends`` still occur with a weight of ``least``; none before ``stop`` is read."""
        reached = ends.copy()
        live = np.arange(len(which))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.text), np.int64)
        place = self.starts[which]
        while len(live):
            at = reached[live] - 1
            lo, hi = self.extend(self.text[place[live] + at], lo, hi)
            good = self.weight[hi] - self.weight[lo] >= least
            live, lo, hi = live[good], lo[good], hi[good]
            reached[live] -= 1
            more = reached[live] > stop[live]
            live, lo, hi = live[more], lo[more], hi[more]
        return ends - reached

    def repeated_windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, first, last) of runs of window starts whose window occurs with weight two or more.

        A search from the end of a window tells more than that window: all
        windows inside the match repeat, and all that hold the match and the
        word before it do not. What stays open is halved, round after round.
        """
        which = np.arange(len(self.lengths))
        a, b = np.zeros(len(which), np.int64), self.lengths - window
        which, a, b = which[b >= a], a[b >= a], b[b >= a]
        out, turn = [], 0
        while len(which):
            # the last window first, then the first, then the middle
            probe = b if turn == 0 else a if turn == 1 else (a + b) // 2
            ends = probe + window
            fail = ends - self.matching_statistics(which, ends, a) - 1  # the word that ends the match; a - 1 if none does
            whole = fail < a
            low = np.where(whole, a, fail + 1)
            good = low <= probe
            out.append((which[good], low[good], probe[good]))
            # windows from the probe up to the failing word hold the match and that word
            left_to = np.where(whole, a - 1, np.minimum(fail, probe - 1))
            right_from = np.maximum(probe, fail) + 1
            open_ = [(which, a, left_to), (which, right_from, b)]
            which, a, b = (np.concatenate([x[i] for x in open_]) for i in range(3))
            keep = a <= b
            which, a, b = which[keep], a[keep], b[keep]
            turn += 1
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
