"""An FM-index over short word sequences: k-sorted suffixes, wavelet matrix, backward search in lock-step."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class WaveletMatrix:
    """Symbols as bit vectors, one a level, each with a running count of ones a 64-bit word."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n_levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        now = symbols
        for level in reversed(range(self.n_levels)):
            bit = ((now >> level) & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(_U)
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.starts = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.n_levels))):
            word = at >> 6
            below = self.words[i][word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))
            ones = self.ones[i][word] + np.bitwise_count(below)
            at = np.where((symbols >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbols, at) - self.starts[symbols]


class FmIndex:
    """Index of sequences of words; suffixes are sorted by at least their first ``window`` words, enough for the patterns asked.

    ``groups`` are the runs of suffixes that agree in their first ``window`` words, each with the smallest owner of
    its suffixes' sequences.
    """

    def __init__(self, sequences: np.ndarray, bounds: np.ndarray, owners: np.ndarray, window: int):
        self.window = window
        n_seq, n = len(bounds) - 1, len(sequences) + len(bounds) - 1
        lengths = np.diff(bounds)
        _, local = np.unique(sequences, return_inverse=True)
        text = np.zeros(n, np.int64)  # a 0 ends each sequence
        self.begins = bounds[:-1] + np.arange(n_seq)
        inside = np.ones(n, bool)
        inside[self.begins + lengths] = False
        text[inside] = local + 1
        self.text, self.lengths = text, lengths
        # two overlapping runs of ``part`` words, a power of two, make up a window
        part = 1 << (window.bit_length() - 1)
        rank, half = text.copy(), 1
        while half < part:
            rank = self._joined(rank, half)
            half *= 2
        windows = self._joined(rank, window - part) if window > part else rank
        order = np.argsort(windows, kind="stable")
        before = np.where(order > 0, text[order - 1], 0)
        n_symbols = int(text.max()) + 1 if n else 1
        self.wavelet = WaveletMatrix(before, n_symbols)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        ordered = windows[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.group_of = np.cumsum(new) - 1
        self.group_begin = np.flatnonzero(new)
        self.group_end = np.append(self.group_begin[1:], n)
        owner_of = np.repeat(owners, lengths + 1)
        self.group_owner = np.minimum.reduceat(owner_of[order], self.group_begin)

    @staticmethod
    def _joined(rank: np.ndarray, apart: int) -> np.ndarray:
        """Ranks of places by their rank and then by that of the place ``apart`` words on."""
        n = len(rank)
        after = np.zeros(n, np.int64)
        after[: max(0, n - apart)] = rank[apart:] + 1
        return np.unique(rank * (n + 2) + after, return_inverse=True)[1]

    def smallest_owners(self) -> list[np.ndarray]:
        """For each indexed sequence, the smallest owner of each of its windows, by backward search.

        All sequences are read from their ends at once, one word a step. A match longer than the window gives up
        its last word by widening to its group, so a step costs two ranks a sequence.
        """
        out = [np.zeros(max(0, n - self.window + 1), np.int64) for n in self.lengths.tolist()]
        order = np.argsort(-self.lengths, kind="stable")
        ends = (self.begins + self.lengths)[order]
        lengths = self.lengths[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), len(self.text), np.int64)
        steps = []
        for step in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths, -step, "left"))  # longer than step
            low, high = low[:active], high[:active]
            symbol = self.text[ends[:active] - 1 - step]
            place = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.counts[symbol] + place[:active], self.counts[symbol] + place[active:]
            if step >= self.window - 1:
                group = self.group_of[low]
                steps.append(self.group_owner[group])
                low, high = self.group_begin[group], self.group_end[group]
        for k, owner in enumerate(steps):
            for q, v in zip(order[: len(owner)].tolist(), owner.tolist(), strict=True):
                out[q][len(out[q]) - 1 - k] = v
        return out
