"""Minimal perfect hashing of keys that are all known, and tables that check what they find against the stored keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haulspark.llm.tokens import _CODES, _P, _P_INVERSE, _powers, mix

_U = np.uint64


class PerfectHash:
    """Distinct 64-bit keys to slots 0 .. n - 1, one each, in about four bits a key.

    A level is a bit array twice as long as the keys it gets: a key whose place no other key shares has its bit set and is
    settled, the others go to the next level. A key's slot is the rank of its bit among all set bits.
    """

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(_U, copy=False)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        settled = 0
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            place = self._place(keys, len(self.levels), size)
            met = np.bincount(place, minlength=size)
            words = np.packbits(met == 1, bitorder="little").view(_U)
            ranks = settled + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((size, words, ranks))
            settled += int((met == 1).sum())
            keys = keys[met[place] != 1]
        self.size = settled

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a value that is no key, any slot or -1."""
        keys = keys.astype(_U, copy=False)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(keys[left], level, size)
            word, bit = words[place >> 6], _U(1) << (place & 63).astype(_U)
            hit = (word & bit) != 0
            out[left[hit]] = ranks[place[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - _U(1)))
            left = left[~hit]
        return out


class NumberTable:
    """Slots of known non-negative 64-bit numbers; a number that is not stored has -1."""

    def __init__(self, keys: np.ndarray):
        self.hash = PerfectHash(keys)
        self.keys = np.empty(len(keys), np.int64)
        self.keys[self.hash.slots(keys)] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self.hash.slots(keys)
        return np.where((slot >= 0) & (self.keys[slot] == keys), slot, -1)


def byte_hashes(values: pa.Array, most_bytes: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of large_binary values, in pieces of about ``most_bytes``."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if len(values) and values.buffers()[2] is not None else np.zeros(0, np.uint8)
    out, lo = np.empty(len(values), _U), 0
    while lo < len(values):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
        at = offsets[lo : hi + 1] - offsets[lo]
        total = np.zeros(at[-1] + 1, _U)
        np.cumsum(_CODES[data[offsets[lo] : offsets[hi]]] * _powers(_P, int(at[-1])), out=total[1:])
        out[lo:hi] = mix((total[at[1:]] - total[at[:-1]]) * _powers(_P_INVERSE, int(at[-1]) + 1)[at[:-1]] + np.diff(at).astype(_U))
        lo = hi
    return out


class BytesTable:
    """Slots of known byte strings (large_binary); strings that share a 64-bit hash with another stand in a table of their own."""

    def __init__(self, values: pa.Array, hashes: np.ndarray | None = None):
        hashes = byte_hashes(values) if hashes is None else hashes
        _, first = np.unique(hashes, return_index=True)
        self.hash = PerfectHash(hashes[first])
        rest = np.setdiff1d(np.arange(len(values)), first)
        order = np.empty(len(values), np.int64)
        order[self.hash.slots(hashes[first])] = first
        order[len(first) :] = rest
        self.order, self.values, self.n_hashed = order, values.take(pa.array(order)), len(first)
        self.others = {values[i].as_py(): len(first) + k for k, i in enumerate(rest.tolist())}

    def __len__(self) -> int:
        return len(self.values)

    def find(self, values: pa.Array, hashes: np.ndarray | None = None) -> np.ndarray:
        """The slot of each string, -1 for one that is not stored."""
        if not len(self.values):
            return np.full(len(values), -1, np.int64)
        slot = self.hash.slots(byte_hashes(values) if hashes is None else hashes)
        same = pc.equal(self.values.take(pa.array(np.maximum(slot, 0))), values).to_numpy(zero_copy_only=False)
        out = np.where((slot >= 0) & same, slot, -1)
        if self.others:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.others.get(values[i].as_py(), -1)
        return out
