"""Words of many texts at once, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. Every function works on the UTF-8 bytes of whole texts laid end to end, so
the cost a word is that of a few array passes and not of a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS = {_P: np.ones(1, _U), _P_INVERSE: np.ones(1, _U)}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS[base]
    if len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of a run of texts: byte starts and ends, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        solid = ~_SPACE[data]
        first, last = np.ones(n, bool), np.ones(n, bool)
        if n:
            first[1:] = ~solid[:-1]
            last[:-1] = ~solid[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            first[inner] = True
            last[inner - 1] = True
        self.starts = np.flatnonzero(solid & first)
        self.ends = np.flatnonzero(solid & last) + 1
        self.first_word = np.searchsorted(self.starts, offsets)  # of each text, and the end of the last

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, _U)
        np.cumsum(_CODES[self.data] * _powers(_P, n), out=total[1:])
        raw = (total[self.ends] - total[self.starts]) * _powers(_P_INVERSE, n + 1)[self.starts]
        return mix(raw + (self.ends - self.starts).astype(_U))


def runs_of_texts(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text offsets) of consecutive rows of about ``most_bytes``; a longer text is alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    large = pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _folded(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of word hashes in their order, place by place."""
    out = parts[0]
    for h in parts[1:]:
        out = mix(out * _U(0xD6E8FEB86659FD93) + (h ^ (h >> _U(32))) * _U(0xCA5A826395121157))
    return out


def shingle_sets(words: Words, width: int = 2) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``width``-word shingles; of fewer words, all of them as one; of none, empty."""
    h = words.hashes()
    n = len(h) - width + 1
    all_ = _folded([h[k : k + n] for k in range(width)]) if n > 0 else h[:0]
    bounds = words.first_word
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(all_[lo : hi - width + 1]))
        else:
            out.append(mix(_folded([h[k : k + 1] for k in range(lo, hi)]) + _U(0x5851F42D4C957F2D + hi - lo)) if hi > lo else h[:0])
    return out
