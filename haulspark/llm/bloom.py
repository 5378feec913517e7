"""Bloom filters that Spark jobs fill and Python workers ask."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.tokens import mix

_U = np.uint64


@dataclass
class BloomFilter:
    """Bits of one filter; a key's places follow from its two 64-bit hashes and the filter's number."""

    n_bits: int
    n_hashes: int
    number: int
    words: np.ndarray

    def positions(self, one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
        salt = _U((self.number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        one, two = mix(one + salt), mix(two ^ salt)
        for i in range(self.n_hashes):
            yield (one + _U(i) * two) % _U(self.n_bits)

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.ones(len(one), bool)
        for at in self.positions(one, two):
            out &= (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
        return out

    def holds_ids(self, ids: np.ndarray) -> np.ndarray:
        one = mix(ids.astype(np.int64).view(_U))
        return self.holds(one, mix(~one))


def fill(keys: DataFrame, n_bits: int, n_hashes: int, number: int = 0) -> BloomFilter:
    """A filter of all ``keys`` (one, two: long), by one distributed OR over its 64-bit words."""
    out = BloomFilter(n_bits, n_hashes, number, np.zeros(0, _U))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_numpy().view(_U) for c in ("one", "two"))
            at = np.unique(np.concatenate(list(out.positions(one, two))))
            word, first = np.unique((at >> _U(6)).astype(np.int64), return_index=True)
            bits = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), first) if len(at) else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bit"])

    bits = keys.select("one", "two").mapInArrow(set_bits, "word long, bit long")
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most n_bits / 64 rows
    words = np.zeros((n_bits + 63) // 64, np.int64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    out.words = words.view(_U)
    return out


#: Bits of the largest filter of ids, 4 MB.
MOST_BITS = 1 << 25


def filter_of_ids(ids: DataFrame, n_ids: int) -> BloomFilter:
    """A filter of long ``id`` that lets about one other id in fifty through, as long as that fits in 4 MB.

    Beyond, it lets more through and never fewer: it only spares work that a join would throw away.
    """
    n_bits = min(MOST_BITS, max(1 << 10, 1 << (9 * n_ids).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = mix(batch.column("id").to_numpy().view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(mix(~one).view(np.int64))], names=["one", "two"])

    return fill(ids.select("id").mapInArrow(hashed, "one long, two long"), n_bits, 4)
