"""Bloom filters over pairs of 64-bit hashes, built on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash functions of a filter unless said otherwise; bits are sized for a false positive rate of 2 ** -hashes.
HASHES = 6
#: Largest filter that is broadcast, in bits (32 MB).
MAX_BITS = 1 << 28


def bits_for(n: int, hashes: int = HASHES) -> int:
    return 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))


def positions(level: int, m: int, h1: np.ndarray, h2: np.ndarray, hashes: int = HASHES) -> Iterator[np.ndarray]:
    step = h2 | np.uint64(1)
    at = h1 ^ (step * np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
    for _ in range(hashes):
        at = (at + step) ^ (at >> np.uint64(29))
        yield at % np.uint64(m)


def passes(words: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int = 0, hashes: int = HASHES) -> np.ndarray:
    """Which of the hashes the filter lets through."""
    inside = np.ones(len(h1), bool)
    for at in positions(level, len(words) * 64, h1, h2, hashes):
        inside &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return inside


def build(keys: DataFrame, n: int, level: int = 0, hashes: int = HASHES, two_hashes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Words of a filter of the n rows (h1, h2) of `keys`, or of what `two_hashes` makes of its only column.

    Hashes are made in the same pass: two passes in one task hold two workers,
    and executors keep all workers that were ever busy at once.
    """
    m = bits_for(n, hashes)
    read = keys.select("h1", "h2") if two_hashes is None else keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            h1, h2 = (c.view(np.uint64) for c in columns) if two_hashes is None else two_hashes(*columns)
            at = np.concatenate([*positions(level, m, h1, h2, hashes)]) if len(h1) else np.empty(0, np.uint64)
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = read.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(m // 64, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words
