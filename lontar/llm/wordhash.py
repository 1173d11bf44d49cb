"""Hashes of words and of runs of words, for all texts of an Arrow slice at once.

A word is a run of bytes other than space and \\x09-\\x0D.  Hashes have 64 bits
and depend on the words alone, so executors agree on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, start of each text and the end); nulls are empty."""
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    buffers = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word and the end)."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), firsts
    lengths = np.diff(np.append(starts, len(data)))
    # Place in the word; white space after it counts for nothing.
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    letters = (_LOWER[data] if lower else data)[starts[0] :].astype(np.uint64) + np.uint64(1)
    letters *= powers[place]
    letters[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(letters, starts - starts[0])), firsts


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive words (runs over the end of a text included)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, out, doubled, width = 0, None, words, 1
    while True:
        if size & width:
            piece = doubled[done : done + n]
            out = piece if out is None else mix(out * _BASE + piece)
            done += width
        if done == size:
            return out if size > 1 else mix(out)
        doubled = mix(doubled[:-width] * _BASE + doubled[width:])
        width *= 2


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the least value (ties: leftmost) of every `size` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, width = np.arange(len(values)), 1
    least = values
    while width * 2 <= size:
        right = least[width:] < least[:-width]
        at = np.where(right, at[width:], at[:-width])
        least = np.where(right, least[width:], least[:-width])
        width *= 2
    shift = size - width
    return np.where(least[shift : shift + n] < least[:n], at[shift : shift + n], at[:n])
