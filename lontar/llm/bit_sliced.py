"""Exact top-k by inner product on a bit-sliced index.

Every attribute of a block of rows is stored as bit slices: bitmap j holds bit j
of the attribute in all rows.  Attributes are shifted to start at 0 and
quantised by leaving out their lowest LOW bits.  A query's score over all rows
is then a sum of slices, weighted by powers of two: each set bit of a query
weight adds the attribute's slices, shifted; bitmaps of equal weight are added
by carry-save adders (five bitmap operations for three bitmaps).  A negative
weight adds the slices of the attribute's distance from its greatest value.

The sum's slices are descended from the most significant one to the score of
the k-th row.  Leaving out low bits lowers a score by less than a bound known
from the weights, so rows whose sum lies within that bound of the k-th are on
the boundary; they are resolved with the exact integer product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.llm.blocks import scan_blocks, usable

#: Factor of the integer attributes.
SCALE = 1024
#: Low bits left out of the slices.
LOW = 3
#: Queries whose sums are held at once.
QUERY_CHUNK = 16


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit slices of non-negative integers: rows x attributes to bits x attributes x words."""
    n, d = values.shape
    words = -(-n // 64)
    out = np.zeros((bits, d, words * 8), np.uint8)
    for j in range(bits):
        packed = np.packbits((values.T >> j & 1).astype(np.uint8), axis=1, bitorder="little")
        out[j, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def add_slices(weighted: list[list[np.ndarray]]) -> np.ndarray:
    """Sum of bitmaps: weighted[j] holds arrays (count x queries x words) of weight 2 ** j; slices of the sum."""
    done = []
    j = 0
    while j < len(weighted):
        parts = weighted[j]
        if not parts:
            done.append(None)
            j += 1
            continue
        stack = np.concatenate(parts)
        while len(stack) > 1:
            carries = weighted[j + 1] if j + 1 < len(weighted) else weighted.append([]) or weighted[-1]
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
                break
            k = len(stack) // 3
            a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
            odd = a ^ b
            carries.append((a & b) | (c & odd))
            stack = np.concatenate([odd ^ c, stack[3 * k :]])
        done.append(stack[0])
        j += 1
    shape = next(d.shape for d in done if d is not None)
    return np.stack([np.zeros(shape, np.uint64) if d is None else d for d in done])


def count_bits(bitmaps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmaps).sum(axis=-1, dtype=np.int64)


def kth_value(sums: np.ndarray, alive: np.ndarray, k: np.ndarray) -> np.ndarray:
    """k-th greatest sum of the rows in `alive` for each query, by descent from the top slice."""
    value = np.zeros(len(k), np.int64)
    equal, need = alive.copy(), k.copy()
    for j in range(len(sums) - 1, -1, -1):
        ones = equal & sums[j]
        n = count_bits(ones)
        take = n >= need
        value += np.where(take, 1 << j, 0)
        need = np.where(take, need, need - n)
        equal = np.where(take[:, None], ones, equal & ~sums[j])
    return value


def at_least(sums: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmap of rows whose sum is at least the query's bound."""
    more = np.zeros(sums.shape[1:], np.uint64)
    equal = np.full(sums.shape[1:], ~np.uint64(0))
    for j in range(len(sums) - 1, -1, -1):
        one = (bound >> j & 1).astype(bool)[:, None]
        more |= np.where(one, np.uint64(0), equal & sums[j])
        equal &= np.where(one, sums[j], ~sums[j])
    return more | equal


class BitSlicedIndex:
    """Slices of a block of integer vectors (rows x attributes)."""

    def __init__(self, rows: np.ndarray, low: int = LOW):
        self.rows, self.low = rows, low
        self.least, most = rows.min(axis=0), rows.max(axis=0)
        bits = max(1, int(most.max(initial=0) - self.least.min(initial=0)).bit_length() - low)
        up, down = rows - self.least, most - rows
        self.up, self.down = (slices_of(v >> low, bits) for v in (up, down))
        words = self.up.shape[2]
        self.valid = np.packbits(np.pad(np.ones(len(rows), np.uint8), (0, words * 64 - len(rows))), bitorder="little").view(np.uint64)

    def candidates(self, queries: np.ndarray, k: int, exclude: np.ndarray) -> np.ndarray:
        """Queries x rows: rows that may be among the k best; exclude: row taken from each query's candidates, or -1."""
        weights = np.abs(queries)
        negative = queries < 0
        weighted: list[list[np.ndarray]] = [[] for _ in range(int(weights.max(initial=0)).bit_length() + len(self.up))]
        # For each bit of the weights: all ones where an attribute of a query has it.
        masks = [np.where(weights.T >> bit & 1, ~np.uint64(0), np.uint64(0))[:, :, None] for bit in range(int(weights.max(initial=0)).bit_length())]
        for j in range(len(self.up)):
            signed = np.where(negative.T[:, :, None], self.down[j][:, None, :], self.up[j][:, None, :])
            for bit, mask in enumerate(masks):
                weighted[bit + j].append(signed & mask)
        if not any(weighted):
            sums = np.zeros((1, len(queries), self.up.shape[2]), np.uint64)
        else:
            sums = add_slices(weighted)
        alive = np.repeat(self.valid[None], len(queries), axis=0)
        own = np.flatnonzero(exclude >= 0)
        alive[own, exclude[own] >> 6] &= ~(np.uint64(1) << (exclude[own] & 63).astype(np.uint64))
        k = np.minimum(k, count_bits(alive))
        kth = kth_value(sums, alive, np.maximum(k, 1))
        # A sum counts units of 2 ** low and may be short by less than this many.
        short = -(-weights.sum(axis=1) * ((1 << self.low) - 1) >> self.low) if self.low else np.zeros(len(queries), np.int64)
        near = at_least(sums, np.maximum(kth - short, 0)) & alive
        near[k == 0] = 0
        return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(self.rows)].astype(bool)


def _integers(table: pa.Table) -> np.ndarray:
    """floor(SCALE * x) of all components; Python's integers where 64 bits might not hold a product."""
    column = table.column("vector").combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if np.abs(x).max(initial=0) * SCALE < 2 ** (31 - x.shape[1].bit_length() / 2):
        return np.floor(x * SCALE).astype(np.int64)
    # From 2 ** 53 on every double is an integer.
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()], object)


def _plain(values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Products of Python's integers, held to the range of a long."""
    products = values.astype(object) @ queries.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(p))) for p in products], np.int64)


def top_products(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each query row.

    Components x become floor(SCALE * x).  Queries are rows whose id is divisible
    by `every`; candidates are all rows with another id.  Ties go to the smaller
    id.  Rows with a null id, or with a vector that is null, empty or holds null
    or non-finite components, take no part; vectors of another length than the
    query's are no candidates.  Rows that repeat an id are candidates each, and a
    repeated query row is one query.  Blocks with components whose products 64
    bits might not hold are compared without slices; a score beyond a long is
    shown as the greatest or least one.  Vectors of any length go whole, and only
    id and vector are read.  Fewer candidates give fewer ranks; an empty table
    gives none.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable("vec_id", "vector"))

    def scan(asked: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and block.num_rows:
            q_len, b_len = (t.column("vector").combine_chunks().value_lengths().to_numpy() for t in (asked, block))
            for length in np.unique(q_len):
                qs, bs = asked.filter(pa.array(q_len == length)), block.filter(pa.array(b_len == length))
                if not bs.num_rows:
                    continue
                q_ids, ids = qs.column("vec_id").to_numpy(), bs.column("vec_id").to_numpy()
                queries, values = _integers(qs), _integers(bs)
                wide = object in (queries.dtype, values.dtype)
                index = None if wide else BitSlicedIndex(values)
                for at in range(0, len(q_ids), QUERY_CHUNK):
                    some, some_ids = queries[at : at + QUERY_CHUNK], q_ids[at : at + QUERY_CHUNK]
                    # Rows with the query's own id are no candidates; one is masked, further ones raise k.
                    same = some_ids[:, None] == ids[None]
                    extra = int(max(0, same.sum(axis=1).max(initial=0) - 1))
                    near = ~same if wide else index.candidates(some, k + extra, np.where(same.any(axis=1), same.argmax(axis=1), -1)) & ~same
                    for i, row in enumerate(near):
                        c = np.flatnonzero(row)
                        score = _plain(values[c], some[i]) if wide else values[c] @ some[i]
                        best = np.lexsort((ids[c], -score))[:k]
                        found.append((np.full(len(best), some_ids[i]), ids[c[best]], score[best]))
        columns = [np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    best = scan_blocks(rows, F.col("vec_id") % every == 0, scan, "query_id long, vec_id long, score long")
    return ranked(best, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
