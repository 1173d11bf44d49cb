"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are scaled to length 1, so the inner product is the cosine.  A product
quantiser with 16 codewords for each pair of dimensions is trained and applied
under a loss that weighs the residual's part parallel to the vector more than
the part across it: for queries that score high it is the parallel part that
moves the score.  The weight follows from the score from which accuracy counts
(`THRESHOLD`).  Codes are chosen by coordinate descent under that loss and the
codewords by one least-squares system, in turns.

A query scans four-bit tables: one table of 16 products a pair of dimensions,
two of them joined into a table of 256 small integers, summed over the codes of
a block.  The best rows of each block, a fixed share of it, are scored exactly.

Original vectors travel with the codes: fetching them later for the rows that a
query reranks would move more bytes up to some 4e9 rows, as blocks are large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.bit_sliced import ranked
from lontar.llm.blocks import scan_blocks, usable
from lontar.llm.shared import cut

#: Rows that training reads at most (the first by hash), turns of training, sweeps of coordinate descent.
TRAIN_ROWS, TURNS, SWEEPS = 8192, 6, 2
#: Codewords of a subspace (four bits) and dimensions of a subspace.
WORDS, PART = 16, 2
#: Cosine from which accuracy counts.
THRESHOLD = 0.2
#: Rows of each block that are scored exactly: one of RERANK_SHARE, RERANK_LEAST at least.
RERANK_SHARE, RERANK_LEAST = 64, 64
#: Vector lengths that a quantiser is trained for (the commonest); rarer ones are compared exactly.
LENGTHS = 16
QUERY_CHUNK = 128


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass
class Quantiser:
    #: Subspaces x WORDS x PART.
    codewords: np.ndarray
    #: Weight of the parallel part; the part across counts 1.
    parallel: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows x subspaces x PART, padded with zeros."""
        m = len(self.codewords)
        return np.pad(x, ((0, 0), (0, m * PART - x.shape[1]))).reshape(len(x), m, PART)

    def encode(self, x: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """Codes of unit vectors: rows x subspaces."""
        p = self.parts(x)
        n, m, _ = p.shape
        codes = np.empty((n, m), np.uint8)
        along = np.empty((n, m))
        for s in range(m):
            r = p[:, s, None, :] - self.codewords[s]
            codes[:, s] = (r**2).sum(axis=2).argmin(axis=1)
            along[:, s] = (p[:, s] * r[np.arange(n), codes[:, s]]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for s in range(m):
                r = p[:, s, None, :] - self.codewords[s]
                own = (p[:, s, None, :] * r).sum(axis=2)
                loss = (r**2).sum(axis=2) + (self.parallel - 1) * ((total - along[:, s])[:, None] + own) ** 2
                codes[:, s] = loss.argmin(axis=1)
                total -= along[:, s]
                along[:, s] = own[np.arange(n), codes[:, s]]
                total += along[:, s]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords of least anisotropic loss for given codes."""
        p = self.parts(x)
        n, m, _ = p.shape
        slot = (np.arange(m) * WORDS + codes)[:, :, None] * PART + np.arange(PART)
        chosen = np.zeros((n, m * WORDS * PART))
        np.put_along_axis(chosen, slot.reshape(n, -1), p.reshape(n, -1), axis=1)
        counts = np.bincount(slot.ravel(), minlength=m * WORDS * PART).astype(float)
        normal = (self.parallel - 1) * (chosen.T @ chosen)
        normal[np.diag_indices_from(normal)] += counts + 1e-6
        fitted = np.linalg.solve(normal, self.parallel * chosen.sum(axis=0) + 1e-6 * self.codewords.ravel())
        self.codewords = fitted.reshape(m, WORDS, PART)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Queries x pairs of subspaces x 256 small integers in the order of the products."""
        products = np.einsum("qsp,swp->qsw", self.parts(queries), self.codewords)
        if products.shape[1] % 2:
            products = np.pad(products, ((0, 0), (0, 1), (0, 0)))
        low = products.min(axis=2, keepdims=True)
        step = (products - low).max(axis=(1, 2), keepdims=True) / 255
        small = np.rint((products - low) / np.where(step > 0, step, 1)).astype(np.uint32)
        return (small[:, 0::2, :, None] + small[:, 1::2, None, :]).reshape(len(queries), -1, WORDS * WORDS)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte: rows x pairs."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] * WORDS + codes[:, 1::2]


def train(sample: np.ndarray, threshold: float = THRESHOLD, turns: int = TURNS, seed: int = 5) -> Quantiser:
    """Quantiser fitted to unit vectors (rows x dimensions)."""
    n, d = sample.shape
    m = -(-d // PART)
    parallel = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    start = np.pad(sample, ((0, 0), (0, m * PART - d))).reshape(n, m, PART)
    quantiser = Quantiser(np.stack([start[rng.choice(n, WORDS, replace=n < WORDS), s] for s in range(m)]), 1.0)
    for turn in range(turns):
        if turn == turns // 3:
            quantiser.parallel = parallel
        quantiser.refit(sample, quantiser.encode(sample, SWEEPS if quantiser.parallel > 1 else 0))
    quantiser.parallel = parallel
    return quantiser


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length; those whose squares a double might not hold are scaled by a power of two."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    far = np.abs(exponent) > 400
    x[far] = np.ldexp(x[far], -exponent[far, None])
    return x


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", share: int = RERANK_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row, by cosine.

    Queries are rows whose id is divisible by `every`; candidates are all rows
    with another id and a vector of the same length.  Ties go to the smaller id.
    Rows with a null id, or with a vector that is null, empty, zero or holds null
    or non-finite components, take no part.  Rows that repeat an id are
    candidates each, and a repeated query row is one query.  Vectors of any
    length go whole, and only id and vector are read.  Fewer candidates give
    fewer ranks; an empty table gives none.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable("vec_id", "vector") & F.exists("vector", lambda x: x != 0))
    lengths = [r["d"] for r in rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(LENGTHS).collect()]
    trained = {}
    for d in lengths:
        sample = rows.where(F.size("vector") == d).orderBy(F.xxhash64("vec_id", "vector")).select("vector").limit(TRAIN_ROWS).toArrow()
        trained[d] = train(unit(_matrix(sample.column(0))))
    shared = rows.sparkSession.sparkContext.broadcast(trained)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sizes = part.column(1).value_lengths().to_numpy()
                codes = [b""] * len(sizes)
                for d in shared.value.keys() & set(sizes.tolist()):
                    own = np.flatnonzero(sizes == d)
                    for i, c in zip(own, pack_codes(shared.value[d].encode(unit(_matrix(part.column(1).take(pa.array(own)))))), strict=True):
                        codes[i] = c.tobytes()
                both = pa.StructArray.from_arrays([part.column(1), pa.array(codes, pa.binary())], names=["x", "codes"])
                yield pa.RecordBatch.from_arrays([part.column(0), both], names=["vec_id", "vector"])

    def best_of(quantiser: Quantiser | None, asked: pa.Table, block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q_ids, ids = asked.column("vec_id").to_numpy(), block.column("vec_id").to_numpy()
        q_rows, b_rows = (t.column("vector").combine_chunks() for t in (asked, block))
        exact, against = _matrix(q_rows.field("x")), _matrix(b_rows.field("x"))
        norms = np.linalg.norm(against, axis=1)
        codes = np.frombuffer(b"".join(b_rows.field("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        n = len(ids) if quantiser is None else min(len(ids), max(RERANK_LEAST, k, -(-len(ids) // share)))
        for at in range(0, len(q_ids), QUERY_CHUNK):
            some, some_ids = exact[at : at + QUERY_CHUNK], q_ids[at : at + QUERY_CHUNK]
            same = some_ids[:, None] == ids[None]
            sums = np.zeros((len(some), len(ids)), np.uint32)
            if n < len(ids):
                tables = quantiser.tables(unit(some))
                for p in range(codes.shape[1]):
                    sums += tables[:, p].take(codes[:, p], axis=1)
                sums[same] = 0
            best = np.argpartition(sums, len(ids) - n, axis=1)[:, len(ids) - n :]
            for i, c in enumerate(best):
                c = c[~same[i, c]]
                score = (against[c] * some[i]).sum(axis=1) / (norms[c] * np.linalg.norm(some[i]))
                top = np.lexsort((ids[c], -score))[:k]
                yield np.full(len(top), some_ids[i]), ids[c[top]], score[top]

    def scan(asked: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and block.num_rows:
            q_len, b_len = (t.column("vector").combine_chunks().field("x").value_lengths().to_numpy() for t in (asked, block))
            for d in np.intersect1d(q_len, b_len).tolist():
                found.extend(best_of(shared.value.get(d), asked.filter(pa.array(q_len == d)), block.filter(pa.array(b_len == d))))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    kind = rows.schema["vector"].dataType.simpleString()
    coded = cut(rows.mapInArrow(encode, f"vec_id long, vector struct<x:{kind},codes:binary>"))
    return ranked(scan_blocks(coded, F.col("vec_id") % every == 0, scan, "query_id long, vec_id long, score double"), k)
