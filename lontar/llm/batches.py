"""Bounded Arrow slices of a table's rows, shared by the operators that need Python.

Every operator reads only the columns it names, so other columns of the input,
whatever they are called, never clash with what the operator adds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from lontar.llm.shared import bound_batches

#: Bytes of text that one call of a row function sees at most (one longer row still goes whole).
SLICE_BYTES = 1 << 20


#: What this Python worker remembers, by name: of one operator at a time.
_KEPT: dict[str, Any] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What `make` gave under this name before, in this worker; anything under other names is let go.

    Workers serve one stage after another, so memories would add up.
    """
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Let go of what other operators left in this worker, and give it back to the system."""
    if _KEPT:
        _KEPT.clear()
        release()


def release() -> None:
    """Give memory that is free again back to the system, so that workers that wait for their next task hold none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the text in `column` reaches `limit` bytes."""
    texts = batch.column(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Apply `fn` to slices of `df[columns]`; the last column must be the text."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(columns) - 1, limit):
                yield fn(part)
        release()

    return df.select(*columns).mapInArrow(run, schema)
