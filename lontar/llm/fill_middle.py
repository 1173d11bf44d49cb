"""Fill-in-the-middle transformation of whole texts by overlapping-chunk decomposition.

A text is n units: white space with the word behind it, or white space at the
end.  A unit ends where a character that is no white space stands before one
that is, so whether there is an end between two characters depends on these two
alone.  White space is ASCII here, so characters may be read as UTF-8 bytes.

The texts of an Arrow batch lie in one buffer.  It is cut into chunks that each
read one byte of the chunk before them; every chunk counts its unit ends and its
code points; prefix sums of the counts say in which chunk the end of a given
unit lies, and only that chunk is read again to find the place.  No list of
units is made, and memory is bounded by the window of chunks read together, not
by the longest text.  The texts stay in the JVM: Python gives back three numbers
a row, and cutting, digests and the way back are built-in functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.shared import bound_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and bytes of chunks that are looked at together.
CHUNK_BYTES, WINDOW_BYTES = 1 << 14, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Chunks:
    """Counts of unit ends and code points in the chunks of a batch of texts, and the way from a rank to its place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES):
        self.data, self.offsets = data, offsets
        lengths = np.diff(offsets)
        of_text = -(-lengths // chunk_bytes)
        #: First chunk of each text, and one behind the last text.
        self.first = np.concatenate([[0], np.cumsum(of_text)])
        text = np.repeat(np.arange(len(lengths)), of_text)
        self.starts = offsets[:-1][text] + (np.arange(len(text)) - self.first[:-1][text]) * chunk_bytes
        self.stops = np.minimum(self.starts + chunk_bytes, offsets[1:][text])
        ends, points = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        heads = np.diff(text, prepend=-1) != 0
        low = 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(self.stops, self.starts[low] + WINDOW_BYTES, "right")))
            start, stop = self.starts[low], self.stops[high - 1]
            at = self.starts[low:high] - start
            ends[low:high] = np.add.reduceat(self._ends(start, stop, at[heads[low:high]]), at, dtype=np.int64)
            points[low:high] = np.add.reduceat(self._points(start, stop), at, dtype=np.int64)
            low = high
        #: Unit ends and code points before each chunk.
        self.ends, self.points = np.concatenate([[0], np.cumsum(ends)]), np.concatenate([[0], np.cumsum(points)])
        inner = self.ends[self.first[1:]] - self.ends[self.first[:-1]]
        #: Units of each text: one more than its inner ends.
        self.units = inner + (lengths > 0)

    def _ends(self, start: int, stop: int, heads: np.ndarray) -> np.ndarray:
        """Whether a unit ends before each byte of [start, stop); `heads` are places where a text begins."""
        before = max(start - 1, 0)
        space = _SPACE[self.data[before:stop]]
        ends = np.zeros(stop - start, bool)
        ends[before + 1 - start :] = space[1:] & ~space[:-1]
        ends[heads] = False
        return ends

    def _points(self, start: int, stop: int) -> np.ndarray:
        return (self.data[start:stop] & 0xC0) != 0x80

    def code_points(self, text: int, rank: int) -> int:
        """Code points of a text up to the end of its unit number `rank` (0: none)."""
        first, behind = self.first[text], self.first[text + 1]
        if rank <= 0:
            return 0
        if rank >= self.units[text]:
            return int(self.points[behind] - self.points[first])
        wanted = self.ends[first] + rank
        k = int(np.searchsorted(self.ends[first + 1 : behind + 1], wanted)) + first
        start, stop = self.starts[k], self.stops[k]
        ends = self._ends(start, stop, np.zeros(1 if k == first else 0, np.int64))
        place = np.flatnonzero(ends)[wanted - self.ends[k] - 1]
        return int(self.points[k] - self.points[first] + self._points(start, start + place).sum())


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls and where each text begins."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def find_cuts(texts: pa.Array, moving: pa.Array, h1: pa.Array, h2: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> pa.Array:
    """(units, code points of the prefix, code points of the middle) of each text; the last two null where nothing moves."""
    if not len(texts):
        return pa.array([], pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]))
    chunks = Chunks(*_buffer(texts), chunk_bytes)
    prefix: list[int | None] = [None] * len(texts)
    middle: list[int | None] = [None] * len(texts)
    n = chunks.units
    # (h1, h2) come as numbers below 2^32.
    a, b = h1.to_numpy(zero_copy_only=False) % (n + 1), h2.to_numpy(zero_copy_only=False) % (n + 1)
    for i in np.flatnonzero(moving.to_numpy(zero_copy_only=False)):
        prefix[i] = chunks.code_points(i, min(a[i], b[i]))
        middle[i] = chunks.code_points(i, max(a[i], b[i])) - prefix[i]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], ["n", "prefix_chars", "middle_chars"])


def _find_cuts(texts: pa.Array, moving: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    return find_cuts(texts, moving, h1, h2)


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed text was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Move the middle of texts behind their ends: (id, n, form, prefix_chars, middle_chars, output).

    `rate` per cent of the rows are transformed, `spm_rate` per cent of these
    with the suffix first; cuts and forms follow from a digest of seed and id
    alone, so they are the same on every run and any partitioning.

    Null texts count as empty, and empty ones and those that hold a marker stay
    plain; texts of white space alone are one unit; texts of any length go
    whole; a null id is hashed as an empty string; rows with the same id each
    give a row; both cuts may fall together, which leaves an empty middle; only
    id and text are read, so other columns cannot clash; an empty table gives
    no rows.
    """
    bound_batches(docs.sparkSession)
    cuts = F.arrow_udf(_find_cuts, "struct<n: bigint, prefix_chars: bigint, middle_chars: bigint>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    text = F.col("text")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest).withColumn("form", form)
    cut = rows.withColumn("cut", cuts("text", F.col("form") != "plain", h[0], h[1])).select("id", "text", "form", "cut.*")
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    start, middle, end = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m), F.substring(text, p + m + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), start, F.lit(SUFFIX), end, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), end, F.lit(PREFIX), start, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def transform_digests(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """`transform` with digests of the output and of the text that `restore` rebuilds from it, in the same cases."""
    moved = transform(docs, rate, spm_rate, seed)
    back = restore(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
