"""Removal of passages that stand more than once, by relative Lempel-Ziv parsing.

Reference blocks.  Every run of WINDOW words has one anchor: its SEED-word run
with the least hash.  The windows of one anchor overlap in one block of text,
and equal windows have equal anchors at the same distance, wherever they stand;
so a text falls into the same blocks in every document that holds it.  All
blocks of all documents are indexed by (anchor, block) hash with a count and the
first place, the reference.

Factors.  A document is parsed greedily from left to right: a factor grows as
long as the next block is found in the index (count of two or more) and its
reference goes on in the same row.  Every window inside a factor stands
elsewhere as well, so factors become duplicate spans.

Boundaries.  Where a block is found only in part (its anchor stands elsewhere,
in another block), which happens where factors begin and end, each of its
windows is looked up alone, against the windows of the differing blocks with
the same anchor.  Together that finds exactly the windows that start anywhere
else.

Scale: about one block per 14 words is made, as fixed-width hashes.  Anchors are
counted first, combined before the shuffle; a Bloom filter of those that stand
more than once keeps all other blocks out of the second shuffle.  Anchors that
stand very often are counted by (anchor, block), again combined before the
shuffle, so a passage that a third of all documents share is no hot key.  Texts
are shuffled once, compressed.  Nothing but the filter's bits reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.llm import bloom
from lontar.llm.batches import forget, release, slices
from lontar.llm.shared import bound_batches, cut
from lontar.llm.wordhash import mix, run_hashes, sliding_argmin, word_hashes

#: Words of a window: a shorter repeat stays.
WINDOW = 35
#: Words of an anchor.
SEED = 8
#: Places of an anchor from which it counts as hot, or the share of all places that leaves at most HOT_ANCHORS such.
HOT_PLACES, HOT_ANCHORS = 1 << 16, 1 << 20
#: Rows of a lookup that is broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1 << 20

#: Factors of the two content hashes of a block.
_FACTORS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_BASE = np.uint64(_FACTORS[0])
#: Bits of a block's length and of its anchor's distance in `place`.
_BITS = 16
_LOW = (1 << _BITS) - 1
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(text: str | None) -> bytes:
    raw = (text or "").encode()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(packed: bytes) -> bytes:
    return _CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def blocks(words: np.ndarray, firsts: np.ndarray, window: int = WINDOW, seed: int = SEED) -> dict[str, np.ndarray]:
    """Blocks of all texts of a slice: text index, first window start, further windows, anchor distance and hashes."""
    seeds = run_hashes(words, seed)
    anchors = sliding_argmin(seeds, window - seed + 1)
    lengths = np.diff(firsts)
    text = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.arange(len(anchors))
    starts = starts[text[starts] == text[starts + window - 1]] if len(starts) else starts
    if not len(starts):
        return {k: np.empty(0, np.int64) for k in ("text", "start", "more", "distance", "anchor", "block", "check")}
    at = anchors[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[starts[1:]] != text[starts[:-1]])]))
    low, high = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    anchor = at[new]
    shape = ((anchor - low) << _BITS | high - low).astype(np.uint64)
    hashes = []
    for factor in _FACTORS:
        powers = np.cumprod(np.full(len(words) + 1, np.uint64(factor)))
        inverse = np.cumprod(np.full(len(words) + 1, np.uint64(pow(factor, -1, 2**64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])])
        hashes.append(mix((sums[high + window] - sums[low]) * inverse[low] + mix(shape + np.uint64(1))).view(np.int64))
    return {
        "text": text[low],
        "start": low - firsts[text[low]],
        "more": high - low,
        "distance": anchor - low,
        "anchor": seeds[anchor].view(np.int64),
        "block": hashes[0],
        "check": hashes[1],
    }


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that name a row; equal rows have equal keys."""
    columns = F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull()
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns[::-1])


def _block_rows(docs: DataFrame, window: int, filter_words: Broadcast | None = None) -> DataFrame:
    """(row, anchor, block, check, place) of every block, or of those whose anchor passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, 1):
                found = blocks(*word_hashes(part.column(1)), window)
                if filter_words is not None:
                    kept = np.flatnonzero(bloom.passes(filter_words.value, *_two_hashes(found["anchor"])))
                    found = {k: v[kept] for k, v in found.items()}
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(found["text"])), pa.array(found["anchor"]), pa.array(found["block"]), pa.array(found["check"]), pa.array((found["start"] << 2 * _BITS | found["more"] << _BITS | found["distance"]).astype(np.int64))],
                    names=["row", "anchor", "block", "check", "place"],
                )
        release()

    return docs.mapInArrow(run, f"row {_ROW}, anchor long, block long, check long, place long")


def _two_hashes(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = anchors.astype(np.int64).view(np.uint64)
    return h, mix(h + _BASE)


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is short enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _index(source: DataFrame, window: int, hot_places: int) -> DataFrame:
    """Blocks whose anchor stands more than once: (row, place, anchor, n, c, ref).

    n and c count the anchor's places and those of the block; ref is the block's first place.
    """
    shared = cut(_block_rows(source, window).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    keys, places = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = None
    if bloom.bits_for(keys) <= bloom.MAX_BITS:
        words = source.sparkSession.sparkContext.broadcast(bloom.build(shared.select("anchor"), keys, two_hashes=_two_hashes))
    found = _block_rows(source, window, words)
    if words is None:
        found = found.join(shared.select("anchor"), "anchor", "left_semi")
    hot = shared.where(F.col("n") > max(hot_places, places // HOT_ANCHORS))
    first = F.min(F.struct("row", "place"))
    if hot.isEmpty():
        cold, often = found, None
    else:
        cold = found.join(F.broadcast(hot.select("anchor")), "anchor", "left_anti")
        those = found.join(F.broadcast(hot), "anchor")
        counts = cut(those.groupBy("anchor", "block", "check").agg(F.count(F.lit(1)).alias("c"), first.alias("ref")))
        often = those.join(_few(counts), ["anchor", "block", "check"])
    by_anchor, by_block = W.partitionBy("anchor"), W.partitionBy("anchor", "block", "check")
    met = cold.withColumn("n", F.count(F.lit(1)).over(by_anchor)).where("n > 1")
    met = met.withColumn("c", F.count(F.lit(1)).over(by_block)).withColumn("ref", first.over(by_block))
    columns = ["row", "place", "anchor", "n", "c", "ref"]
    return met.select(*columns) if often is None else met.select(*columns).unionByName(often.select(*columns))


def _parse(runs: list[dict] | None, window: int) -> list[tuple[int, int, dict, int]]:
    """Greedy factors (start, end, reference row, reference start)."""
    factors: list[tuple[int, int, dict, int]] = []
    for r in sorted(runs or (), key=lambda r: r["place"]):
        start, more = r["place"] >> 2 * _BITS, r["place"] >> _BITS & _LOW
        end, ref_start = start + more + window, r["ref_place"] >> 2 * _BITS
        if factors:
            s, e, row, ref = factors[-1]
            if start <= e and row == r["ref_row"] and ref_start - ref == start - s:
                factors[-1] = (s, end, row, ref)
                continue
        factors.append((start, end, r["ref_row"], ref_start))
    return factors


def _remove(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space)."""
    words = raw.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e in spans:
        gone[s] += 1
        gone[e] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
    return len(words), len(words) - len(kept), b" ".join(kept)


#: Type of the key of a row.
_ROW = "struct<r1:long,r2:long>"
_FACTOR = f"struct<start:long,end:long,ref_row:{_ROW},ref_start:long>"
_FACTORS_KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref_row", pa.struct([("r1", pa.int64()), ("r2", pa.int64())])), ("ref_start", pa.int64())]))
_DONE = "row {row}, id long, rest boolean, packed binary, n_words long, n_removed long, kept binary, kept_sha256 string, factors array<{factor}>, todo array<struct<place:long,anchor:long>>"
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string(), _FACTORS_KIND, pa.list_(pa.struct([("place", pa.int64()), ("anchor", pa.int64())]))]
#: What the last step reads and what it returns.
_OPEN = ("packed", "n_words", "n_removed", "kept", "kept_sha256", "factors", "starts")
_FINAL = ("n_words", "n_removed", "kept", "kept_sha256", "factors")
_FINAL_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), _FACTORS_KIND]
_NAMES = ["row", "id", "rest", "packed", "n_words", "n_removed", "kept", "kept_sha256", "factors", "todo"]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: tuple[str, ...] = (), hot_places: int = HOT_PLACES) -> DataFrame:
    """Take out every word covered by a window of words that also starts anywhere else.

    Returns id, n_words, n_removed, kept_sha256, factors and, with `with_text`,
    `kept`: the text with the kept words joined by one space (the text as it is
    where nothing goes).  Columns named in `keep` come along in the struct `rest`,
    so that no name clashes; others are not read.  Null and empty texts have no
    words.  Rows with repeated or null ids each give a row; a row that stands
    twice repeats itself, so its windows go.  Texts under `window` words stay;
    texts of any length go whole.  An empty table gives none.
    """
    if not SEED <= window <= _LOW:
        raise ValueError(f"a window has {SEED} to {_LOW} words")
    bound_batches(docs.sparkSession)
    rest = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(True)
    source = docs.select(F.struct(*(k.alias(n) for k, n in zip(row_keys(id_col, text_col), ("r1", "r2"), strict=True))).alias("row"), F.col(id_col).alias("id"), rest.alias("rest"), F.col(text_col).alias("text"))
    rest_type = source.schema["rest"].dataType

    def typed(ddl: str) -> T.StructType:
        """The schema with the type of `rest`, whose names may be any."""
        return T.StructType([T.StructField("rest", rest_type) if f.name == "rest" else f for f in T.StructType.fromDDL(ddl).fields])

    done_schema = typed(_DONE.format(row=_ROW, factor=_FACTOR))
    met = _index(source.select("row", "text"), window, hot_places)
    whole = F.col("c") > 1
    # One of the places of a block stands for it where other blocks have its anchor.
    alone = (F.col("n") > F.col("c")) & (F.col("ref.row") == F.col("row")) & (F.col("ref.place") == F.col("place"))
    placed = (
        met.select(
            "row",
            F.when(whole, F.struct("place", F.col("ref.row").alias("ref_row"), F.col("ref.place").alias("ref_place"))).alias("run"),
            F.when(alone, F.struct("place", "anchor")).alias("lookup"),
        )
        .where("run IS NOT NULL OR lookup IS NOT NULL")
        .groupBy("row")
        .agg(F.collect_set("run").alias("runs"), F.collect_set("lookup").alias("todo"))
    )

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([pack(t) for t in part.column(3).to_pylist()], pa.binary())], names=["row", "id", "rest", "packed"])

    packed = source.mapInArrow(packing, typed(f"row {_ROW}, id long, rest boolean, packed binary"))

    def finish(spans: list[tuple[int, int]], factors: list, raw: bytes) -> tuple:
        n, removed, kept = _remove(raw, spans)
        # Texts without spans keep their white space; the digest is of the words in any case.
        return (None, n, removed, pack((kept if removed else raw).decode()) if with_text else None, sha256(kept).hexdigest(), factors, None)

    def as_batch(part: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *made], names=_NAMES)

    def factor_dicts(factors: list[tuple]) -> list[dict]:
        return [dict(zip(("start", "end", "ref_row", "ref_start"), f, strict=True)) for f in factors]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(at, 256)
                for r in part.select([3, 4, 5]).to_pylist():
                    factors = _parse(r["runs"], window)
                    if not r["todo"]:
                        raw = unpack(r["packed"])
                        out.append(finish([f[:2] for f in factors], factor_dicts(factors), raw))
                        continue
                    out.append((r["packed"], None, None, None, None, factor_dicts(factors), r["todo"]))
                yield as_batch(part, out)
        release()

    parsed = cut(packed.join(placed, "row", "left").select("row", "id", "rest", "packed", "runs", "todo").mapInArrow(parse, done_schema))

    def lookups(words: Broadcast | None):
        """Windows of the blocks to look up, or those that pass the filter; the keys hold the anchor, its distance and the words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    rows, keys, checks, starts = [], [], [], []
                    for k, r in enumerate(part.select(["packed", "todo"]).to_pylist()):
                        hashes = word_hashes(pa.array([unpack(r["packed"]).decode()]))[0]
                        place = np.array([t["place"] for t in r["todo"]])
                        n = (place >> _BITS & _LOW) + 1
                        block = np.repeat(np.arange(len(n)), n)
                        step = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
                        start = (place >> 2 * _BITS)[block] + step
                        anchor = mix(np.array([t["anchor"] for t in r["todo"]], np.int64).view(np.uint64))[block]
                        where = anchor * _BASE + ((place & _LOW)[block] - step).astype(np.uint64)
                        keys.append(mix(run_hashes(hashes, window)[start] + where))
                        checks.append(mix(run_hashes(mix(hashes + _BASE), window)[start] + where))
                        rows.append(np.full(len(start), k))
                        starts.append(start)
                    found = [np.concatenate(x) for x in (rows, keys, checks, starts)]
                    if words is not None:
                        kept = np.flatnonzero(bloom.passes(words.value, found[1], found[2]))
                        found = [x[kept] for x in found]
                    columns = [found[1].view(np.int64), found[2].view(np.int64), found[3]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[0])), *(pa.array(c, pa.int64()) for c in columns)], names=["row", "key", "check", "start"])

        return run

    asked, schema = parsed.where("todo IS NOT NULL").select("row", "packed", "todo"), f"row {_ROW}, key long, check long, start long"
    again = cut(asked.mapInArrow(lookups(None), schema).groupBy("key", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "check"))
    n = again.count()
    words = None
    if bloom.bits_for(n) <= bloom.MAX_BITS:
        # Windows that stand once are not shuffled again.
        words = docs.sparkSession.sparkContext.broadcast(bloom.build(again.select(F.col("key").alias("h1"), F.col("check").alias("h2")), n))
    windows = asked.mapInArrow(lookups(words), schema)
    single = windows.join(again, ["key", "check"]).groupBy("row").agg(F.collect_set("start").alias("starts"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Final rows: those done before, and the rest with the windows found alone."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(at, 256)
                for r in part.select(list(_OPEN)).to_pylist():
                    if r["kept_sha256"] is None:
                        spans = [(f["start"], f["end"]) for f in r["factors"]] + [(s, s + window) for s in r["starts"] or ()]
                        r |= dict(zip(_NAMES[3:], finish(spans, r["factors"], unpack(r["packed"])), strict=True))
                    out.append((r["n_words"], r["n_removed"], unpack(r["kept"]).decode() if with_text else None, r["kept_sha256"], r["factors"]))
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _FINAL_KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("rest"), *made], names=["id", "rest", *_FINAL])
        release()

    some = ["id", "rest", *_OPEN[:-1]]
    ended = parsed.where("todo IS NULL").select(*some, F.lit(None).cast("array<bigint>").alias("starts"))
    opened = parsed.where("todo IS NOT NULL").join(single, "row", "left").select(*some, "starts")
    done = ended.unionByName(opened).mapInArrow(close, typed(f"id long, rest boolean, n_words long, n_removed long, kept string, kept_sha256 string, factors array<{_FACTOR}>"))
    columns = [F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "factors", *(["rest"] if keep else [])]
    return done.select(*columns, *(["kept"] if with_text else []))
