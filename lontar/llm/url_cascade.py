"""URL filters on a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys, level 1 one of the keys of the
corpus that pass level 0 without being listed, level 2 one of the listed keys
that pass level 1, and so on until a level lets nothing wrong through.  As the
levels were built over every key of the corpus, a key of the corpus is listed
exactly if the first level that it fails has an odd number (or it fails none
and the last level has an even one): membership needs no join.

Level 0 has the more hash functions the more keys the corpus has for each listed
one, so that about as many keys pass it wrongly as are listed: all levels
together stay in proportion to the list.  A list that would need a level beyond
bloom.MAX_BITS is split by key hash; each part has a cascade of its own, and the
keys of the corpus pass the parts one after another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm import bloom
from lontar.llm.shared import cut

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Hosts that are blocked where no rule speaks.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_column(url: Column) -> Column:
    """Host as written between the first :// and the path, A-Z lower-cased; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """Path after the host, up to the query or fragment; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, listed: list[tuple[str, str]]) -> Column:
    """Keys host suffix + path prefix in the shapes that the listed keys have.

    A suffix begins at a label; only label counts and path lengths that occur
    among the listed keys are made, so their number is fixed by the list.
    """
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in listed})
    labels = F.split(host, r"\.", -1)
    made = [
        F.when((host != "") & (F.size(labels) >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in shapes
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


class Cascade:
    """Levels of Bloom filters; `bits[i]` are the words of level i, `hashes[i]` its number of hash functions."""

    def __init__(self, bits: list[np.ndarray], hashes: list[int]):
        self.bits, self.hashes = bits, hashes

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        decided, listed = np.zeros(len(h1), bool), np.zeros(len(h1), bool)
        for level, (words, hashes) in enumerate(zip(self.bits, self.hashes, strict=True)):
            fails = ~decided & ~bloom.passes(words, h1, h2, level, hashes)
            listed |= fails & bool(level % 2)
            decided |= fails
        return listed | (~decided & bool(len(self.bits) % 2))


def _hashed(keys: DataFrame, parts: int) -> DataFrame:
    part = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(parts)).cast("int")
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), part.alias("part"))


def _passing(words: Broadcast, level: int, hashes: int):
    """Function of the two hashes: whether a key passes this level."""

    @F.arrow_udf("boolean")
    def passes(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(bloom.passes(words.value, *(np.asarray(h).view(np.uint64) for h in (h1, h2)), level, hashes))

    return passes


def _cascade(universe: DataFrame, listed: DataFrame, first: int) -> Cascade | None:
    """Cascade of one part; None if a level would exceed bloom.MAX_BITS."""
    n = listed.count()
    bits: list[np.ndarray] = []
    hashes: list[int] = []
    encoded, other = listed, None
    while n:
        level = len(bits)
        k = bloom.HASHES if level else first
        if bloom.bits_for(n, k) > bloom.MAX_BITS:
            return None
        bits.append(bloom.build(encoded, n, level, k))
        hashes.append(k)
        passes = _passing(listed.sparkSession.sparkContext.broadcast(bits[-1]), level, k)
        if other is None:
            # Most keys fail level 0, so only the few others are told apart and held against the list.
            wrong = universe.where(passes("h1", "h2")).distinct().join(listed.select("key"), "key", "left_anti")
        else:
            wrong = other.where(passes("h1", "h2"))
        wrong = cut(wrong)
        n = wrong.count()
        encoded, other = wrong, encoded
    return Cascade(bits, hashes)


def build_cascades(universe: DataFrame, listed: DataFrame) -> list[Cascade]:
    """Cascades of the column `key` of `listed`, exact for every `key` of `universe`: one for each part by key hash.

    Nulls and repeated keys on either side are ignored.  An empty list gives one
    cascade without listed keys.
    """
    keys = cut(listed.where("key IS NOT NULL").select("key").distinct())
    universe = universe.where("key IS NOT NULL").select("key")
    n = keys.count()
    if n == 0:
        return [Cascade([], [])]
    first = max(bloom.HASHES, math.ceil(math.log2(max(1, universe.count()) / n) + 0.5))
    parts = -(-bloom.bits_for(n, first) // bloom.MAX_BITS)
    while True:
        some, all_ = _hashed(keys, parts), _hashed(universe, parts)
        built = []
        for part in range(parts):
            built.append(_cascade(all_.where(F.col("part") == part), cut(some.where(F.col("part") == part)), first))
            if built[-1] is None:
                break
        if built[-1] is not None:
            return built
        parts *= 2


def flag_keys(df: DataFrame, keys: str, cascades: list[Cascade], out: str) -> DataFrame:
    """Add `out`, an array of whether each element of the array column `keys` is listed."""

    def flags_of(part: int, levels: Broadcast):
        @F.arrow_udf("array<boolean>")
        def flags(h1: pa.Array, h2: pa.Array, parts: pa.Array) -> pa.Array:
            a, b, of = (h.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2, parts))
            inside = levels.value.contains(a, b) & (of == part)
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(h1), 0))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(inside))

        return flags

    parts = len(cascades)
    hashes = [F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(k, F.lit(1))), F.transform(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(2)), F.lit(parts)))]
    for part, cascade in enumerate(cascades):
        found = flags_of(part, df.sparkSession.sparkContext.broadcast(cascade))(*hashes)
        # One part's filters are on the executors at a time.
        df = cut(df.withColumn(out, F.zip_with(out, found, lambda x, y: x | y))) if part else df.withColumn(out, found)
    return df


def judge_urls(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row's URL.

    Null URLs and those without :// have an empty host and path, fit no rule and
    are allowed.  Rows with repeated or null ids or URLs each give a row; an
    empty table gives none.  URLs of any length go whole; columns other than id
    and URL are not read, so their names do no harm.
    """
    spark = pages.sparkSession
    url = F.col("url")
    parts = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")).select(id_col, host_column(url).alias("host"), path_column(url).alias("path"))
    named = [(h, p) for h, p, _ in rules]
    lists = {
        "allow": [h + p for h, p, v in rules if v == "allow"],
        "block": [h + p for h, p, v in rules if v == "block"],
        "blocked": [f"{h}/" for h in blocked_hosts],
    }
    # A blocked host is looked up as host + "/", whatever the path.
    keyed = parts.withColumn("rule_keys", candidate_keys(F.col("host"), F.col("path"), named)).withColumn(
        "host_keys", candidate_keys(F.col("host"), F.lit("/"), [(h, "/") for h in blocked_hosts])
    )
    universe = {"allow": "rule_keys", "block": "rule_keys", "blocked": "host_keys"}
    for name, keys in lists.items():
        listed = spark.createDataFrame([(k,) for k in keys], "key string")
        cascades = build_cascades(keyed.select(F.explode(universe[name]).alias("key")), listed)
        keyed = flag_keys(keyed, universe[name], cascades, f"in_{name}")
    hits = F.filter(
        F.transform("rule_keys", lambda k, i: F.struct(F.length(k).alias("n"), k.alias("key"), F.get("in_allow", i).alias("allow"), F.get("in_block", i).alias("block"))),
        lambda s: s["allow"] | s["block"],
    )
    best = F.array_max(hits)
    return keyed.withColumn("best", best).select(
        id_col,
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.when(F.col("best").isNotNull(), F.when(F.col("best.allow"), "allow").otherwise("block")).when(F.exists("in_blocked", lambda x: x), "block").otherwise("allow").alias("verdict"),
    )
