"""How far the sources of a language stand from one another, and which terms set a source apart.

Each group (language, source) gives each kept term of its language a share p,
counted in thousand-millionths with one added to every count; two groups differ
by the sum of (p - q)^2 / q over all kept terms.

Terms are counted where the texts are read and once more behind a shuffle by
(language, term).  The terms of a language are dealt to blocks by hash.  A task
has a dense tile of a block, numpy int64, one row a group and one column a
term, works out all pairs of its groups by broadcasting and gives the partial
matrix of sums, and for each group the best terms of the block.  Partial
matrices are summed, best terms merged.

Languages with many sources have their groups dealt to blocks too, and a tile
holds two blocks of groups, so tiles are bounded whatever the numbers of terms
and sources; nothing of the table's size is broadcast or collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.llm.batches import release
from lontar.llm.shared import bound_batches, cut

#: Runs of letters, A-Z made small; every byte beyond ASCII belongs to a letter here.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
#: Terms of a tile and groups of a block, on average; cells that are worked out together.
BLOCK_TERMS, BLOCK_GROUPS, CELLS = 4096, 64, 1 << 20
#: Distinct (group, term) pairs that a task counts before it passes them on.
HELD = 400_000
#: Parts that a language is dealt to where its numbers are joined to its terms.
SALTS = 64


def share(count: np.ndarray | int, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total < 2^63 / 1000, exactly."""
    left = np.asarray(count, np.int64)
    out = np.zeros(np.broadcast(left, total).shape, np.int64)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, total)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so squares fit."""
    return (p - q) ** 2 // q


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of each group, over the texts of one task."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (places, documents) in seen.items():
            terms = list(documents)
            n = len(terms) + 1
            # A row without a term says that the group is there.
            columns = [pa.array([lang] * n), pa.array([source] * n), pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *map(places.__getitem__, terms)], pa.int64()), pa.array([0, *documents.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "documents"])
        seen.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            places, documents = seen.setdefault((lang, source), (Counter(), Counter()))
            before = len(documents)
            terms = TERM.findall(text.as_py().lower())
            places.update(terms)
            documents.update(set(terms))
            held += len(documents) - before
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()
    release()


def _block(column: str, per_block: Column) -> Column:
    return F.pmod(F.xxhash64(column), per_block).cast("int")


def group_terms(docs: DataFrame, least_documents: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Counts of the kept terms: (lang, source, term, n, lang_n, first), and one row without a term for each group.

    `lang_n` is the term's count in the whole language; `first` marks one row of each (lang, term).
    """
    bound_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(_tally, "lang string, source string, term string, n long, documents long")
    # Dealt by (lang, term) once: the sums by source, those by language and the marks need no other shuffle.
    dealt = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    term = Window.partitionBy("lang", "term")
    wide = dealt.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_documents", F.sum("documents").over(term)).withColumn("at", F.row_number().over(term.orderBy("source")))
    kept = wide.where(F.col("term").isNull() | (F.col("lang_documents") >= least_documents))
    return kept.select("lang", "source", "term", "n", "lang_n", (F.col("term").isNotNull() & (F.col("at") == 1)).alias("first"))


def _tile(key: tuple, terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Partial pair sums and best terms of one block of terms, for the pairs (a group of block a, a group of block b)."""
    a_block, b_block = key[1].as_py(), key[2].as_py()
    sources = groups.column("source").to_pylist()
    blocks = groups.column("source_block").to_numpy()
    lang, kept_terms, lang_total, block_terms = (groups.column(c)[0].as_py() for c in ("lang", "terms", "lang_total", "block_terms"))
    row_of = {s: i for i, s in enumerate(sources)}
    totals = groups.column("group_n").to_numpy().astype(np.int64)
    names = terms.column("term").dictionary_encode().combine_chunks() if len(terms) else None
    spelled = [] if names is None else [t.encode() for t in names.dictionary.to_pylist()]
    order = sorted(range(len(spelled)), key=spelled.__getitem__)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    counts = np.zeros((len(sources), len(order)), np.int64)
    lang_counts = np.zeros(len(order), np.int64)
    if len(order):
        column = place[names.indices.to_numpy()]
        counts[np.array([row_of[s] for s in terms.column("source").to_pylist()]), column] = terms.column("n").to_numpy()
        lang_counts[column] = terms.column("lang_n").to_numpy()
    size = np.maximum(totals + kept_terms, 1)
    p, absent, lacking = share(counts + 1, size[:, None]), share(1, size), block_terms - len(order)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def give(source: str, part: str, items: list[str], values: np.ndarray) -> None:
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"] += values.tolist()

    others = np.flatnonzero(blocks == b_block)
    step = max(1, CELLS // max(1, len(order)))
    for i in np.flatnonzero(blocks == a_block):
        for low in range(0, len(others), step):
            j = others[low : low + step]
            sums = distance(p[i][None, :], p[j]).sum(axis=1) + lacking * distance(absent[i], absent[j])
            give(sources[i], "pair", [sources[k] for k in j if k != i], sums[j != i])
    if a_block == b_block and len(order):
        q = share(lang_counts + 1, lang_total + kept_terms)
        for i in np.flatnonzero(blocks == a_block):
            column = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            values = distance(p[i][column], q[column])
            # Columns stand in the order of their terms, which a stable sort keeps among equals.
            best = np.argsort(-values, kind="stable")[:top]
            give(sources[i], "term", [spelled[order[k]].decode() for k in column[best]], values[best])
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def audit_sources(docs: DataFrame, least_documents: int = 3, top_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Distances of all pairs of sources of each language, and each source's most overweight terms.

    Gives (lang, source, part, item, value, rank).  Part `pair` has the distance
    of a group from each other source of its language, every one ranked; part
    `term` the `top_terms` terms that weigh more in the group than in the
    language.  Ties of value are ranked by the item's UTF-8 bytes.

    Null text, language and source count as empty strings, so they are one group
    with empty ones; groups without terms take part with counts of zero; a
    language without kept terms has distances of 0; one with one source has no
    pairs; repeated rows count each time; texts of any length go whole; other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    counts = cut(group_terms(docs, least_documents, lang_col, source_col, text_col))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    whole = counts.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    per = lambda column, size: F.greatest(F.lit(1), F.ceil(F.col(column) / size)).cast("int")
    langs = cut(whole.join(sizes, "lang").select("lang", "terms", "lang_total", per("terms", BLOCK_TERMS).alias("term_blocks"), per("groups", BLOCK_GROUPS).alias("group_blocks")))
    # A language may have a third of all rows: it is dealt to SALTS parts.
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_lang = lambda df, by: df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).withColumn("source_block", _block("source", F.col("group_blocks")))
    # A group takes part as the first of a pair with every block, and as the second with every block but its own.
    mine = F.col("source_block")
    every = F.sequence(F.lit(0), F.col("group_blocks") - 1)
    as_first = F.transform(every, lambda x: F.struct(mine.alias("a"), x.alias("b")))
    as_second = F.transform(F.filter(every, lambda x: x != mine), lambda x: F.struct(x.alias("a"), mine.alias("b")))
    spread = lambda df: df.withColumn("spot", F.explode(F.concat(as_first, as_second))).select("*", "spot.a", "spot.b")
    placed = with_lang(counts.where(F.col("term").isNotNull()), "term").withColumn("term_block", _block("term", F.col("term_blocks")))
    terms = spread(placed)
    # A tile of two blocks of groups lacks terms that none of these groups has.
    block_sizes = placed.where("first").groupBy("lang", "term_block").agg(F.count(F.lit(1)).alias("block_terms")).toDF("lang", "term_block", "block_terms")
    by_block = with_lang(groups, "source").withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    tiled = spread(by_block.join(block_sizes, ["lang", "term_block"], "left").fillna(0, ["block_terms"]))
    keys = ["lang", "a", "b", "term_block"]
    left = terms.select(*keys, "source", "term", "n", "lang_n")
    # Renamed, as both sides come from the same columns.
    of_group = ["source", "source_block", "group_n", "terms", "lang_total", "block_terms"]
    right = tiled.select(*keys, *of_group).toDF(*keys, *of_group)
    schema = "lang string, source string, part string, item string, value long"

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda key, mine, whole: _tile(key, mine, whole, top_terms), schema)
    sums = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
