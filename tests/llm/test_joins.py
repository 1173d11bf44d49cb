"""Near-duplicate operators, filters, searches, mixture and pipeline against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lontar.llm import anisotropic, batches, bit_sliced, blocks, graph, jaccard_join, language_spans, mixture, oracle, queries, substring_dedup, url_cascade
from lontar.llm.blocks import usable

from ..compare import database, same
from . import brute


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def fixture(spark, sf_dir):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghij") + str(rnd.randrange(50)) for _ in range(120)]
    extra = [(None, None), (None, "x y"), (-1, ""), (-2, "a b"), (-3, "A b"), (-4, "x " * 100), (-5, "z " * 35), (-5, "z " * 35), (-6, " ".join(rnd.choice("ab") for _ in range(300)))]
    for i in range(150):
        copy = base[:]
        for _ in range(rnd.randrange(8)):
            copy[rnd.randrange(120)] = f"q{rnd.randrange(10**6)}"
        extra.append((-100 - i, " ".join(copy)))
    line = "the quick brown fox jumps over lazy dogs again"
    extra += [(-1000 - i, line + " " + " ".join(f"w{rnd.randrange(8)}" for _ in range(rnd.randrange(6)))) for i in range(150)]
    extra += [(-2000 - i, " ".join(base[:40] + [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(60))])) for i in range(60)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    return docs.select("doc_id", "text", F.lit(1).alias("row"), F.lit("c").alias("class"), F.lit(9).alias("n"), F.lit(0).alias("anchor"))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return fixture(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("hot", [substring_dedup.HOT_PLACES, 2])
def test_substring_dedup(docs, plain, hot):
    got = substring_dedup.remove_repeats(docs, hot_places=hot)
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.removals(plain, 35), key=repr)


def test_substring_factors_and_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a  b\n" + passage, "s"), (2, passage + " c", "t"), (3, "own  words", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, with_text=True, keep=("source",)).collect()}
    assert got[1]["kept"] == "a b" and got[2]["kept"] == "c" and got[3]["kept"] == "own  words" and got[3]["rest"]["source"] == "u"
    assert all(f["end"] - f["start"] >= 35 for i in (1, 2) for f in got[i]["factors"]) and got[3]["factors"] == []
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("short", "block", "rounds", "bits"), [(jaccard_join.SHORT, jaccard_join.BLOCK, 2, 64), (2, 5, 1, 64), (4, 30, 0, 12)])
def test_jaccard_join(docs, plain, short, block, rounds, bits, monkeypatch):
    """Lists of all lengths, groups in one and in many blocks, and list names that collide."""
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "LEADERS", 3 * block)
    assert as_rows(jaccard_join.link_components(docs, token_bits=bits), "doc_id", "n_shingles", "component_id") == sorted(brute.link_components(plain), key=repr)


def test_prefixes_of_linked_sets_meet():
    """The rule itself, on random sets around the threshold, under every order and any choice of last tokens."""
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64))
        kept = a[rng.random(len(a)) < rng.uniform(0.7, 1)]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, 1 + len(a) // 4)).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        last = np.unique(rng.choice(a, rng.integers(0, len(a) + 1), replace=False))
        if jaccard_join.reaches(both, len(a), len(b), 75):
            linked += 1
            assert all(len(np.intersect1d(jaccard_join.prefix(a, k, last, 75), jaccard_join.prefix(b, k, last, 75))) for k in range(3))
            for width in (jaccard_join.COARSE, jaccard_join.FINE):
                maps = [[jaccard_join.parities(x, width)] for x in (a, b)]
                assert jaccard_join.open_pairs(*maps, np.array([len(a)]), np.array([len(b)]), 75).all()
    assert linked > 50


@pytest.mark.parametrize("order", [0, jaccard_join.ORDERS])
def test_lists_give_few_pairs_and_all_links(spark, order):
    rng = np.random.default_rng(5)
    sets, shared = [], rng.integers(0, 2**64, 60, np.uint64)
    for _ in range(60):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 2**64, n, np.uint64)
        for _ in range(4):
            keep = base[rng.random(n) < rng.choice([0.8, 0.9, 0.97, 1])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, n // 6 + 1)), np.uint64), rng.integers(0, 200, 2).astype(np.uint64)])))
    alone = len(sets)
    sets += [np.unique(np.concatenate([rng.integers(0, 2**64, 100, np.uint64), shared[rng.integers(0, 60, 6)]])) for _ in range(60)]
    last = np.sort(rng.choice(np.concatenate(sets[:alone]), 40))
    firsts = [jaccard_join.prefix(s, order, last, 75) for s in sets]
    rows = [(c, len(s), f.view(np.int64).tolist(), jaccard_join.prefix_end(f, order, last)) for c, (s, f) in enumerate(zip(sets, firsts, strict=True))]
    lists = jaccard_join._Lists(spark.createDataFrame(rows, "c long, n long, tokens array<long>, end int"))
    assert lists.long.isEmpty()
    pairs = {tuple(r) for r in lists.pairs(75).collect()}
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    linked = {(a, b) for (a, b), k in both.items() if jaccard_join.reaches(k, len(sets[a]), len(sets[b]), 75)}
    met = {(a, b) for a, b in both if len(np.intersect1d(firsts[a], firsts[b])) and 4 * len(sets[a]) >= 3 * len(sets[b]) and 4 * len(sets[b]) >= 3 * len(sets[a])}
    assert linked and linked <= pairs <= met
    # Sets of tokens that mostly stand nowhere else.
    apart = {(a, b) for a, b in met if a >= alone}
    assert len(apart) > 50 and len(pairs & apart) < len(apart) / 4


def test_exact_sets_tell_words_apart():
    texts = ["a b c d e f", "A b  c d\ne f", "a b", "b a", "", "a b c d e x"]
    got = jaccard_join.exact_sets([t.encode() for t in texts])
    want = [brute.shingles(t) for t in texts]
    for x, p in zip(got, want, strict=True):
        for y, q in zip(got, want, strict=True):
            assert len(np.intersect1d(x, y)) == len(p & q)


def test_bitmaps_are_not_broadcast(docs, monkeypatch):
    """What grows with the classes of long lists stays off the driver."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.dtypes) or broadcast(df))
    assert jaccard_join.link_components(docs).count() == docs.count()
    assert sent and not [c for columns in sent for c, kind in columns if kind == "binary"]


@pytest.mark.parametrize(("of", "column"), [(jaccard_join, "token"), (substring_dedup, "anchor")])
def test_filters_take_one_worker_a_task(spark, docs, of, column, monkeypatch):
    """The hashes of a filter are made in the pass that sets its bits."""
    plans, collected = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collected(df))
    if of is jaccard_join:
        rows = [(c, 3, [c % 5, 7, -c - 1], 1) for c in range(20)]
        jaccard_join._Lists(spark.createDataFrame(rows, "c long, n long, tokens array<long>, end int"))
    else:
        substring_dedup._index(docs.select(F.struct(F.col("doc_id").alias("r1"), F.lit(0).cast("long").alias("r2")).alias("row"), "text"), 35, substring_dedup.HOT_PLACES)
    assert [plan.count("MapInArrow") for plan in plans] == [1]


def test_learning_lets_go_of_other_memories(monkeypatch):
    monkeypatch.setattr(batches, "_KEPT", {"codec": object()})
    words = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["one two", "three"])], names=["lang", "text"])
    found = pa.Table.from_batches(language_spans._counted(iter([words])))
    assert found.num_rows and not batches._KEPT


def test_jaccard_empty(docs):
    assert jaccard_join.link_components(docs.limit(0)).count() == 0


def test_open_blocks_lose_no_link(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < rng.uniform(0.1, 1)], rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)])) for _ in range(120)]
    bits, n = [jaccard_join.parities(s) for s in sets], np.array([len(s) for s in sets])
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4096)
    i, j = jaccard_join.open_block(bits[:50], bits[50:], n[:50], n[50:], 75)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(found) == len(i) < 50 * 70
    for i, a in enumerate(sets[:50]):
        for j, b in enumerate(sets[50:]):
            assert ((i, j) in found) == (100 * len(a) >= 75 * len(b) and 100 * len(b) >= 75 * len(a) and bool(jaccard_join.open_pairs([bits[i]], [bits[50 + j]], n[i : i + 1], n[50 + j : 51 + j], 75)[0]))
            if jaccard_join.reaches(len(np.intersect1d(a, b)), len(a), len(b), 75):
                assert (i, j) in found


@pytest.mark.parametrize("most", [graph.TASK_EDGES, 10])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_mixture_sql(spark, sf_dir):
    con = database(sf_dir)
    same(queries.op8_mixture(spark, sf_dir), con, oracle.ORACLE_SQL["op8_mixture"])
    odd = mixture.PRODUCTION | {"budget_percent": 150, "max_epochs": 2, "weights": {"domain": {"web": 9, "books": 0}, "lang": {"en": 0}}}
    got = mixture.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), **odd).select("row.doc_id", "at.*", "n_tokens", "copies")
    same(got, con, oracle.mixture_sql(weights=odd["weights"], budget_percent=150))


def test_mixture_edges(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, "x y", None, "s"), (4, "w " * 20000, "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("domain", F.lit("own"))
    full = mixture.mix(docs, mixture.WEIGHTS, 100, 1, 3).collect()
    assert sum(r["n_tokens"] for r in full) == 20008 and len(full) == 6
    assert all(r["row"]["n_tokens"] == "clash" and r["row"]["domain"] == "own" and r["at"]["domain"] == "other" for r in full)
    assert mixture.mix(docs.limit(0), **mixture.PRODUCTION).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = [("d1", "x", "a", 10), ("d1", "x", "b", 1000), ("d1", "y", "c", 1000), ("d2", "x", "e", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").withColumn("capacity", F.col("tokens"))
    got = {r["source"]: r["budget"] for r in mixture.budgets(df, {}, F.lit(800)).collect()}
    # Each domain gets 400, each language of d1 200; what a lacks goes to b.
    assert got == {"a": 10, "b": 190, "c": 200, "e": 400}


def test_url_sql(spark, sf_dir):
    same(queries.op5_url_filter(spark, sf_dir), database(sf_dir), oracle.ORACLE_SQL["op5_url_filter"])


def test_url_edges(spark):
    rows = [(1, None), (2, "x"), (3, "http://WWW.Example.com/en/x?y"), (4, "http://a.net/fr/"), (5, "http://spam-farm.example.org"), (6, "ftp://casino-win.example.net/es"), (7, "http:///"), (7, "http:///"), (None, "a://b://c.com/"), (8, "https://notexample.com/en/"), (9, "http://example.com?x=/en/"), (10, "http://a.com/" + "x/" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(pages).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "a.net", "/fr/", "net/fr/", "block"),
        (5, "spam-farm.example.org", "", None, "block"), (6, "casino-win.example.net", "/es", None, "block"), (7, "", "/", None, "allow"), (None, "b:", "//c.com/", None, "allow"),
        (8, "notexample.com", "/en/", "com/", "allow"), (9, "example.com", "", None, "allow"), (10, "a.com", "/" + "x/" * 200_000, "com/", "allow"),
    }
    assert url_cascade.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [url_cascade.bloom.MAX_BITS, 4096])
def test_cascade_is_exact(spark, most, monkeypatch):
    """In one part and in several; small levels also split those of false positives."""
    monkeypatch.setattr(url_cascade.bloom, "MAX_BITS", most)
    keys = spark.range(8000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("crc32(key) % 7 = 0").union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    cascades = url_cascade.build_cascades(keys, listed)
    assert len(cascades[0].bits) > 1 and (len(cascades) == 1) == (most > 4096)
    assert all(len(words) * 64 <= most for c in cascades for words in c.bits)
    flagged = url_cascade.flag_keys(keys.groupBy(F.crc32("key") % 10).agg(F.collect_list("key").alias("keys")), "keys", cascades, "inside")
    wrong = flagged.select(F.explode(F.arrays_zip("keys", "inside")).alias("x")).where("x.inside <> (crc32(x.keys) % 7 = 0)")
    assert wrong.count() == 0
    assert url_cascade.build_cascades(keys, listed.limit(0))[0].bits == []


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)) / 3)]
    rows += [(50, rows[3][1]), (500, rows[3][1]), (501, rows[3][1]), (600, [0.0] * 8), (700, None), (800, [float("nan")] + [0.1] * 7), (900, [None] + [0.1] * 7), (None, [0.1] * 8), (1000, [float("inf")] + [0.1] * 7), (1100, [0.5, 0.5]), (1150, [0.5, -0.25]), (1101, [0.25, 0.5])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("score", F.lit(2))


def test_top_products(spark):
    df = vectors(spark)
    rows = [(r["vec_id"], np.floor(np.array(r["embedding"], np.float64) * 1024).astype(int)) for r in df.where(usable("vec_id", "embedding")).collect()]
    want = []
    for q in {i for i, _ in rows if i % 100 == 0}:
        for v in [v for i, v in rows if i == q]:
            best = sorted((-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert as_rows(bit_sliced.top_products(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert bit_sliced.top_products(df.limit(0)).count() == 0


def test_repeated_query_row_is_asked_once(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)] + [(0, rng.normal(size=8).tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = df.dropDuplicates(["vec_id"])
    for search, k in ((bit_sliced.top_products, 10), (anisotropic.nearest, 5)):
        got = as_rows(search(df), "query_id", "rank", "vec_id")
        assert sorted(r[1] for r in got if r[0] == 0) == list(range(1, k + 1))
        assert len({r[2] for r in got if r[0] == 0}) == k
        assert got == as_rows(search(once), "query_id", "rank", "vec_id")


def test_top_products_beyond_64_bits(spark):
    rows = [(0, [1e300, -1.0]), (1, [1e300, 2.0]), (2, [2.0**40, 2.0**40]), (3, [0.5, 0.25]), (100, [2.0**30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = lambda v: [int(x) * 1024 if abs(x) > 2**53 else int(np.floor(x * 1024)) for x in v]
    want = []
    for q in (0, 100):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(exact(v), exact(dict(rows)[q]), strict=True)))), i) for i, v in rows if i != q)
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert as_rows(bit_sliced.top_products(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_bit_sliced_sums():
    rng = np.random.default_rng(0)
    for n, d, low in ((130, 7, 0), (64, 5, 3), (3, 2, 1)):
        x, q = rng.integers(-300, 300, (n, d)), rng.integers(-300, 300, (6, d))
        index = bit_sliced.BitSlicedIndex(x, low)
        near = index.candidates(q, 3, np.full(6, -1))
        for i in range(6):
            best = np.argsort(-(x @ q[i]), kind="stable")[: min(3, n)]
            assert near[i][best].all()
            if low == 0:
                kth = np.sort(x @ q[i])[-min(3, n)]
                assert (near[i] == (x @ q[i] >= kth)).all()


def test_nearest(spark, sf_dir):
    df = vectors(spark)
    got = as_rows(anisotropic.nearest(df, every=50), "query_id", "rank", "vec_id", "score")
    ok = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in df.where(usable("vec_id", "embedding")).collect() if any(r["embedding"])]
    want = {}
    for q, v in ok:
        if q % 50 == 0:
            want[q] = want.get(q, []) + sorted((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
    found = {(r[0], r[2]) for r in got}
    hits = sum((q, i) in found for q, best in want.items() for _, i in best)
    assert hits / sum(map(len, want.values())) >= 0.9 and {r[0] for r in got if r[2] in (1100, 1150)} == {1100, 1150}
    for q, rank, i, score in got:
        assert any(abs(score - (v @ w) / (np.linalg.norm(v) * np.linalg.norm(w))) < 1e-9 for a, v in ok if a == q for b, w in ok if b == i and len(v) == len(w))
    assert anisotropic.nearest(df.limit(0)).count() == 0


def jittered(spark, n: int):
    """The table's vectors with noise, up to `n` rows."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("embedding").collect()
    base = np.array([r["embedding"] for r in rows], np.float64)
    rng = np.random.default_rng(11)
    x = base[rng.integers(0, len(base), n)] + rng.normal(scale=base.std() / 2, size=(n, base.shape[1]))
    return spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(x)), "vec_id long, embedding array<double>")


@pytest.mark.parametrize("rows", [4096, 32768])
def test_recall_on_the_table(spark, rows, monkeypatch):
    """With blocks of full size, where one row of 64 is scored exactly."""
    monkeypatch.setattr(blocks, "LEAST_ROWS", rows)
    table = jittered(spark, rows).cache()
    got = {(r["query_id"], r["vec_id"]) for r in anisotropic.nearest(table).collect()}
    rows = table.select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = anisotropic.unit(np.array([r["embedding"] for r in rows], np.float64))
    asked = np.flatnonzero(ids % 50 == 0)
    cosine = x[asked] @ x.T
    cosine[np.arange(len(asked)), asked] = -2
    best = np.argsort(-cosine, axis=1)[:, :5]
    assert np.mean([(ids[q], ids[j]) in got for q, row in zip(asked, best, strict=True) for j in row]) >= 0.9


def test_anisotropic_loss_beats_the_plain_one():
    rng = np.random.default_rng(3)
    x = anisotropic.unit(rng.normal(size=(2000, 16)))
    shaped = anisotropic.train(x, threshold=0.6)
    parallel = lambda q: np.mean(((x - q.codewords[np.arange(q.codewords.shape[0]), q.encode(x)].reshape(len(x), -1)[:, :16]) * x).sum(axis=1) ** 2)
    isotropic = anisotropic.train(x, threshold=0.0)
    assert parallel(shaped) < parallel(isotropic)


def test_mixture_with_many_null_ids(spark):
    """One key with a third of a leaf's rows is summed before the rows of the ending bucket meet."""
    rows = [(None if i % 3 == 0 else i, f"{'wort ' * (i % 7)}", "de", "a" if i % 2 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = database("/root/testdata/sf0.001")
    con.register("many", docs.toPandas().astype({"doc_id": "Int64"}))
    for percent in (30, 60, 130):
        got = mixture.mix(docs, weights={"source": {"a": 2, "b": 1}}, budget_percent=percent, max_epochs=2, seed=7).select("row.doc_id", "at.domain", "at.lang", "at.source", "n_tokens", "copies")
        same(got, con, oracle.mixture_sql("many", weights={"source": {"a": 2, "b": 1}}, budget_percent=percent))


def test_language_model_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = [language_spans.train(d, rows=60) for d in (docs, docs.repartition(7), docs.orderBy("text").coalesce(1))]
    assert all(np.array_equal(m.table, models[0].table) and m.languages == models[0].languages for m in models)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = language_spans.train(docs.where(~language_spans.held_out(F.col("doc_id"))))
    step = corpus_pipeline.identify_language(spark, docs, sf_dir)
    good = {r["doc_id"] for r in language_spans.identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert {r["doc_id"] for r in step.collect()} == good and step.columns == docs.columns
    kept = corpus_pipeline.drop_near_duplicates(spark, step, sf_dir)
    rows = [(i, t) for i, t in rows if i in good]
    alone = {key for key, _, low in brute.link_components(rows) if key == low}
    assert {r["doc_id"] for r in kept.collect()} == alone and kept.columns == docs.columns
    rows = [(i, t) for i, t in rows if i in alone]
    cut = corpus_pipeline.drop_repeated_passages(spark, kept, sf_dir)
    want = {key: (n - gone, digest) for key, n, gone, digest in brute.removals(rows, 35) if gone < n or n == 0}
    assert {r["doc_id"]: (len(r["text"].split()), brute.sha(" ".join(r["text"].split()))) for r in cut.collect()} == want and cut.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mixed = corpus_pipeline.mix_sources(spark, cut, sf_dir)
    cut.createOrReplaceTempView("cut_docs")
    con = database(sf_dir)
    con.register("cut_docs", cut.toPandas())
    chosen = con.execute(oracle.mixture_sql("cut_docs", max_epochs=1)).fetchall()
    assert {r["doc_id"] for r in mixed.collect()} == {r[0] for r in chosen} and mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in chosen}


def test_pipeline_keeps_one_row_of_each_group(spark, sf_dir):
    rnd = random.Random(5)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    twice, nulls, shared, clean, near = (text() for _ in range(5))
    rows = [(1, twice, "en", "a"), (1, twice, "en", "a"), (1, twice, "en", "a")]
    rows += [(None, nulls, "en", "a"), (None, nulls, "en", "a"), (None, nulls, "de", "a"), (None, nulls, None, "de")]
    rows += [(2, shared, "en", "a"), (7, shared, "en", "a"), (7, clean, "en", "a"), (None, shared, "en", "a")]
    rows += [(9, near, "en", "a"), (8, near + " more", "en", "a"), (8, near, "en", "b"), (10, "", "en", "a"), (10, "", "en", "a"), (None, None, "en", "a")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    fixed = [(1, twice), (None, nulls), (2, shared), (7, clean), (10, ""), (10, ""), (None, None)]
    last = [x for x in got if x not in fixed]
    assert sorted((x for x in got if x in fixed), key=repr) == sorted(fixed, key=repr)
    assert len(last) == 1 and last[0][0] == 8 and kept.columns == docs.columns
    left = corpus_pipeline.drop_repeated_passages(spark, kept, sf_dir)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(((i, t or "") for i, t in got), key=repr)


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_pipeline_stages_keep_columns_of_any_name(spark, sf_dir):
    names = ["kept", "n_words", "_name", "domain", "row", "key", "at", "rest", "copies", "n_tokens", "id", "r1", "class", "packed", "leaf", "score", "a.b"]
    passage = " ".join(f"the house and word{i}" for i in range(12))
    rows = [(1, f"the dog is here and {passage} one", "en", "src0"), (2, f"the cat and the hat is it {passage} two two two", "en", "src0"), (2, "the same id on an other text of words", "en", None), (None, "der hund ist hier und da und dort", "de", "src6"), (None, "der hund ist hier und da und dort", "de", "src6"), (3, None, "en", "src1"), (4, "", None, "src1"), (5, "el perro es de la casa y no", None, "src1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names)).cache()
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert out.columns == docs.columns and got
        assert all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in got for n in names)
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == len(rows)


def test_shuffle_files_go_with_the_steps_that_made_them(spark):
    import time

    def shuffle_files() -> int:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))

    before = shuffle_files()
    edges = spark.range(0, 2000, 1, 8).select(F.col("id").alias("a"), (F.col("id") * 7 % 2000).alias("b"))
    graph.cut(edges.distinct())
    ends = time.monotonic() + 10
    while shuffle_files() > before and time.monotonic() < ends:
        time.sleep(0.2)
    assert shuffle_files() <= before
