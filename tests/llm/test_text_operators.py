"""Licence scan, SentencePiece, language spans and page text on small rows."""

import html as entities
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lontar.llm import language_spans, license_scan, page_text, queries, sentencepiece_codec

from . import brute
from .brute import license_words, sha

EDGE = [(1, None), (2, ""), (3, " \t\n"), (3, "a b"), (None, "a b"), (4, "x" * 100_000), (5, "wort " * 5000)]


def edge(spark):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string")
    # Columns whose names the operators use themselves.
    return rows.select("doc_id", "text", F.lit(1).alias("row"), F.lit("x").alias("score"), F.lit(2).alias("n_words"), F.lit("de").alias("lang"), F.lit(3).alias("ids"))


def test_license_base_against_plain_search():
    rnd = random.Random(1)
    words = " ".join([*license_scan.BASE, *license_scan.TEMPLATES]).split() + ["zz", "é", "7"] * 5
    automaton = license_scan.TemplateAutomaton(license_scan.BASE, license_scan.TEMPLATES)
    for _ in range(400):
        text = " ".join(rnd.choice(words) for _ in range(30)) + ", " + rnd.choice(list(license_scan.BASE)).upper() + "."
        cut = license_scan.words_of(text)
        assert [w.decode() for w in cut] == license_words(text)
        plain = sorted((i, label) for i in range(len(cut)) for p, label in license_scan.BASE.items() if cut[i : i + len(p.split())] == p.encode().split())
        assert sorted(automaton.scan(cut)["base"]) == plain


def test_license_templates():
    automaton = license_scan.TemplateAutomaton(license_scan.BASE, license_scan.TEMPLATES)
    scan = lambda t: automaton.scan(license_scan.words_of(t))
    found = scan("Foo. Licensed under the Apache License, Version 2.0. Bar")
    assert [s[:3] for s in found["spans"]] == [("apache-2.0", 1, 9)] and found["score"] == 1.0
    chained = scan("permission is granted free of charge to any person obtaining a copy of this software and associated documentation files")
    assert [s[0] for s in chained["spans"]] == ["mit"] and 0.75 < chained["score"] < 1
    assert scan("the the of a")["spans"] == [] and scan("")["score"] == 0.0


def test_license_query_against_a_plain_version(spark, sf_dir):
    rnd = random.Random(7)
    texts = [*license_scan.TEXTS, *license_scan.LINES]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for i in range(60):
        words = rnd.choice(texts).split()
        for _ in range(rnd.randrange(12)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randrange(3)] = ["oh"] * rnd.randrange(4)
        rows.append((-i, f"Copyright 2020 by us. {' '.join(words)} {rnd.choice(['CC BY', 'All rights reserved.', ''])} {rnd.choice(texts)}"))
    columns = "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r[c] for c in columns) for r in license_scan.scan_licenses(docs).collect()), key=repr)
    assert got == sorted(brute.license_rows(rows, license_scan.BASE, license_scan.TEMPLATES), key=repr)
    assert {label for r in got if r[0] <= 0 for label in r[6].split(",")} >= {"mit", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "gpl-3.0"}


def test_license_edges(spark):
    rows = license_scan.scan_licenses(edge(spark)).orderBy("doc_id").collect()
    assert len(rows) == len(EDGE) and all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" for r in rows)
    assert license_scan.scan_licenses(edge(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(queries.piece_model_path())


ODD = ["", " a", "  a b", "a  ", "\n x", "a\tb", "\xa0x", "ＡＢ", "\x00a", "▁a", "a▁b", " ", "<s>", "</s> x", "<0x41>", "a" * 3000, "日本語 12,345.67 ²²..", "def f(x):\n        return x**2", "\U0001f600 ok ́", "Ünïcödé ŁÓDŹ", "привет мир, γειά"]


def test_codec_is_the_library(codec):
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice("ab  ▁.,é1²я\n(ł") for _ in range(rnd.randint(1, 40))) for _ in range(800)]
    for text, (n, ids, decoded) in zip(texts, codec.digest(texts), strict=True):
        theirs = codec.library.encode(text, add_eos=True)
        assert (n, ids, decoded) == (len(theirs), sha(" ".join(map(str, theirs))), sha(codec.library.decode(theirs)))
        assert codec.encode(text) == theirs and codec.decode(theirs) == codec.library.decode(theirs)


def test_codec_checks_itself(codec, monkeypatch):
    monkeypatch.setattr(codec, "merge", lambda chunk: [5])
    with pytest.raises(ValueError):
        codec.learn(["▁word"])


def test_agendas_side_by_side(codec):
    rnd = random.Random(3)
    chunks = ["▁" * rnd.randint(0, 2) + "".join(rnd.choice("aaeinrst\u0301éłйя日\U0001f600.1") for _ in range(rnd.randint(1, 45))) for _ in range(2000)]
    chunks += ["▁" + "".join(rnd.choice(["and", "re", "ing", "th", "tion", "ble", "h"]) for _ in range(rnd.randint(1, 12))) for _ in range(2000)]
    assert codec.merge_all(chunks) == [codec.merge(c) for c in chunks]
    assert codec.merge_all([]) == []


def test_codec_remembers_what_comes_again(codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMO_CHUNKS", 50)
    monkeypatch.setattr(codec, "memo", {})
    monkeypatch.setattr(codec, "older", {})
    learned = []
    learn = codec.learn
    monkeypatch.setattr(codec, "learn", lambda fresh: learned.extend(fresh) or learn(fresh))
    for k in range(30):
        codec.render([" ".join(["always", *(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(20))])])
        assert len(codec.memo) + len(codec.older) <= 2 * (50 + 21)
    assert learned.count("▁always") == 1


def test_codec_over_documents(spark, sf_dir, codec):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text"))
    got = sorted((tuple(r) for r in sentencepiece_codec.encode_digests(docs, queries.piece_model_path()).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = codec.library.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(codec.library.decode(ids))))
    assert got == sorted(want, key=repr)
    full = sentencepiece_codec.encode_documents(edge(spark), queries.piece_model_path()).collect()
    assert {len(r["ids"]) for r in full if r["decoded"] == ""} == {1} and len(full) == len(EDGE)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    n, right = rows.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([("der hund ist nicht hier und die katze auch", "de"), ("the dog is not here and the cat is there", "en"), ("привет как дела", "ru"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_spans.train(docs)
    assert model.languages == ["de", "en", "ru"]
    # Script narrows: a Cyrillic word can only be Russian, a Latin one never.
    scores = model.word_scores(["дела", "hund"])
    assert scores[0].argmax() == 2 and scores[1].argmax() == 0 and scores[1][2] == language_spans.OTHER_SCRIPT
    got = language_spans.identify(edge(spark), model).collect()
    assert len(got) == len(EDGE) and {r["lang_pred"] for r in got if r["score"] == 0} == {"und"}
    mixed = spark.createDataFrame([(1, "der hund ist nicht hier и привет как дела " * 3)], "doc_id long, text string")
    assert {s["lang"] for s in language_spans.identify(mixed, model).first()["spans"]} == {"de", "ru"}
    assert language_spans.identify(edge(spark).limit(0), model).count() == 0
    nothing = language_spans.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_spans.identify(edge(spark), nothing).collect()} == {"und"}
    assert language_spans.keep_identified(edge(spark), model, 0.0).columns == edge(spark).columns


def test_only_letters_make_words():
    assert language_spans.words_of("½ ² Ⅷ 7 _ ٣") == [] and language_spans.words_of("x²y abc½ naïve") == ["x", "y", "abc", "naïve"]


def test_many_languages_and_unlearned_scripts(spark):
    rnd = random.Random(9)
    vocabulary = [[f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(6)] for i in range(300)]
    rows = [(i, " ".join(rnd.choice(v) for _ in range(30)), f"l{i:03}") for i, v in enumerate(vocabulary)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_spans.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_spans.identify(docs, model).collect()}
    assert len(model.languages) == 300 and sum(got[i] == lang for i, _, lang in rows) > 290
    # A script that was not learned, a text in three languages, and ties.
    some = [(1, "привет как дела"), (2, " ".join(" ".join(rnd.choice(vocabulary[i]) for _ in range(20)) for i in (3, 150, 290))), (3, "ъъъ"), (4, "²")]
    rows = spark.createDataFrame(some, "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_spans.identify(rows, model).collect()}
    assert found[1]["lang_pred"] == found[3]["lang_pred"] == "l000" and found[1]["score"] < 0.01 and found[4]["lang_pred"] == "und"
    assert {r["doc_id"] for r in language_spans.keep_identified(rows, model, 0.3).collect()} == {2}


def test_training_sample_is_never_empty(spark):
    docs = spark.range(4000).selectExpr("'der hund und die katze' AS text", "'de' AS lang")
    assert language_spans.train(docs, rows=40).languages == ["de"]


def test_viterbi_against_one_text_at_a_time():
    rng = np.random.default_rng(0)
    model = language_spans.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool))
    lengths = np.array([0, 5, 1, 30, 12])
    starts = np.cumsum(lengths) - lengths
    scores = np.log(rng.dirichlet([0.3] * 3, size=lengths.sum())).astype(np.float32)
    path = model.viterbi(scores, starts, lengths, penalty=2.0)
    for s, n in zip(starts, lengths, strict=True):
        best = scores[s].copy() if n else None
        back = []
        for t in range(1, n):
            steps = best[:, None] - 2.0 * (1 - np.eye(3))
            back.append(steps.argmax(axis=0))
            best = steps.max(axis=0) + scores[s + t]
        if n:
            total = lambda p: sum(scores[s + t][p[t]] for t in range(n)) - 2.0 * sum(p[t] != p[t + 1] for t in range(n - 1))
            assert total(path[s : s + n]) == pytest.approx(best.max(), abs=1e-3)


PAGE = '<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="x"><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">buy</div>{body}<footer>&copy; f</footer></body></html>'


def text_of(source):
    row = {"host": "h", "path": "/", "own": page_text.page_lines(source)}
    return page_text.main_text(row, [], [])


def test_page_lines():
    article = "<article><header><h1>T&eacute;</h1></header><p><b>One<br>two <p>three &lt;b&gt;</p><form>f</form><div id='comments'><p>c</p></div>tail</article>"
    assert text_of(PAGE.replace("{body}", article)) == "Té\n\nOne two\n\nthree <b>\n\ntail"
    assert page_text.page_lines("") == [] and page_text.page_lines("a < b <p") == ["0a < b"]
    assert text_of("<p>a\xa0b \n\x0b\u2003 c</p>") == "a b c" and text_of("<p class='a hidden b'>x</p><p hidden>y</p>") == "x"
    # Names of a page that say what it has, wrappers around an article, forms around a page, and a list of teasers.
    for wrapper in ("<div class='site has-sidebar'>", "<div class='banner-page'>", "<form action='/'>", "<div role='search'>"):
        assert text_of(PAGE.replace("{body}", f"{wrapper}<p>out</p><article><p>in</p></article>")) == "in"
    both = "<article><p>in</p><aside>a</aside></article><div class='related'><article>teaser</article></div><article class='comment'>c</article>"
    assert text_of(PAGE.replace("{body}", both)) == "in"
    assert text_of("<main><h1>t</h1><p>x</p><nav>n</nav></main><p>y</p>") == "t\n\nx"


def test_page_alignment():
    rnd = random.Random(3)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        kept = page_text.shared_lines(a, b)
        rest = iter(b)
        assert len(kept) == length(a, b) and all(a[i] in rest for i in sorted(kept))


@pytest.mark.parametrize("bits", [page_text.TABLE_BITS, 8])
def test_long_alignments(bits, monkeypatch):
    monkeypatch.setattr(page_text, "TABLE_BITS", bits)
    rnd = random.Random(4)
    a, b = ([rnd.choice("abcdefgh") for _ in range(300)] for _ in range(2))
    kept = sorted(page_text.shared_lines(a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    rest = iter(b)
    assert len(kept) == row[-1] and all(a[i] in rest for i in kept)
    if bits > 8:
        lines = ["x", "y"] * 10_000
        assert page_text.shared_lines(lines, ["y", *lines, "z", "x"]) == set(range(20_000))


def plain_result(rows):
    """Every page against its neighbours in one sorted list."""
    pages = []
    for key, url, source in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0].lower()
        path = re.match("[^/?#]*((?:/[^?#]*)?)", rest)[1]
        pages.append({"id": key, "url": url, "host": host, "path": path, "own": page_text.page_lines(source or "")})
    pages.sort(key=lambda p: (p["host"], p["path"], p["id"] is not None, p["id"] or 0))
    out = []
    for i, p in enumerate(pages):
        kind = max((x[0] for x in p["own"]), default="0")
        near = [q for q in (*pages[max(0, i - 3) : i][::-1], *pages[i + 1 : i + 4]) if p["host"] and q["host"] == p["host"] and q["own"] != p["own"]]
        gone = set()
        if kind == "0" and near:
            agree = [next((k for k, (x, y) in enumerate(zip(p["path"] + "\0", q["path"] + "\1")) if x != y)) for q in near]
            gone = page_text.shared_lines(p["own"], near[agree.index(max(agree))]["own"])
        elif len(near) == 6:
            gone = set.intersection(*(page_text.shared_lines(p["own"], q["own"]) for q in near))
        text = "\n\n".join(x[1:] for k, x in enumerate(p["own"]) if x[0] == kind and k not in gone)
        out.append((p["id"], p["url"], text, len(text)))
    return sorted(out, key=repr)


def test_page_differencing(spark):
    plain = lambda own: PAGE.replace("{body}", f"<div>Site name</div><p>{own}</p><div>Imprint</div>")
    rows = [(1, "http://a.org/x/1", plain("first")), (2, "http://a.org/x/2", plain("second")), (3, "http://b.org/x/1", plain("third")), (4, None, plain("fourth")), (5, "http://a.org/y", None), (5, "http://c.org/1", ""), (6, "http://d.org/1", plain("copy")), (7, "http://d.org/1", plain("copy"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in page_text.extract_main_text(pages).collect())
    whole = lambda own: f"Site name\n\n{own}\n\nImprint"
    assert got == [(1, "first", 5), (2, "second", 6), (3, whole("third"), 25), (4, whole("fourth"), 26), (5, "", 0), (5, "", 0), (6, whole("copy"), 24), (7, whole("copy"), 24)]
    assert page_text.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", ["1", "8", "70"])
def test_page_query_against_a_plain_version(spark, ranges):
    """Articles with a shared line, pages without one, copies, nulls, a very long page; few and many ranges and levels of edges."""
    rnd = random.Random(int(ranges))
    words = lambda n: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(n))
    rows = [(None, "http://h0.org/a/1", "<p>x</p>"), (None, None, "<p>y</p>"), (900, "http://h1.org/z", None), (901, "http://h1.org/z/2", "")]
    for i in range(240):
        host = f"{'h' if i % 3 else 'p'}{min(3, rnd.randrange(6))}.org"
        boiler = "<p>Share this text with friends</p>" if rnd.random() < 0.97 else ""
        body = f"<article><p>{words(5)}</p>{boiler}<p>{words(4)}</p></article>" if i % 3 else f"<div>Home of {host}</div><p>{words(6)}</p><p>Contact</p>"
        rows.append((i, f"http://{host}/{'ab'[i % 2]}/{rnd.randrange(40)}", PAGE.replace("{body}", body)))
    rows += [(1000 + i, "http://h2.org/a/7", rows[20][2]) for i in range(6)]
    rows.append((2000, "http://h3.org/b/9", "<article>" + "".join(f"<p>{words(2)}</p>" for _ in range(30_000)) + "<p>Share this text with friends</p></article>"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = sorted((tuple(r) for r in page_text.extract_main_text(pages).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_result(rows)
    assert got == want
    assert sum("Share this" in r[2] for r in got) < sum("Share this" in (r[2] or "") for r in rows) / 2


def test_page_query_keeps_articles(spark, sf_dir):
    """On the given table every article comes out whole: its text by a parser of another make."""
    got = {r["page_id"]: r["text"] for r in queries.op9_html_text(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.sub("(?s)^.*<article>|</article>.*$", "", r["html"])
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", " " if "br" in b else "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_pages_keep_their_rows_without_reused_exchanges(spark):
    """Many hosts and ranges; the plan must not count on one exchange being read twice."""
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 37, F.lit("/p"), F.xxhash64("id")).alias("url"), F.concat(F.lit("<article><p>only "), F.col("id"), F.lit("</p></article>")).alias("html")).repartition(7)
    got = {}
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got[reuse] = sorted(tuple(r) for r in page_text.extract_main_text(pages).collect())
    spark.conf.unset("spark.sql.exchange.reuse")
    assert got["true"] == got["false"] and [r[0] for r in got["true"]] == list(range(4000))
