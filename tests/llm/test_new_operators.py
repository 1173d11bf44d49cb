"""Fill-in-the-middle, prefix token counts and source divergence, held against plain versions, SQL and the library."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lontar.llm import divergence, fill_middle, oracle, queries, token_counts

from ..compare import database, same
from .brute import LOWER, sha

ODD = [None, "", " ", "\n\t x", "a", "a b", "wort " * 3000, "x" * 70_000, " " * 40_000 + "é", "<P> in it", "a <S>", "x<M>y", "日本 語\x0b\x0c テ", "\x1c\x85 a\xa0b", "\U0001f600 b\r\n\r\nc  "]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def odd_rows(spark, texts, copies=1):
    rows = [(None if i % 7 == 3 else i % 11 if i % 5 == 0 else i, t) for i, t in enumerate(texts * copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Columns whose names the operators use themselves.
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("id", "form", "cut", "n", "digest", "counts", "output", "n_bytes")])
    return rows, wide


def moved(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = [int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle_on_odd_texts(spark):
    rows, df = odd_rows(spark, ODD, 9)
    got = sorted(map(tuple, fill_middle.transform_digests(df).collect()), key=repr)
    assert got == sorted((moved(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.transform_digests(df.limit(0)).collect() == []


def test_fill_in_middle_sql(spark, sf_dir):
    same(queries.op11_fill_in_middle(spark, sf_dir), database(sf_dir), oracle.ORACLE_SQL["op11_fill_in_middle"])


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_cuts_do_not_depend_on_chunks(chunk):
    rnd = random.Random(chunk)
    texts = ["".join(rnd.choice(" \n\tabé日") for _ in range(rnd.randrange(40))) for _ in range(200)]
    h = [[rnd.randrange(1 << 32) for _ in texts] for _ in range(2)]
    # A slice of an array, as its offsets do not begin at 0.
    got = fill_middle.find_cuts(pa.array(["zz y", *texts])[1:], pa.array([True] * 200), pa.array(h[0]), pa.array(h[1]), chunk).to_pylist()
    for text, h1, h2, row in zip(texts, *h, got, strict=True):
        units = UNIT.findall(text)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert row == {"n": len(units), "prefix_chars": len("".join(units[:a])), "middle_chars": len("".join(units[a:b]))}


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(queries.tokenizer_path(queries.WORD_TOKENIZER))


PIECES = [
    "Hello world's we'll I'RE they've 'r 're'x ''s 'll'll've", "<|startoftext|>", "ab<|endoftext|>cd!!<|startoftext|>!!", "<|STARTOFTEXT|>", "!!<|startoftex", "İstanbul ΣΑΣ straße Ünïcödé ÀÉßx'S!!",
    "a<|endoftext|≯", "éä ñ", "日本語テキスト 12345 ３", "a\x1cb\x85c d　e f", "x" * 300, "." * 200, "ab" * 100, "\U0001f600\U0001f468‍\U0001f469 ok", "한글 한 क़ ǅ ﬁ ²", "\x00 \x01a", "«a» µª²",
]


def test_every_prefix_is_the_library(counter):
    rnd = random.Random(4)
    texts = PIECES + ["".join(rnd.choice("ab  'srelvt!<|>éΣ1²\n가é") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    for text in texts:
        read = "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(counter.special.split(text)))
        theirs = [len(e.ids) for e in counter.library.encode_batch([read[:k] for k in range(len(read) + 1)], add_special_tokens=False)]
        assert counter.table(text).tolist() == theirs, text
        assert counter.count([text]) == [len(counter.library.encode(text, add_special_tokens=False).ids)]


def test_all_characters_are_read_as_the_library_reads_them(counter):
    points = [chr(p) for p in [*range(0x3400), *range(0xA000, 0xD800, 7), *range(0xF900, 0x11000), *range(0x1D400, 0x1FB00, 3)]]
    texts = [f"a{p}b" for p in points]
    theirs = [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == theirs


def test_counter_checks_itself(counter, monkeypatch):
    monkeypatch.setattr(counter, "whole", lambda run: 99)
    with pytest.raises(ValueError):
        counter.learn(["word"])


def test_memories_are_emptied(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_RUNS", 5)
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 5)
    texts = [f"word{k} other{k} zxq{k}vv " + "long" * 30 for k in range(40)]
    assert counter.count(texts) + counter.count(texts) == 2 * [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_worked_out_once_whatever_signs_they_meet(monkeypatch):
    counter = token_counts.PrefixCounter(queries.tokenizer_path(queries.WORD_TOKENIZER))
    words = [f"Zqü{a}{b}stem" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [" ".join(w + s for w in words) for s in (".", ",", "!!", "$$$", "'s", "?")]
    want, library, sent = [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)], counter.library, []

    class Library:
        def __getattr__(self, name):
            def call(texts, **options):
                sent.append(len("".join([texts] if isinstance(texts, str) else texts)))
                return getattr(library, name)(texts, **options)

            return call

    monkeypatch.setattr(counter, "library", Library())
    assert counter.count(texts) == want
    # Before, each of the words went to the library once with each sign; now once, and one of the texts as a whole.
    assert sum(sent) < 2 * len(texts[0]) + 100


def test_odd_runs_among_words(counter):
    rnd = random.Random(12)
    parts = ["word", "Äpfel's", "a<b|c>", "“quoted”", "x<|endoftext|>y's", "<|startoftext", "日本", "é́t", "don’t", "\x1c", "12%", "'LL", "q" * 3000, "“" + "r" * 3000]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "\n", "\u3000", "\x85"]) for _ in range(rnd.randrange(40))) for _ in range(300)]
    want = [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want and [counter.count([t])[0] for t in texts] == want


def test_a_whole_text_is_held_against_the_library(counter, monkeypatch):
    monkeypatch.setattr(counter, "piece", re.compile(r"\S+"))
    with pytest.raises(ValueError):
        counter.count(["can't split!! this"])


def test_older_words_are_kept_when_a_memory_is_full(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 4)
    asked, learn = [], counter.learn_words
    monkeypatch.setattr(counter, "learn_words", lambda fresh: asked.extend(fresh) or learn(fresh))
    for k in range(6):
        counter.count([f"zqkeptword zqk{chr(97 + k)}one zqk{chr(97 + k)}two"])
    assert asked.count("zqkeptword") == 1 and len(counter.words) + len(counter.older) <= 8


def test_token_counts_query(spark, sf_dir, counter):
    rows, df = odd_rows(spark, [*ODD, *PIECES])
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    got = [tuple(r) for r in token_counts.count_tokens(df, path, 100).collect()]
    got += [tuple(r) for r in token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, 100).collect()]
    n = [len(e.ids) for e in counter.library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert sorted(got, key=repr) == sorted(((k, len((t or "").encode()), c, c > 100) for (k, t), c in zip(rows, n, strict=True)), key=repr)
    query = {r["doc_id"]: r["over_limit"] for r in queries.op12_token_counts(spark, sf_dir).collect()}
    assert len(query) == 200 and query == {k: c > 2048 for (k, _), c in list(zip(rows, n, strict=True))[-200:]}
    assert token_counts.count_tokens(df.limit(0), path, 1).collect() == []


def test_truncation_without_encoding_again(spark, counter):
    rows, df = odd_rows(spark, PIECES)
    tables = token_counts.prefix_counts(df, queries.tokenizer_path(queries.WORD_TOKENIZER))
    got = tables.select("counts", token_counts.longest_prefix(F.col("counts"), 6).alias("k"), token_counts.longest_prefix(F.col("counts"), -1).alias("none"), token_counts.tokens_of(F.col("counts"), 3).alias("three")).collect()
    want = Counter()
    for _, text in rows:
        table = counter.table(text).tolist()
        want[tuple(table), max(k for k, n in enumerate(table) if n <= 6), None, table[3] if len(table) > 3 else None] += 1
    assert Counter((tuple(r["counts"]), r["k"], r["none"], r["three"]) for r in got) == want


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(rows, least=3, top=200):
    docs, groups, places = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(terms))
        groups[lang].add(source)
        places[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        v = len(kept)
        count = {s: [places[lang, s][t] for t in kept] for s in sources}
        shares = lambda n: [1 + 10**9 * (c + 1) // (sum(n) + v) for c in n]
        p = {s: shares(n) for s, n in count.items()}
        q = shares([sum(c) for c in zip(*count.values(), strict=True)])
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources - {s})
            term = sorted((-f(a, b), t.encode(), t) for t, n, a, b in zip(kept, count[s], p[s], q, strict=True) if n and a > b)[:top]
            out += [(lang, s, part, item, -value, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("terms, groups", [(4096, 64), (3, 2), (1, 1)])
def test_divergence_against_a_plain_version(spark, monkeypatch, terms, groups):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", groups)
    monkeypatch.setattr(divergence, "HELD", 20)
    rnd = random.Random(terms)
    words = ["Ab", "ab", "é", "ÄB", "zoo9x", "don't", "語", "\U0001f600", *"cdefgh"]
    rows = [(rnd.choice(["a", "b", "", None]), rnd.choice(["s", "t", "u", "v", "", None]), rnd.choice([None, "", "12 !", " ".join(rnd.choice(words) for _ in range(rnd.randrange(12)))])) for _ in range(120)]
    rows += [("lone", "only", "c d c"), ("none", "x", None), ("none", "y", "once"), ("none", "z", "")] + [("same", s, "tie tied tie") for s in "abc"] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string").select("*", *[F.lit(1).alias(c) for c in ("term", "n", "rank", "salt", "a", "spot")])
    assert sorted(map(tuple, divergence.audit_sources(df.repartition(5), top_terms=4).collect())) == audit(rows, top=4)
    assert divergence.audit_sources(df.limit(0)).collect() == []


def test_shares_are_exact_for_large_counts():
    rnd = random.Random(1)
    for _ in range(300):
        total = rnd.randrange(1, 9 * 10**15)
        count = rnd.randrange(total + 1)
        assert int(divergence.share(count, total)) == 1 + 10**9 * count // total
    assert int(divergence.distance(np.int64(10**9 + 1), np.int64(1))) == 10**18


def test_divergence_sql(spark, sf_dir):
    same(queries.op13_source_divergence(spark, sf_dir), database(sf_dir), oracle.ORACLE_SQL["op13_source_divergence"])
