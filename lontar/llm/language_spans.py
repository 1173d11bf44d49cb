"""Language identification of mixed-language text.

A word's script (by code point ranges) narrows its candidate languages to those
seen with that script in training; each candidate scores the word by its byte
n-grams and the whole word.  A Viterbi path over the words, which pays a penalty
for each switch, labels spans; the text's language is the one whose spans hold
the most letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.batches import forget, map_texts, release, remembered, slices
from lontar.llm.shared import bound_batches

#: First and last code point of each script range.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)

#: Hash buckets of word features.
BUCKETS = 1 << 16
#: Rows that training reads, as the expected size of a random sample of the labelled rows.
TRAIN_ROWS = 20_000
#: Log-probability that one change of language costs.
SWITCH_PENALTY = 10.0
#: Bounds of one word's log-posterior for a candidate and for a language outside its script.
WORD_FLOOR, OTHER_SCRIPT = -6.0, -30.0
#: Share of a script's letters that a language needs to be its candidate.
SCRIPT_SHARE = 1e-3
#: Bytes of text whose words take the steps of the path together.
TEXT_BYTES = 2 << 20
#: Words whose scores a worker remembers.
MEMO_WORDS = 100_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_STARTS = np.array([s[1] for s in SCRIPTS])
_ENDS = np.array([s[2] for s in SCRIPTS])


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode categories L), lower-cased."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # Superscripts, fractions and other numbers that are no decimal digits.
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def script_of(words: list[str]) -> np.ndarray:
    """Index into SCRIPTS of each word's first letter; len(SCRIPTS) for any other."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    at = np.searchsorted(_STARTS, first, "right") - 1
    return np.where((at >= 0) & (first <= _ENDS[np.maximum(at, 0)]), at, len(SCRIPTS))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of the byte 2-, 3- and 4-grams of <word> and of the whole word."""
    raw = ("\x02" + "\x03\x02".join(words) + "\x03").encode()
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    word = np.cumsum(b == 2) - 1
    found, owner = [], []
    h = b.copy()
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(0x9E3779B1) + b[n - 1 :] + np.uint64(n)
        inside = word[: len(h)] == word[n - 1 :]
        found.append(h[inside])
        owner.append(word[: len(h)][inside])
    starts = np.flatnonzero(b == 2)
    whole = np.add.reduceat(b * (np.arange(len(b), dtype=np.uint64) - np.repeat(starts, np.diff([*starts, len(b)])).astype(np.uint64) + np.uint64(7)) ** np.uint64(5), starts)
    found.append(whole + np.uint64(1) << np.uint64(17))
    owner.append(np.arange(len(starts)))
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate(owner)


@dataclass
class LanguageModel:
    languages: list[str]
    #: log P(feature | language), buckets x languages.
    table: np.ndarray
    #: candidates[script] marks the languages of a script.
    candidates: np.ndarray
    #: Names the model among those that a worker has met.
    key: str = ""

    def __post_init__(self) -> None:
        self.key = sha256(repr(self.languages).encode() + self.table.tobytes() + self.candidates.tobytes()).hexdigest()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-posterior of each language for each word, words x languages."""
        bucket, owner = features(words)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        sums = np.add.reduceat(self.table[bucket[order]], np.concatenate([[0], np.cumsum(counts)[:-1]]))
        fits = self.candidates[script_of(words)]
        sums = np.where(fits, sums, -np.inf)
        top = sums.max(axis=1, keepdims=True)
        known = np.isfinite(top)
        sums = sums - np.where(known, top, 0)
        with np.errstate(divide="ignore"):
            sums -= np.log(np.exp(sums).sum(axis=1, keepdims=True))
        # Words of a script that no language was learned with speak for none.
        return np.where(known, np.where(fits, np.maximum(sums, WORD_FLOOR), OTHER_SCRIPT), WORD_FLOOR).astype(np.float32)

    def viterbi(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
        """Language index of every word; texts are runs of rows of `scores`, all texts take each step together."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n = len(self.languages)
        path = np.zeros(len(scores), np.int16)
        steps = int(lengths[0]) if len(lengths) else 0
        if not steps:
            return path
        came = np.zeros((len(scores), n), np.int16)
        own = np.arange(n, dtype=np.int16)
        active_at = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than each step
        best = scores[starts[: active_at[0]]].copy()
        finals = np.zeros(len(starts), np.int16)
        for t in range(1, steps + 1):
            active = active_at[t] if t < steps else 0
            if active < len(best):
                finals[active : len(best)] = best[active:].argmax(axis=1)
                best = best[:active]
            if not active:
                break
            at = starts[:active] + t
            top = best.argmax(axis=1)
            change = best[np.arange(active), top] - penalty
            stays = best >= change[:, None]
            came[at] = np.where(stays, own, top[:, None])
            best = np.where(stays, best, change[:, None]) + scores[at]
        state = finals.copy()
        for t in range(steps - 1, -1, -1):
            active = active_at[t]
            at = starts[:active] + t
            path[at] = state[:active]
            state[:active] = came[at, state[:active]]
        return path

    def label(self, texts: list[str | None], memo: tuple[dict[str, int], list[np.ndarray]]) -> Iterator[tuple[str, float, list[tuple[int, int, str]], float]]:
        """(language, score, spans (first word, end, language), certainty of all spans) of each text."""
        if not self.languages:
            yield from ((UNDETERMINED, 0.0, [], 0.0) for _ in texts)
            return
        cut = [words_of(t) for t in texts]
        known, blocks = memo
        if len(known) > MEMO_WORDS:
            known.clear()
            blocks.clear()
        fresh = [w for w in dict.fromkeys(w for ws in cut for w in ws) if w not in known]
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            blocks.append(self.word_scores(fresh))
        if len(blocks) > 1:
            blocks[:] = [np.concatenate(blocks)]
        ids = np.fromiter((known[w] for ws in cut for w in ws), np.int64)
        letters = np.fromiter((len(w) for ws in cut for w in ws), np.int64)
        lengths = np.array([len(ws) for ws in cut], np.int64)
        starts = np.cumsum(lengths) - lengths
        scores = blocks[0][ids] if len(ids) else np.zeros((0, len(self.languages)), np.float32)
        path = self.viterbi(scores, starts, lengths)
        for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            if not n:
                yield UNDETERMINED, 0.0, [], 0.0
                continue
            p = path[start : start + n]
            held = np.bincount(p, letters[start : start + n], minlength=len(self.languages))
            best = int(held.argmax())
            mine = p == best
            certain = np.exp(scores[start : start + n][np.arange(n), p].astype(np.float64))
            sure = certain[mine].mean()
            edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), n]
            spans = [(a, b, self.languages[p[a]]) for a, b in zip(edges, edges[1:], strict=False)]
            yield self.languages[best], float(held[best] / held.sum() * sure), spans, float(certain.mean())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of batches (lang, text): features by bucket, behind them letters by script."""
    forget()
    for batch in batches:
        for part in slices(batch, 1):
            by: dict[str, list[str]] = {}
            for lang, text in zip(*(part.column(i).to_pylist() for i in (0, 1)), strict=True):
                by.setdefault(lang, []).extend(words_of(text))
            for lang, words in by.items():
                if not words:
                    continue
                seen = np.bincount(features(words)[0], minlength=BUCKETS + len(SCRIPTS) + 1)
                seen += np.pad(np.bincount(script_of(words), [len(w) for w in words], minlength=len(SCRIPTS) + 1).astype(np.int64), (BUCKETS, 0))
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["lang", "bucket", "n"])
    release()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS, seed: int = 11, id_col: str = "doc_id") -> LanguageModel:
    """Feature counts of a random sample of the labelled rows (all, if they are no more), summed on the executors.

    Rows are drawn by a hash of id and text, so the sample does not depend on how
    the rows are dealt, and copies of a text under other ids are not drawn
    together.  Without a column `id_col` nothing tells copies apart but where
    they lie, and rows are drawn by that.

    What reaches the driver is at most BUCKETS + scripts rows a language.  Null
    labels and null texts take no part; without labelled rows no language is
    learned and every text is undetermined.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.count()
    if n <= rows:
        drawn = labelled
    elif id_col in docs.columns:
        drawn = labelled.where(F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(1 << 53)) / F.lit(float(1 << 53)) < rows / n)
    else:
        drawn = labelled.sample(rows / n, seed)
    sample = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    found = sample.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    if languages:
        counts[found["bucket"], found["lang"].map({x: i for i, x in enumerate(languages)})] = found["n"]
    table = np.log(counts[:BUCKETS] + 0.5) - np.log(counts[:BUCKETS].sum(axis=0) + 0.5 * BUCKETS)
    letters = counts[BUCKETS:]
    return LanguageModel(languages, table.astype(np.float32), (letters > 0) & (letters >= SCRIPT_SHARE * letters.sum(axis=1, keepdims=True)))


def _memo(shared: Broadcast) -> tuple[dict[str, int], list[np.ndarray]]:
    """What this worker remembers of the words under one model."""
    return remembered(shared.value.key, lambda: ({}, []))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every row's text.

    Texts that are null, empty or without letters are `und` with score 0.  Rows
    with repeated or null ids each give a row; an empty table gives none.  Ties
    between languages go to the alphabetically first.  A text in a script that
    was not learned gets some learned language with the score of a guess.  Texts
    of any length go whole; columns other than id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = list(shared.value.label(part.column(1).to_pylist(), _memo(shared)))
        spans = [[dict(zip(("start", "end", "lang"), s, strict=True)) for s in f[2]] for f in found]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
            names=[id_col, "lang_pred", "score", "spans"],
        )

    return map_texts(docs, [id_col, text_col], run, f"{id_col} long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>", TEXT_BYTES)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """Rows whose words are certain by at least `min_score` to be in the languages of their spans; columns stay as they are.

    A text in several languages is judged by all its spans.  Null and empty
    texts and texts without letters go.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # Only texts go to Python and only scores come back; the rows stay where they are.
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        memo = _memo(shared)
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        found = (f for part in slices(batch, 0, TEXT_BYTES) for f in shared.value.label(part.column(0).to_pylist(), memo))
        return pa.array([-1.0 if lang == UNDETERMINED else sure for lang, _, _, sure in found], pa.float64())

    return docs.where(score(F.col(text_col)) >= min_score)


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
