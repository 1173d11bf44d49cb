"""Exact token counts of all prefixes of a text, for byte-pair vocabularies with a word-end mark.

The number of tokens of a prefix follows from those of shorter prefixes: tokens
t1 ... tk encode what they spell if and only if each two neighbours encode what
these two spell.  So exactly one token can end the encoding of a prefix: the one
that stands well beside the last token of the prefix before it.  Its count is
one more than that prefix's.  Whether two tokens may stand side by side is found
by taking back, latest first, the merges that made them: they may not if the
symbols at their border could have been merged earlier.

A prefix that ends inside a word is encoded as a word that ends there, as the
library would, so the last token is looked for among those with the end mark.
White space is never part of a token, and what stands on both sides of it is
encoded apart, as are the words, contractions, digits and rows of signs of a run
without white space.  So each distinct word is worked out once for a worker, and
counts of a text are sums over its words; those that are new in a slice are
taken in order, so the prefixes that neighbours share are worked out once.  Runs
with other characters than those whose words are known without the library are
taken whole.  Every word or run that a worker meets for the first time is also
counted by the library and must agree, and so must a whole text of each slice.

Prefixes are counted in code points of the text in Unicode form NFC, which the
tokenizer reads; a text in that form has its own code points.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.batches import map_texts, remembered

#: Code points of the tokenizer's white space, in ranges.
WHITE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Letters that are in form NFC, have one small letter each and need no library to be told from marks and digits.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Runs, words and neighbours that a worker remembers; beyond it a memory is emptied and filled anew, that of words in two
#: generations.  Longer ones than MEMO_CHARS are worked out each time they occur.
MEMO_RUNS, MEMO_WORDS, MEMO_CHARS = 500_000, 700_000, 40
#: Words that the library gets as one text, and characters of the longest text that it is asked about as a whole.
CHECK_WORDS, CHECK_CHARS = 64, 20_000


class PrefixCounter:
    """Counts of all prefixes for a word-piece vocabulary of merges in a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.splitter = self.library.normalizer, self.library.pre_tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.mark: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {m: r for r, m in enumerate(merges)}
        #: How each token was made: rank of its merge, left and right part.
        self.made: dict[str, tuple[int, str, str]] = {}
        for r, (left, right) in enumerate(merges):
            made = max(self.made.get(left, (-1,))[0], self.made.get(right, (-1,))[0])
            if left + right in self.made or made >= r:
                raise ValueError("the merges of this vocabulary are not in the order of their making")
            self.made[left + right] = (r, left, right)
        #: Tokens that encode what they spell: a merge may be out of reach as its parts are torn by earlier ones.
        self.tokens = set(model["vocab"]) - self.made.keys()
        for r, (left, right) in enumerate(merges):
            if left in self.tokens and right in self.tokens and self._apart(left, right, r):
                self.tokens.add(left + right)
        bare = [len(t) - len(self.mark) if self.mark and t.endswith(self.mark) else len(t) for t in self.tokens]
        self.longest = max(bare)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None
        white = "".join(f"{chr(a)}-{chr(b)}" for a, b in WHITE)
        self.run = re.compile(f"[^{white}]+")
        plain = [c for c in map(chr, range(0x21, 0x100)) if re.match(f"[!-~{LETTERS}]", c)]
        self.piece = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^{LETTERS}0-9{white}]+")
        #: What makes a run one that is taken whole, and such runs.
        self.other = re.compile("|".join([f"[^!-~{LETTERS}{white}]", *map(re.escape, special)]))
        safe = "".join(re.escape(c) for c in plain if not any(s.startswith(c) for s in special))
        self.odd = re.compile(f"(?<![^{white}])((?:[{safe}]++|(?!{self.other.pattern})[^{white}])*+(?:{self.other.pattern})[^{white}]*+)")
        shown = {c: self.splitter.pre_tokenize_str(c)[0][0] for c in plain if c == c.lower()}
        #: Byte symbols of the letters that have more than one.
        self.symbols = {ord(c): s for c, s in shown.items() if c != s}
        self.beside: dict[tuple[str, str], bool] = {}
        #: Totals of words, younger and older generation, and of runs that are taken whole.
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.totals: dict[str, int] = {}

    def apart(self, a: str, b: str) -> bool:
        """Whether tokens `a` and `b` stay apart when what they spell is encoded."""
        key = a, b
        known = self.beside.get(key)
        if known is None:
            known = self.beside[key] = self._apart(a, b, len(self.rank))
        return known

    def _apart(self, a: str, b: str, until: int) -> bool:
        """Whether no merge of rank below `until` goes across the border of `a` and `b`."""
        none = (-1, "", "")
        while True:
            if self.rank.get((a, b), until) < until:
                return False
            made_a, made_b = self.made.get(a, none), self.made.get(b, none)
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            # Of equal merges the left one goes first, so the right one is taken back first, and one that would
            # have gone before it forbids the pair.
            if made_a[0] > made_b[0]:
                until, a = made_a[0], made_a[2]
            else:
                until, b = made_b[0] + 1, made_b[1]

    def _inner(self, word: str, until: int, last: list[str], inner: list[int]) -> None:
        """Go on to prefix `until` with the last tokens and counts of the prefixes of a word that do not end it."""
        # One token alone can stand at each end; short ones are met more often and tried first.
        tokens, beside, longest = self.tokens, self.beside, self.longest
        if len(beside) > MEMO_WORDS:
            beside.clear()
        for end in range(len(last), until + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = word[start:end]
                if token in tokens:
                    if start and not (beside[key] if (key := (last[start], token)) in beside else self.apart(*key)):
                        continue
                    last.append(token)
                    inner.append(inner[start] + 1)
                    break
            else:
                raise ValueError(f"no token stands before place {end} of {word!r}")

    def _closed(self, word: str, end: int, last: list[str], inner: list[int]) -> int:
        """Count of the prefix that ends at `end` as a word of its own, from those of shorter prefixes."""
        tokens, beside, mark = self.tokens, self.beside, self.mark
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            token = word[start:end] + mark
            if token in tokens:
                if start and not (beside[key] if (key := (last[start], token)) in beside else self.apart(*key)):
                    continue
                return inner[start] + 1
        raise ValueError(f"no token ends {word[:end]!r}")

    def word(self, word: str) -> list[int]:
        """Counts of all prefixes, the empty one first, of a word of byte symbols."""
        last, inner = [""], [0]
        self._inner(word, len(word) - 1, last, inner)
        return [0, *(self._closed(word, end, last, inner) for end in range(1, len(word) + 1))]

    def learn_words(self, fresh: Iterable[str]) -> dict[str, int]:
        """Totals of words of small letters, contractions, digits and rows of signs not met before, held against the library."""
        known: dict[str, int] = {}
        before, last, inner = "", [""], [0]
        for symbols, word in sorted((w if w.isascii() else w.translate(self.symbols), w) for w in fresh):
            if symbols + self.mark in self.tokens:
                known[word] = 1
                continue
            # Prefixes that the word before has too are known.
            shared, most = 0, min(len(last), len(symbols)) - 1
            while shared < most and before[shared] == symbols[shared]:
                shared += 1
            del last[shared + 1 :], inner[shared + 1 :]
            self._inner(symbols, len(symbols) - 1, last, inner)
            known[word] = self._closed(symbols, len(symbols), last, inner)
            before = symbols
        words = list(known)
        rows = [words[k : k + CHECK_WORDS] for k in range(0, len(words), CHECK_WORDS)]
        for row, theirs in zip(rows, self.library.encode_batch([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            if np.bincount(theirs.word_ids).tolist() != [known[w] for w in row]:
                raise ValueError(f"the library counts one of {row!r} otherwise")
        return known

    def whole(self, run: str) -> int:
        """Tokens of a whole run."""
        return self.prefixes(run)[-1]

    def ordinary(self, text: str) -> list[int]:
        """Counts of all prefixes of a run in NFC that is read without special tokens."""
        lower = self.normalizer.normalize_str(text)
        counts = [0] * (len(lower) + 1)
        before = 0
        for symbols, (start, end) in self.splitter.pre_tokenize_str(lower):
            piece = lower[start:end]
            if end - start == len(symbols):
                inside = self.word(symbols)
            else:
                # Symbols are bytes; a prefix ends behind the last byte of a character.
                at = list(accumulate((len(c.encode()) for c in piece), initial=0))
                all_bytes = self.word(symbols)
                inside = [all_bytes[k] for k in at]
            if piece[0] == "'" and piece[1:].isalpha():
                # A contraction is one word only when whole: cut short, the apostrophe stands for itself.
                short = [self.ordinary(piece[:1])[-1] + (self.ordinary(piece[1:k])[-1] if k > 1 else 0) for k in range(1, len(piece))]
                inside = [0, *short, inside[-1]]
            counts[start : end + 1] = [before + c for c in inside]
            before += inside[-1]
        if len(lower) != len(text):
            # Letters whose small form has more characters.
            at = list(accumulate((len(self.normalizer.normalize_str(c)) for c in text), initial=0))
            counts = [counts[k] for k in at]
        return counts

    def prefixes(self, run: str) -> list[int]:
        """Counts of all prefixes, the empty one first, of a run without white space."""
        pieces = self.special.split(run) if self.special else [run]
        counts = [0]
        for k in range(0, len(pieces), 2):
            text = unicodedata.normalize("NFC", pieces[k])
            special = pieces[k + 1] if k + 1 < len(pieces) else ""
            # Cut short, a special token is ordinary text, joined to what stands before it.
            found = self.ordinary(text + special[:-1])
            before = counts[-1]
            counts.extend([before + c for c in found[1:]])
            if special:
                counts.append(before + found[len(text)] + 1)
        return counts

    def learn(self, fresh: list[str]) -> dict[str, int]:
        """Totals of runs not met before, held against the library."""
        if not fresh:
            return {}
        found = {r: self.whole(r) for r in fresh}
        for run, theirs in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            if found[run] != len(theirs.ids):
                raise ValueError(f"the library counts {run!r} otherwise")
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Counts of whole texts."""
        words, odd = [], []
        for text in texts:
            parts = self.odd.split(text) if self.other.search(text) else [text]
            odd.append(parts[1::2])
            words.append(self.piece.findall(" ".join(parts[::2]).lower()))
        counts = [a + b for a, b in zip(self._words(words), self._runs(odd), strict=True)]
        k = next((k for k, text in enumerate(texts) if 0 < len(text) <= CHECK_CHARS), None)
        if k is not None and len(self.library.encode(texts[k], add_special_tokens=False)) != counts[k]:
            raise ValueError(f"the library counts the text {texts[k]!r} otherwise")
        return counts

    def _words(self, texts: list[list[str]]) -> list[int]:
        """Sums over the words of each text."""
        if len(self.words) > MEMO_WORDS // 2:
            self.words, self.older = {}, self.words
        fresh = set().union(*texts) - self.words.keys()
        kept = {w: self.older[w] for w in fresh & self.older.keys()}
        learned = self.learn_words(fresh - kept.keys())
        self.words |= kept
        self.words |= learned
        counts = [sum(map(self.words.__getitem__, words)) for words in texts]
        for word in learned:
            if len(word) > MEMO_CHARS:
                del self.words[word]
        return counts

    def _runs(self, texts: list[list[str]]) -> list[int]:
        """Sums over the runs of each text that are taken whole."""
        if len(self.totals) > MEMO_RUNS:
            self.totals.clear()
        learned = self.learn(list(set().union(*texts) - self.totals.keys()))
        self.totals.update(learned)
        counts = [sum(map(self.totals.__getitem__, runs)) for runs in texts]
        for run in learned:
            if len(run) > MEMO_CHARS:
                del self.totals[run]
        return counts

    def table(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text, the empty one first."""
        self.count([text])
        parts, before, end = [np.zeros(1, np.int32)], 0, 0
        for run in self.run.finditer(text):
            # White space leaves the count as it is; it is never touched by NFC but for its kind.
            parts.append(np.full(run.start() - end, before, np.int32))
            counts = self.prefixes(run[0])
            parts.append(np.array(counts[1:], np.int32) + before)
            before, end = before + counts[-1], run.end()
        parts.append(np.full(len(text) - end, before, np.int32))
        return np.concatenate(parts)


def counter(path: str) -> PrefixCounter:
    """The worker's counter of a tokenizer file."""
    return remembered(path, lambda: PrefixCounter(path))


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of counts of every text: (id, n_bytes, counts array<int>).

    `counts` has one element for each prefix, the empty one first, so element k
    is the number of tokens of the first k code points, and `longest_prefix` and
    `tokens_of` answer questions from it.

    Null texts count as empty, whose table is [0]; rows with the same id or a
    null id each give a row; texts of any length go whole; only id and text are
    read, so other columns cannot clash; an empty table gives no rows.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        tables = [counter(tokenizer_path).table(t or "") for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), _bytes_of(part.column(1)), pa.array(tables, pa.list_(pa.int32()))], names=[id_col, "n_bytes", "counts"])

    return map_texts(docs, [id_col, text_col], run, f"{id_col} long, n_bytes long, counts array<int>")


def tokens_of(counts: Column, k: Column | int) -> Column:
    """Tokens of the first `k` code points; null beyond the text."""
    return F.get(counts, k if isinstance(k, Column) else F.lit(k))


def longest_prefix(counts: Column, limit: int) -> Column:
    """Code points of the longest prefix of at most `limit` tokens; null if there is none (a negative limit).

    A longer prefix may have fewer tokens, so the whole table is looked through.
    """
    fits = F.transform(counts, lambda n, k: F.when(n <= limit, k))
    return F.array_max(fits)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: (id, n_bytes, n_tokens, over_limit), the last element of each table of `prefix_counts`.

    The same cases hold; tables of runs are not kept, only their last elements.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(tokenizer_path).count([t or "" for t in part.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([part.column(0), _bytes_of(part.column(1)), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_texts(docs, [id_col, text_col], run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")


def _bytes_of(texts: pa.Array) -> pa.Array:
    return pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
