"""Licence scan with a generalised suffix automaton over the tokens of licence templates.

The automaton holds every token sequence that occurs inside a template.  A file
is streamed through it once: at each word the state and length give the longest
suffix of the words so far that stands in some template (matching statistics).
Maximal matches of at least `min_match` words, or any match of a whole template,
are chained in template order into spans, and the covered share of the template
decides the label.

Short phrases (`BASE`) are templates too; each of their places is counted from
the states that end one.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lontar.llm.batches import map_texts
from lontar.llm.license_texts import LINES, TEXTS

#: Phrases whose places are counted, with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Whole licences, notices and grant lines, with their labels.
TEMPLATES = TEXTS | LINES

#: Words of a maximal match that may enter a chain.
MIN_MATCH = 3
#: Covered share of a template from which its label is given.
MIN_COVER = 0.75
#: Text words that may stand between two matches of one chain.
MAX_GAP = 8

_FOLD = bytes(ord(" ") if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and everything beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


class TemplateAutomaton:
    """Generalised suffix automaton over word ids of all templates."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.base = base
        self.templates = [(words_of(t), label, t in base) for t, label in [*base.items(), *templates.items()]]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words, _, _ in self.templates:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
        n = len(self.next)
        #: places[state]: (template, end) of every occurrence of the state's strings.
        self.places: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        #: ends[state]: base phrases that are suffixes of the state's longest string, as (words, label).
        self.ends: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for k, (words, label, is_base) in enumerate(self.templates):
            state = 0
            for end, w in enumerate(words, 1):
                state = self.next[state][self.vocabulary[w]]
                s = state
                while s:
                    self.places[s].append((k, end))
                    s = self.link[s]
            if is_base:
                self.ends[state].append((len(words), label))
        #: whole[state]: places of templates that are no longer than the state's longest string.
        self.whole = [[(k, end) for k, end in places if len(self.templates[k][0]) <= self.length[s]] for s, places in enumerate(self.places)]
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.ends[s] = self.ends[s] + self.ends[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for its strings of at most length[p] + 1 words."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def scan(self, words: list[bytes], min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP) -> dict:
        """Base places, template spans (label, first word, end, cover) and the best cover of one file."""
        known = self.vocabulary.get
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int, int]] = []  # template, start in it, start in the text, words
        state = size = 0
        peak = (0, 0, 0)  # state, size and end of the match that is growing

        def close() -> None:
            s, n, end = peak
            if n >= min_match:
                matches.extend((k, at - n, end - n, n) for k, at in self.places[s])
            else:
                matches.extend((k, at - n, end - n, n) for k, at in self.whole[s] if n >= len(self.templates[k][0]))

        for i, c in enumerate(map(known, words)):
            if c is None:
                if size:
                    close()
                    state = size = 0
                    peak = (0, 0, 0)
                continue
            if c not in self.next[state] and state:
                close()
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
            following = self.next[state].get(c)
            if following is None:
                state = size = 0
                peak = (0, 0, 0)
                continue
            state, size = following, size + 1
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            peak = (state, size, i + 1)
            for n, label in self.ends[state]:
                if n <= size:
                    base.append((i + 1 - n, label))
        if size:
            close()
        return {"base": base, "spans": self._chain(matches, min_cover, max_gap), "score": self.best}

    def _chain(self, matches: list[tuple[int, int, int, int]], min_cover: float, max_gap: int) -> list[tuple[str, int, int, float]]:
        """Chains of matches that go forward in a template and in the text; spans of those that cover enough."""
        self.best = 0.0
        open_chains: dict[int, list[list[int]]] = {}
        chains: list[tuple[int, int, int, int]] = []
        for k, at, start, n in sorted(set(matches), key=lambda m: (m[2], m[1], -m[3])):
            near = [c for c in open_chains.get(k, []) if start - c[2] <= max_gap]
            chains.extend((k, c[1], c[2], c[3]) for c in open_chains.get(k, []) if start - c[2] > max_gap)
            fits = [c for c in near if c[0] <= at and c[2] <= start]
            if fits:
                c = max(fits, key=lambda c: c[3])
                c[0], c[2], c[3] = at + n, start + n, c[3] + n
            else:
                near.append([at + n, start, start + n, n])
            open_chains[k] = near
        chains.extend((k, c[1], c[2], c[3]) for k, cs in open_chains.items() for c in cs)
        spans = []
        for k, start, end, covered in chains:
            words, label, _ = self.templates[k]
            cover = covered / len(words)
            self.best = max(self.best, cover)
            if cover >= min_cover:
                spans.append((label, start, end, cover))
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(maxsize=4)
def _automaton(base: tuple, templates: tuple) -> TemplateAutomaton:
    return TemplateAutomaton(dict(base), dict(templates))


SCHEMA = "{id} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels and spans of every row's text.

    Null and empty texts have no words, no places and score 0.  Each row gives a
    row, repeated or null ids included; texts of any length go whole; only id and
    text are read; an empty table gives none.  Word positions count from 0; a span ends before its `end`.  `score` is the largest
    covered share of any template.
    """
    key = (tuple(base.items()), tuple(templates.items()))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(*key)
        rows = []
        for words in map(words_of, part.column(1).to_pylist()):
            found = automaton.scan(words)
            starts = [s for s, _ in found["base"]]
            own = {label for _, label in found["base"]}
            spans = [dict(zip(("label", "start", "end", "cover"), s, strict=True)) for s in found["spans"]]
            rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s["label"] for s in spans})), min(1.0, found["score"]), spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_texts(docs, [id_col, text_col], run, SCHEMA.format(id=id_col))
