"""Main text of web pages by nearest-URL page differencing.

A page's markup is cut into text lines, one a block element.  Elements that by
definition hold no main text (scripts, navigation, footers, forms, ...) or that
their names mark as such are not cut into lines at all.  The pages of a host are
sorted by URL path and each is held against its nearest ones; the lines of both
are aligned by a longest common subsequence, and shared lines are deleted as the
site's template:

- in a page without an article (or main) element, the lines that it shares with
  the nearest page whose path agrees longest with its own;
- inside an article, the lines that it shares with all of the NEAR pages before
  and the NEAR pages behind it.  One neighbour is not enough there: articles of
  one host share sentences, and copies of an article share all of it.

Structure comes first because differencing alone cannot give right results:
menus, adverts and footers that change from page to page are in no common
subsequence (figures are in the README).
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.batches import map_texts
from lontar.llm.shared import cut
from lontar.llm.substring_dedup import pack, unpack
from lontar.llm.url_cascade import host_column, path_column

#: Elements whose text is never main text, those whose content is raw text, elements without
#: content, and elements that begin and end a line.
LEFT_OUT = frozenset("nav footer aside script style noscript template svg iframe button select textarea dialog menu head".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Words in a class, id or role that mark an element as no main text, unless one of the second list stands first
#: ("has-sidebar" names a page that has one).
PARTS = frozenset("ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer masthead menu nav navbar navigation newsletter notice pagination popup promo related respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
QUALIFIERS = frozenset("has is no not with without".split())
#: Kinds of lines: outside, in an article or main that stands in an element left out by name, in a main element,
#: in an article.  A page's text is made of its greatest kind.
PLAIN, NESTED, MAIN, ARTICLE = "0", "1", "2", "3"
KINDS = {"main": MAIN, "article": ARTICLE}
#: How much of an element is left out: nothing, all but an article or main in it, the same if nothing better is there, all.
KEPT, FORM, NAMED, GONE = range(4)
#: Elements that a start of another of the group closes.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option"])}
#: Pages on either side that a page is held against.
NEAR = 3
#: Ranges whose edges are compared in one task.
FAN = 32
#: Bits of a table of an alignment that is held whole; larger ones are halved.
TABLE_BITS = 1 << 28
#: Rows and characters of an output batch.
OUT_ROWS, OUT_CHARS = 256, 1 << 22

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
#: A tag that the end of the page cuts off.
_CUT_OFF = re.compile(r"</?[a-zA-Z][^>]*\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_VALUES = re.compile(r"\"[^\"]*\"|'[^']*'")
_PIECES = re.compile(r"[^a-z]+")


def _marked(attributes: str) -> set[str]:
    """Words that mark the element as no main text."""
    found: set[str] = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            pieces = [w for w in _PIECES.split(name) if w]
            if pieces and pieces[0] not in QUALIFIERS:
                found |= PARTS.intersection(pieces)
    return found


def page_lines(source: str) -> list[str]:
    """Lines of a page outside the parts that are left out, each behind the digit of its kind.

    An article or main element inside an element that is left out by its names
    alone, or inside a form, is kept; reader comments never are.
    """
    lines: list[str] = []
    text: list[str] = []
    stack: list[tuple[str, int, str]] = []
    out, kind = KEPT, PLAIN

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(kind + line)

    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m[0] == "<" and _CUT_OFF.match(source, at):
            break
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                if not out:
                    text.append(token)
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, out, kind = stack[k]
                    del stack[k:]
                    break
                # Inline elements do not reach over the end of a block, nor do blocks over the end of an article.
                if name not in BLOCK and stack[k][0] in BLOCK or stack[k][0] in KINDS and name not in ("body", "html"):
                    break
            continue
        if name in BLOCK:
            flush()
        elif name == "br" and not out:
            text.append(" ")
        while stack and name in CLOSES.get(stack[-1][0], ()):
            _, out, kind = stack.pop()
        # Inline elements left open inside a paragraph end with it.
        if name in BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in BLOCK:
                    if stack[k][0] == "p":
                        _, out, kind = stack[k]
                        del stack[k:]
                    break
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        stack.append((name, out, kind))
        marked = _marked(m[3]) if m[3] and name not in ("html", "body") else set()
        if name in LEFT_OUT or name == "header" and kind == PLAIN or marked & {"comment", "comments"} or m[3] and _HIDDEN.search(_VALUES.sub("", m[3])):
            out = GONE
        elif name in KINDS and out < GONE:
            kind = NESTED if out == NAMED or kind == NESTED else max(kind, KINDS[name])
            out = KEPT
        elif name not in KINDS and (marked or name == "form"):
            out = max(out, NAMED if marked else FORM)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
            at = end.start() if end else len(source)
    flush()
    return lines


def _rows_of(a: list[int], b: list[int]) -> list[int]:
    """For each prefix of a: bit j is 0 where the subsequence grows with b[j]."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a and each prefix of b."""
    v = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = v
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned(a: list[int], b: list[int], first: int) -> Iterator[int]:
    """Indices (from `first`) of a longest common subsequence in a."""
    if not a or not b:
        return
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        split = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        yield from _aligned(a[:half], b[:split], first)
        yield from _aligned(a[half:], b[split:], first + half)
        return
    size = len(b) // 8 + 1
    rows = [v.to_bytes(size, "little") for v in _rows_of(a, b)]
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1][j - 1 >> 3] >> (j - 1 & 7) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1][j - 1 >> 3] >> (j - 1 & 7) & 1:
                j -= 1
                yield first + i


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of a longest common subsequence of a and b in a."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    numbers: dict[str, int] = {}
    # Lines that only one side has are in no common subsequence.
    of_b = {x: numbers.setdefault(x, len(numbers)) for x in b[head : len(b) - tail]}
    kept = [(i, of_b[a[i]]) for i in range(head, len(a) - tail) if a[i] in of_b]
    of_a = {x for _, x in kept}
    others = [y for y in map(of_b.__getitem__, b[head : len(b) - tail]) if y in of_a]
    return found | {kept[k][0] for k in _aligned([x for _, x in kept], others, 0)}


def _agreement(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def main_text(row: dict, before: list[dict], after: list[dict]) -> str:
    """Text of a page between its neighbours; pages have host, path and lines (`own`)."""
    lines = row["own"]
    kind = max((x[0] for x in lines), default=PLAIN)
    near = [n for n in (*before[::-1], *after) if row["host"] and n["host"] == row["host"] and n["own"] != lines]
    gone: set[int] = set()
    if kind == PLAIN and near:
        gone = shared_lines(lines, max(near, key=lambda n: _agreement(n["path"], row["path"]))["own"])
    elif len(near) == 2 * NEAR:
        gone = set.intersection(*(shared_lines(lines, n["own"]) for n in near))
    return "\n\n".join(x[1:] for i, x in enumerate(lines) if x[0] == kind and i not in gone)


_PAGE = "id long, url string, host string, path string, lines binary"
_EDGE = f"{_PAGE}, part int, at long, waits boolean"
_RESULT = "id long, url string, text string, n_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            yield from batch.slice(at, OUT_ROWS).to_pylist()


def _written(rows: Iterator[dict], names: list[str], sized: str) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.int64(), "n_chars": pa.int64(), "at": pa.int64(), "part": pa.int32(), "waits": pa.bool_(), "lines": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    done: list[dict] = []
    size = 0
    for r in rows:
        done.append(r)
        size += len(r[sized])
        if len(done) == OUT_ROWS or size > OUT_CHARS:
            yield pa.RecordBatch.from_pylist(done, schema)
            done, size = [], 0
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def _opened(r: dict) -> dict:
    text = unpack(r["lines"]).decode()
    return r | {"own": text.split("\n") if text else []}


def _between(rows: Iterator[dict]) -> Iterator[tuple[list[dict], dict, list[dict]]]:
    """Each row between the up to NEAR rows before and behind it."""
    before: deque[dict] = deque(maxlen=NEAR)
    ahead: deque[dict] = deque()

    def step() -> tuple[list[dict], dict, list[dict]]:
        row = ahead.popleft()
        found = list(before), row, list(ahead)
        before.append(row)
        return found

    for r in rows:
        ahead.append(r)
        if len(ahead) > NEAR:
            yield step()
    while ahead:
        yield step()


def _judged(groups: Iterator[Iterator[dict]], whole: bool) -> Iterator[dict]:
    """Results of the waiting rows of each group that have all their neighbours there; of all of them in a whole one."""
    for group in groups:
        for before, row, after in _between(map(_opened, group)):
            if row.get("waits", True) and (whole or len(before) == len(after) == NEAR):
                text = main_text(row, before, after)
                yield {"id": row["id"], "url": row["url"], "text": text, "n_chars": len(text)}


def _edges(groups: Iterator[Iterator[dict]], part: int | None) -> Iterator[dict]:
    """First and last rows of each group, with what they need to be judged; rows of the first level get their place."""
    for group in groups:
        first: list[dict] = []
        last: deque[tuple[int, dict]] = deque(maxlen=2 * NEAR)
        n = 0
        for r in group:
            if part is not None:
                r = r | {"part": part, "at": n, "waits": True}
            if n < 2 * NEAR:
                first.append(r)
            else:
                last.append((n, r))
            n += 1
        for k, r in [*enumerate(first), *last]:
            yield r | {"waits": r["waits"] and (k < NEAR or k >= n - NEAR)}


def _compared(pages: DataFrame, ranges: int) -> DataFrame:
    """Results of all rows of `_PAGE`, level by level.

    Pages are dealt by ranges of host and path, so a host of any size is spread
    over tasks.  What stands at the edges of ranges (some rows each) is compared
    again with the edges of the next ranges, FAN ranges a group, and so on until
    one group holds all: no task grows with the table.
    """
    order = ["host", "path", "id", F.xxhash64("lines", "url")]
    # Two plans read every level.  Bounds of ranges are sampled anew for each exchange, so this one is written: both must
    # find the same pages in a range, whether or not Spark reuses the exchange.
    level = cut(pages.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    results = []
    groups, part, width = ranges, True, 1
    while True:
        whole = groups == 1

        def dealt(batches: Iterator[pa.RecordBatch], first: bool = part) -> Iterator[Iterator[dict]]:
            rows = _read(batches)
            return iter([rows]) if first else (g for _, g in groupby(rows, key=lambda r: r["block"]))

        def judge(batches: Iterator[pa.RecordBatch], dealt=dealt, whole: bool = whole) -> Iterator[pa.RecordBatch]:
            return _written(_judged(dealt(batches), whole), ["id", "url", "text", "n_chars"], "text")

        def edges(batches: Iterator[pa.RecordBatch], dealt=dealt, first: bool = part) -> Iterator[pa.RecordBatch]:
            found = _edges(dealt(batches), TaskContext.get().partitionId() if first else None)
            return _written(found, ["id", "url", "host", "path", "lines", "part", "at", "waits"], "lines")

        results.append(level.mapInArrow(judge, _RESULT))
        if whole:
            break
        width *= FAN
        groups, part = -(-ranges // width), False
        found = level.mapInArrow(edges, _EDGE).withColumn("block", F.floor(F.col("part") / width).cast("int"))
        level = found.repartition(groups, "block").sortWithinPartitions("block", "part", "at")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    A null or empty page has an empty text.  Pages without a host (null URLs
    among them) and pages without another page of their host near them are not
    compared; a neighbour with the very same lines is a copy, which says nothing
    about the template, and is passed over.  Pages of any length go whole.  Rows
    with repeated or null ids each give a row; further columns of the input are
    not read, so their names do no harm; an empty table gives none.
    """
    url = F.col("url")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    source = source.select("id", "url", host_column(url).alias("host"), path_column(url).alias("path"), "html")

    def parse(part: pa.RecordBatch) -> pa.RecordBatch:
        packed = [pack("\n".join(page_lines(h or ""))) for h in part.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(packed, pa.binary())], names=["id", "url", "host", "path", "lines"])

    lines = map_texts(source, ["id", "url", "host", "path", "html"], parse, _PAGE)
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _compared(lines, ranges).select(F.col("id").alias(id_col), F.col("url").alias("url"), "text", "n_chars")
