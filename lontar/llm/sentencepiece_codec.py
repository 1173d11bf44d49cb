"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps, for one chunk of text, an agenda of adjacent symbol pairs that
form a vocabulary piece, ordered by score (ties: leftmost), and merges the best
pair until none is left; symbols outside the vocabulary fall back to bytes.
Short chunks that are met together have their agendas as rows of one array.

Chunks come from the vocabulary itself: where no piece contains the two
character classes at a boundary side by side, no merge can cross it, so the
text is cut there and each distinct chunk is encoded once for a worker.  All
chunks that a worker encodes for the first time are encoded by the
sentencepiece library too, in one call an Arrow batch, and must agree.

Nulls count as empty text; an empty text has the end id alone.
"""

from __future__ import annotations

import heapq
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lontar.llm.batches import map_texts, remembered

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
#: Chunks that a worker remembers anew before those that it has not met since are let go; at most twice as many are held.
MEMO_CHUNKS = 32_768
#: Longer chunks are encoded each time they occur.
MEMO_CHARS = 40
#: Characters of chunks whose agendas stand side by side, by steps; longer chunks and few ones have a heap each.
WIDTHS, FEW_CHUNKS = (8, 12, 16, 24, 40), 16
#: More than the places of such a chunk.
PLACES = 64
#: Code points whose symbols stand in an array.
COMMON_CHARS = 0x2600


class PairTable:
    """Adjacent symbols that form a piece, as a hash table of numbers; a symbol is a piece or a character.

    A piece has its id, another character a number behind the last id.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float], pieces: int):
        self.ids, self.pieces = ids, pieces
        self.nothing = pieces + 0x110000
        # Ranks of scores, the highest first; equal scores have equal ranks.
        ranks = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.never = len(ranks)
        self.rank = np.full(pieces + 1, self.never, np.int64)
        pairs: dict[int, int] = {}
        for piece, i in ids.items():
            self.rank[i] = ranks[scores[piece]]
            for k in range(1, len(piece)):
                a, b = self.symbol(piece[:k]), self.symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = i
        #: Slots of two symbols and their piece, 21 bits each.
        entries = np.fromiter((key << 21 | i for key, i in pairs.items()), np.int64, len(pairs))
        self.bits = max(4, (2 * len(entries)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        at = self._slots(entries >> 21)
        while len(entries):
            free = self.slots[at] == -1
            self.slots[at[free]] = entries[free]
            # Of several entries for a slot one stays; the others try the next.
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & (len(self.slots) - 1)
        self.common = np.array([self.symbol(chr(k)) for k in range(COMMON_CHARS)], np.int64)

    def symbol(self, text: str) -> int | None:
        i = self.ids.get(text)
        return self.pieces + ord(text) if i is None and len(text) == 1 else i

    def symbols_of(self, text: str) -> np.ndarray:
        """Symbols of the characters of a text."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.common[np.minimum(chars, COMMON_CHARS - 1)]
        rare = np.flatnonzero(chars >= COMMON_CHARS)
        found[rare] = [self.symbol(chr(k)) for k in chars[rare].tolist()]
        return found

    def bytes_of(self, symbol: int, byte_ids: list[int]) -> list[int]:
        return [byte_ids[b] for b in chr(symbol - self.pieces).encode()]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that two symbols form; the number of pieces if they form none."""
        keys = (a << 21 | b).ravel()
        at = self._slots(keys)
        met = self.slots[at]
        found = np.where(met >> 21 == keys, met & 0x1FFFFF, self.pieces)
        astray = np.flatnonzero((met >> 21 != keys) & (met != -1))
        while len(astray):
            at[astray] = (at[astray] + 1) & (len(self.slots) - 1)
            met = self.slots[at[astray]]
            here = met >> 21 == keys[astray]
            found[astray[here]] = met[here] & 0x1FFFFF
            astray = astray[~here & (met != -1)]
        return found.reshape(a.shape)


class MergeCodec:
    """Encoder and decoder for the BPE model in `path` (identity normaliser, dummy prefix)."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = lib.eos_id()
        self.unknown_id = lib.unk_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [self.unknown_id] * 256
        self.pieces = [""] * lib.get_piece_size()
        self.byte_of: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.ids[piece], self.scores[piece] = i, lib.get_score(i)
                self.pieces[i] = piece
        self.table = PairTable(self.ids, self.scores, len(self.pieces))
        self.latin = re.compile(f"[{LATIN}]")
        self.chunk = re.compile(self._chunk_pattern(), re.S)
        #: Chunks met of late, and those met before them: what is met again is taken over.
        self.memo: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _chunk_pattern(self) -> str:
        """Widest cutting rule that no vocabulary piece crosses."""
        pairs = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        if any(b == SPACE != a for a, b in pairs):
            return ".+"
        crossing = [p for p in pairs if p[0] != SPACE and bool(self.latin.match(p[0])) != bool(self.latin.match(p[1]))]
        if crossing:
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"{SPACE}*[{LATIN}]+|{SPACE}*[^{SPACE}{LATIN}]+|{SPACE}+"

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk, by the agenda of adjacent pairs."""
        symbols: list[str] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores = self.scores
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (score := scores.get(pair)) is not None:
                agenda.append((-score, i, i + 1, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, pair = pop(agenda)
            # Either side merged meanwhile: the pair no longer stands there.
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                longer = pair + symbols[k]
                if (score := scores.get(longer)) is not None:
                    push(agenda, (-score, i, k, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if (score := scores.get(longer)) is not None:
                    push(agenda, (-score, h, i, longer))
        out: list[int] = []
        for s in symbols:
            if s:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out.extend(self.byte_ids[b] for b in s.encode())
        return out

    def merge_all(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; those of like length have their agendas side by side, as rows of one array."""
        out: list[list[int]] = [[]] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        most = 0
        for least, most in zip((0, *WIDTHS), WIDTHS, strict=False):
            of = np.flatnonzero((sizes > least) & (sizes <= most))
            if len(of) < FEW_CHUNKS:
                rows = [self.merge(chunks[k]) for k in of]
            else:
                rows = self._merge_rows([chunks[k] for k in of], sizes[of], most)
            for k, row in zip(of.tolist(), rows, strict=True):
                out[k] = row
        for k in np.flatnonzero(sizes > most).tolist():
            out[k] = self.merge(chunks[k])
        return out

    def _merge_rows(self, chunks: list[str], sizes: np.ndarray, width: int) -> list[list[int]]:
        table, n, end = self.table, len(chunks), PLACES * self.table.never
        # Each chunk is a column; behind its symbols, and in a last row that ends all columns, there is nothing.
        symbols = np.full((width + 1, n), table.nothing, np.int64)
        symbols[:width].T[np.arange(width) < sizes[:, None]] = table.symbols_of("".join(chunks))
        places = np.arange(width + 1)
        after, before = (np.repeat(p, n) for p in (places + 1, np.roll(places, 1)))
        formed = np.full((width + 1, n), table.pieces)
        formed[:width] = table.merged(symbols[:-1], symbols[1:])
        agenda = PLACES * table.rank[formed] + places[:, None]
        entries, formed, flat = agenda.reshape(-1), formed.reshape(-1), symbols.reshape(-1)
        while True:
            # The least cost of each chunk, the leftmost of equal ones.
            least = agenda.min(axis=0)
            each = np.flatnonzero(least < end)
            if not len(each):
                break
            place = least[each] % PLACES
            i = place * n + each
            j = after[i] * n + each
            behind, ahead = after[j], before[i]
            k, h = behind * n + each, ahead * n + each
            pair = formed[i]
            flat[i], flat[j] = pair, table.nothing
            after[i], before[k] = behind, place
            entries[j] = end
            formed[i], formed[h] = table.merged(pair, flat[k]), table.merged(flat[h], pair)
            entries[h] = PLACES * table.rank[formed[h]] + ahead
            entries[i] = PLACES * table.rank[formed[i]] + place
        done = symbols.T
        kept = done != table.nothing
        ids, ends = done[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        plain = (np.where(kept, done, 0) < len(self.pieces)).all(axis=1).tolist()
        found = [ids[start:stop] for start, stop in zip([0, *ends], ends, strict=False)]
        return [row if whole else [i for s in row for i in ([s] if s < len(self.pieces) else table.bytes_of(s, self.byte_ids))] for row, whole in zip(found, plain, strict=True)]

    def surface(self, ids: list[int]) -> str:
        """Text of ids before the dummy prefix is taken off."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(self.pieces[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ")

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.merge(c)] + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text

    def learn(self, fresh: list[str]) -> dict[str, tuple[str, int, str]]:
        """Encode chunks not met before and hold them against the library."""
        found = {}
        # A chunk without the space mark is encoded behind one character that it cannot merge with.
        frames = [c[1:] if c[0] == SPACE and len(c) > 1 else ("." if self.latin.match(c) else "a") + c for c in fresh]
        for c, frame, ids, theirs in zip(fresh, frames, self.merge_all(fresh), self.library.encode(frames, num_threads=1), strict=True):
            if ids != (theirs if len(frame) < len(c) else theirs[len(self.merge(SPACE + frame[0])) :]):
                raise ValueError(f"the library encodes {frame!r} otherwise")
            found[c] = (" ".join(map(str, ids)), len(ids), self.surface(ids))
        return found

    def render(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by a space, number of ids, decoded text) of each text."""
        cut = [self.chunks(t) for t in texts]
        if len(self.memo) > MEMO_CHUNKS:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        missed = {c for chunks in cut for c in chunks} - memo.keys()
        memo.update((c, older[c]) for c in missed & older.keys())
        learned = self.learn(list(missed - older.keys()))
        memo.update((c, v) for c, v in learned.items() if len(c) <= MEMO_CHARS)
        out = []
        for chunks in cut:
            known = [memo.get(c) or learned[c] for c in chunks]
            text = "".join([k[2] for k in known])
            out.append((" ".join([k[0] for k in known] + [str(self.end_id)]), sum([k[1] for k in known]) + 1, text[1:] if text[:1] == " " else text))
        return out

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text) of each text."""
        return [(n, sha256(ids.encode()).hexdigest(), sha256(text.encode()).hexdigest()) for ids, n, text in self.render(texts)]


def codec(path: str) -> MergeCodec:
    """The worker's codec of a model file."""
    return remembered(path, lambda: MergeCodec(path))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Ids of every text: (id, ids array<int>) and, with `decoded`, the text that they stand for.

    Null and empty texts have the end id alone and decode to an empty text; rows
    with the same id or a null id each give a row; texts of any length go whole;
    only id and text are read; an empty table gives none.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(model_path).render([t or "" for t in part.column(1).to_pylist()])
        ids = [np.fromstring(f[0], np.int32, sep=" ") for f in found]
        columns = [part.column(0), pa.array(ids, pa.list_(pa.int32())), *([pa.array([f[2] for f in found], pa.string())] if decoded else [])]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return map_texts(docs, [id_col, text_col], run, f"{id_col} long, ids array<int>{', decoded string' if decoded else ''}")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids and digests of ids and decoded text for every row, in the same cases as `encode_documents`."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(model_path).digest([t or "" for t in part.column(1).to_pylist()])
        n, ids, text = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs, [id_col, text_col], run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
