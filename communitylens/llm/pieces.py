"""SentencePiece BPE encoding and decoding with a prefix table.

For every prefix of a unit the table stores the one token that the prefix's encoding ends
with: the token ends there (an Aho-Corasick match) and may follow the token that the shorter
prefix ends with. Which two tokens may stand side by side follows from undoing their merges,
latest first: no merge across the border may come before the merges that hid its parts.
The ids are then read off backwards.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Encoded units that a task remembers at most; it starts anew beyond them.
MEMORY = 400_000
#: Units from this length on are not remembered.
LONG = 64
#: Texts that are encoded between two results: their ids and decoded texts stand beside what is remembered.
ROWS = 100


class Vocabulary:
    """A model's pieces in plain tables; small enough to be sent with each task (32,000 pieces: about 3 MB)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.control = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        usable = [i for i in range(n) if i not in self.control and not model.is_byte(i) and not model.is_unused(i)]
        self.ids = {self.pieces[i]: i for i in usable}
        scores = sorted({model.get_score(i) for i in usable}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        self.rank = {i: place[model.get_score(i)] for i in usable}
        self.pairs = {}
        for i in usable:
            piece = self.pieces[i]
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self.parts = {}  # the last merge of each piece that its own text is encoded as
        for i in usable:
            if len(self.pieces[i]) > 1:
                ids, last = self.merge([self.ids.get(c) for c in self.pieces[i]]) if all(c in self.ids for c in self.pieces[i]) else ([], None)
                if ids == [i]:
                    self.parts[i] = last

    @classmethod
    def of(cls, tables: dict) -> Vocabulary:
        """The vocabulary whose ``vars`` these are."""
        out = cls.__new__(cls)
        vars(out).update(tables)
        return out

    def merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """Merge pairs, best rank first and leftmost among equals; also gives the last pair merged."""
        ids, n, last = list(ids), len(ids), None
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[c], k, ids[k], ids[k + 1], c) for k in range(n - 1) if (c := self.pairs.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, c = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j], last = c, None, (a, b)
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (z := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (self.rank[z], x, ids[x], ids[y], z))
        return [i for i in ids if i is not None], last


class Pieces:
    """Encodes and decodes texts with one vocabulary, remembering units."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.single = {p: i for p, i in vocabulary.ids.items() if len(p) == 1}
        self.matcher = ahocorasick.Automaton()
        for piece, i in vocabulary.ids.items():
            if len(piece) == 1 or i in vocabulary.parts:
                self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()
        self.sizes = [len(p) for p in vocabulary.pieces]
        self.inside = {p[k:k + 2] for p in vocabulary.ids for k in range(len(p) - 1)}
        self.side_by_side: dict[int, bool] = {}
        # ids as bytes, which take less memory than lists; a unit stands there without its first space
        self.parts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.text = [p.replace(SPACE, " ") for p in vocabulary.pieces]
        for i in vocabulary.control:
            self.text[i] = " ⁇ " if i == vocabulary.unknown else ""
        self.byte = {i: b for b, i in vocabulary.bytes.items()}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' joined text is just these two."""
        v, hidden_left, hidden_right = self.v, float("inf"), float("inf")
        while True:
            across = v.pairs.get((a, b))
            if across is not None and v.rank[across] < hidden_left and v.rank[across] <= hidden_right:
                return False
            left, right = v.parts.get(a), v.parts.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and v.rank[a] > v.rank[b]):
                hidden_left, a = v.rank[a], left[1]
            else:
                hidden_right, b = v.rank[b], right[0]

    def _table(self, unit: str) -> list[int]:
        """Ids of a unit of known characters."""
        last = [-1] * (len(unit) + 1)
        allowed = self.side_by_side
        for end, (size, token) in self.matcher.iter(unit):
            end += 1
            if last[end] >= 0:
                continue
            if size == end:
                last[end] = token
                continue
            before = last[end - size]
            if before >= 0:
                pair = before << 24 | token
                good = allowed.get(pair)
                if good is None:
                    good = allowed[pair] = self.may_follow(before, token)
                if good:
                    last[end] = token
        out, at, sizes = [], len(unit), self.sizes
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _unit(self, unit: str) -> list[int]:
        """Ids of a unit, part by part: no piece reaches across two characters that stand side by side in none."""
        out: list[int] = []
        start, before = 0, ""
        for k, c in enumerate(unit):
            if before + c not in self.inside:
                if start < k:
                    out += self._remembered(unit[start:k])
                start = k
            before = c
        if not start:  # a unit of one part is remembered as a unit
            return self._part(unit)
        out += self._remembered(unit[start:])
        return out

    def _remembered(self, part: str) -> array:
        # a unit's first part may be a unit itself
        memory, name = (self.known, part[1:]) if part[0] == SPACE else (self.parts, part)
        ids = memory.get(name)
        if ids is None:
            ids = array("i", self._part(part)).tobytes()
            if len(part) < LONG:
                memory[name] = ids
        return array("i", ids)

    def _part(self, part: str) -> list[int]:
        if len(part) == 1 and part not in self.single:
            return [self.v.bytes[b] for b in part.encode()]
        if part.startswith(SPACE * 2):
            # pieces of spaces alone share one score, so their merges have no fixed order: merge them one by one
            return self.v.merge([self.single[c] for c in part])[0]
        return self._table(part)

    def encode(self, text: str) -> list[int]:
        """All ids without begin or end."""
        if not text:
            return []
        for memory in (self.known, self.parts, self.side_by_side):
            if len(memory) > MEMORY:
                memory.clear()
        known = self.known
        rest = text.replace(" ", SPACE).split(SPACE)
        if "" in rest:  # several spaces in a row stay one unit with the word after them
            rest = [unit[1:] for unit in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + SPACE.join(rest))]
        found = []
        for unit in rest:
            ids = known.get(unit)
            if ids is None:
                ids = array("i", self._unit(SPACE + unit)).tobytes()
                if len(unit) < LONG:
                    known[unit] = ids
            found.append(ids)
        return array("i", b"".join(found)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD each, the first piece's leading space goes."""
        byte, text = self.byte, self.text
        if byte.keys().isdisjoint(ids):
            out = "".join([text[i] for i in ids])
        else:
            parts, raw = [], bytearray()
            for i in ids:
                if i in byte:
                    raw.append(byte[i])
                    continue
                if raw:
                    parts.append(_utf8(raw))
                    raw = bytearray()
                parts.append(text[i])
            if raw:
                parts.append(_utf8(raw))
            out = "".join(parts)
        first = next((i for i in ids if text[i]), self.v.end)
        return out[1:] if self.v.pieces[first].startswith(SPACE) else out


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (4, 3, 2, 1):
                try:
                    if len(text := raw[at:at + size].decode()) == 1:
                        out.append(text)
                        at += size
                        break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _listed(rows: list[list[int]]) -> pa.Array:
    bounds = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.asarray(x, np.int32) for x in rows]) if rows else [], pa.int32()))


def encode(df: DataFrame, key: str, model: str) -> DataFrame:
    """Add to ``key`` the ids of the whole text with an end id, and the text decoded from them.

    Columns: key, ids array<int>, decoded string. A null text is empty: its only id is the end id.
    Every row of ``df`` gives a row; other columns are not used.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(Vocabulary(model)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(Vocabulary.of(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [pieces.encode(text or "") + [pieces.v.end] for text in part.column("text").to_pylist()]
                texts = pa.array([pieces.decode(ids) for ids in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(key), _listed(rows), texts], [key, "ids", "decoded"])

    return df.select(key, df["text"].cast("string").alias("text")).mapInArrow(
        run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>, decoded string"
    )
