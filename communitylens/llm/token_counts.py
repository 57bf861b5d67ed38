"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

New pre-tokens of a batch stand in one flat array of symbols. In every round each sequence
finds its lowest-ranked pair and merges all places of that pair at once, without overlaps;
the symbols that are left are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counted words that a task remembers at most; it starts anew beyond them.
MEMORY = 400_000
#: Texts whose new words are counted together.
ROWS = 500
#: Splits text into pre-tokens (a fixed value of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merges:
    """The merges of a byte-level BPE file as sorted arrays; bounded by the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids, merges = content["model"]["vocab"], content["model"]["merges"]
        if content["pre_tokenizer"]["add_prefix_space"] or content["normalizer"]:
            raise ValueError("only plain byte-level files are read")
        self.special = [t["content"] for t in content["added_tokens"]]
        printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        self.byte_ids = np.zeros(256, np.int64)
        for b in printable:
            self.byte_ids[b] = ids[chr(b)]
        for k, b in enumerate(others):
            self.byte_ids[b] = ids[chr(256 + k)]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank

    @classmethod
    def of(cls, tables: dict) -> Merges:
        """The merges whose ``vars`` these are."""
        out = cls.__new__(cls)
        vars(out).update(tables)
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where there is none."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty sequence of bytes."""
        out = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        sizes, owners = out.copy(), np.arange(len(tokens))
        none = len(self.keys)
        ranks = self.pair_ranks(symbols[:-1], symbols[1:])
        ranks = np.append(ranks, none)
        ranks[np.cumsum(sizes) - 1] = none  # a pair lies within one sequence
        while len(symbols):
            ends = np.cumsum(sizes)
            lowest = np.minimum.reduceat(ranks, ends - sizes)
            going = lowest < none
            if not going.all():
                out[owners[~going]] = sizes[~going]
                kept = np.repeat(going, sizes)
                symbols, ranks, sizes, owners, lowest = symbols[kept], ranks[kept], sizes[going], owners[going], lowest[going]
                if not len(symbols):
                    break
                ends = np.cumsum(sizes)
            merging = ranks == np.repeat(lowest, sizes)
            # of adjoining places only every second merges, from the left
            places = np.arange(len(symbols))
            head = merging & ~np.concatenate([[False], merging[:-1]])
            from_head = places - np.maximum.accumulate(np.where(head, places, 0))
            merging &= from_head % 2 == 0
            at = np.flatnonzero(merging)
            symbols[at] = self.made[ranks[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            gone = np.add.reduceat(merging.astype(np.int64), ends - sizes)
            touched = np.zeros(len(symbols), bool)  # pairs whose left or right symbol is new
            touched[at] = True
            touched[at[at > 0] - 1] = True
            symbols, ranks, touched = symbols[kept], ranks[kept], np.flatnonzero(touched[kept])
            sizes = sizes - gone
            following = np.minimum(touched + 1, len(symbols) - 1)
            ranks[touched] = self.pair_ranks(symbols[touched], symbols[following])
            ranks[np.cumsum(sizes) - 1] = none
        return out


class Counter:
    """Counts tokens of texts, remembering words."""

    def __init__(self, merges: Merges):
        import regex

        self.merges, self.pattern = merges, regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in merges.special)) if merges.special else None
        self.spaced = regex.compile(r"\s ")
        self.known: dict[str, int] = {}

    def _pieces(self, text: str) -> list[str]:
        """Pieces that pre-tokens never cross: a space after a visible character starts a new one."""
        if self.spaced.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > MEMORY:
            self.known.clear()
        rows, extra = [], []
        for text in texts:
            parts = [text]
            if self.special and (n := len(self.special.findall(text))):
                parts = self.special.split(text)
                extra.append(n)
            else:
                extra.append(0)
            rows.append([piece for part in parts if part for piece in self._pieces(part)])
        new = list({piece for row in rows for piece in row} - self.known.keys())
        if new:
            tokens = [self.pattern.findall(piece) for piece in new]
            distinct = list({t for row in tokens for t in row})
            size = dict(zip(distinct, self.merges.count([t.encode() for t in distinct]).tolist(), strict=True))
            self.known.update((piece, sum([size[t] for t in row])) for piece, row in zip(new, tokens, strict=True))
        known = self.known
        return [sum([known[piece] for piece in row]) + n for row, n in zip(rows, extra, strict=True)]


def count(df: DataFrame, key: str, path: str, limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row's whole text.

    A null text counts as empty (no tokens). Special strings inside a text are one token each.
    Every row of ``df`` gives a row; other columns are not used.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(Merges(path)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Merges.of(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                tokens = counter.counts(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column(key), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ], [key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, df["text"].cast("string").alias("text")).mapInArrow(
        run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
