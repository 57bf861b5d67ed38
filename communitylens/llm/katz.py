"""A Katz backoff language model of any order over a whole corpus, evaluated recursively.

Documents stand in a bucketed table of batches. A batch sends the hashes of its distinct grams (runs of 1 to
``order`` tokens), with its own counts, to key ranges; a range adds them up over all batches and answers each batch in
the order it asked: the total, whether any other batch asked, and whether the batch is the one that books the
gram. From three tokens on, a gram leaves its batch only if both grams of one token less occur in other batches; all others are
counted where they are. Good-Turing discounts come from counts of counts, per order. Each distinct gram is booked
once, under its context; sums per context that several batches have go to key ranges in the same way and come back as
backoff weights, sums of other contexts stay. Then every batch scores its texts token by token: the discounted gram,
or else the context's weight times the same for a context that is one token shorter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm import arrays
from communitylens.llm.store import written
from communitylens.session import checkpoint_dir

#: Text bytes of a batch (a longer text is a batch alone).
BATCH_BYTES = 12 << 20
#: Corpus bytes per key range.
RANGE_BYTES = 8 << 20
#: Counts above this are not discounted.
LARGE = 5
END, BEGIN = np.uint64(0x51ED270B90F2D4A3), np.uint64(0xB492B66FBE98F273)


class Discounts(NamedTuple):
    """Factors of the counts 0 to LARGE (others keep theirs)."""

    factors: np.ndarray

    def of(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= LARGE, self.factors[np.minimum(counts, LARGE)], 1.0)


def good_turing(types: list[int]) -> Discounts:
    """Good-Turing discounts from the number of types that occur 1, 2, ... LARGE + 1 times.

    Counts up to the largest cut-off k that gives k factors between 0 and 1 are discounted, others are not. Where no k from
    2 on does, the counts of counts are replaced by a line through their logarithms. Where that does not fall
    faster than 1 / r, or nothing occurs once (unseen types are then estimated at nothing), half a count is taken off each.
    """
    n = np.array([0, *types], float)
    for k in range(LARGE, 1, -1):
        found = _factors(n, k)
        if found is not None:
            return Discounts(np.concatenate([[1.0], found, np.ones(LARGE - k)]))
    r = np.flatnonzero(n)
    if n[1] and len(r) > 1:
        slope = np.polyfit(np.log(r), np.log(n[r]), 1)[0]
        found = _factors(np.concatenate([[0.0], np.arange(1, LARGE + 2) ** slope]), LARGE)
        if slope < -1 and found is not None:
            return Discounts(np.concatenate([[1.0], found]))
    return Discounts(np.concatenate([[1.0], 1 - 0.5 / np.arange(1, LARGE + 1)]))


def _factors(n: np.ndarray, k: int) -> np.ndarray | None:
    """Katz's factors of the counts 1 to k, or None where one is not between 0 and 1."""
    if (n[1:k + 2] == 0).any():
        return None
    rest = (k + 1) * n[k + 1] / n[1]
    if rest == 1:
        return None
    r = np.arange(1, k + 1)
    factors = ((r + 1) * n[2:k + 2] / (r * n[1:k + 1]) - rest) / (1 - rest)
    return factors if (factors > 0).all() and (factors < 1).all() else None


class Words(NamedTuple):
    """Probabilities of single words: discounted counts, and what is left for all unknown words together."""

    total: int
    types: int
    discounts: Discounts
    whole: float
    unknown: float

    @classmethod
    def of(cls, total: int, types: int, discounts: Discounts, discounted: float) -> Words:
        left = total - discounted
        whole, left = (float(total), left) if left > 1e-9 else (total + 1.0, total + 1.0 - discounted)
        return cls(total, types, discounts, whole, left / whole)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) / self.whole, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + 1.0 * (self.types + 1)))


class Tokens(NamedTuple):
    """The tokens of a batch: grams that end there by length (1 first), whether a text starts there, row."""

    grams: list[np.ndarray]
    starts: np.ndarray
    rows: np.ndarray


def begins(length: int) -> np.ndarray:
    """The hash of so many begins in a row, in an array of one."""
    found = np.array([BEGIN])
    for _ in range(length - 1):
        found = arrays.mix(arrays.mix(found) ^ BEGIN)
    return found


def tokens(column: pa.ChunkedArray | pa.Array, order: int) -> Tokens:
    """Words and one end per text; what stands before a text are begins."""
    parts, rows, done = [], [], 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for first, last, data, offsets in arrays.chunks(chunk):
            low = arrays.LOWER[data]
            starts, ends, bounds = arrays.words(low, offsets, arrays.NONSPACE)
            counts = np.diff(bounds)
            out = np.full(len(starts) + len(counts), END)
            owner = np.repeat(np.arange(len(counts)), counts)
            out[np.arange(len(starts)) + owner] = arrays.span_hashes(low, starts, ends)
            parts.append(out)
            rows.append(np.repeat(np.arange(done + first, done + last), counts + 1))
        done += len(chunk)
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    starts = np.ones(len(rows), bool)
    starts[1:] = rows[1:] != rows[:-1]
    grams = [words]
    for k in range(1, order):
        before = np.empty_like(words)
        before[1:] = grams[-1][:-1]
        before[starts] = begins(k)[0]
        grams.append(arrays.mix(arrays.mix(before) ^ words))
    return Tokens(grams, starts, rows)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, a place of each, and each key's number among them."""
    order = np.argsort(keys)
    ascending = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ascending[1:] != ascending[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(head) - 1
    return ascending[head], order[head], at


class Level(NamedTuple):
    """The distinct grams of one length in a batch."""

    types: np.ndarray
    place: np.ndarray  #: a token at which the gram ends
    at: np.ndarray  #: the gram of each token
    own: np.ndarray  #: training count in this batch
    away: np.ndarray  #: other batches may have it, so its count was asked for
    total: np.ndarray  #: training count
    alone: np.ndarray  #: no other batch has it
    booked: np.ndarray  #: this batch books it


def levels(t: Tokens, train: np.ndarray, answers: pa.Table | None, answered: int, asked: int) -> list[Level]:
    """Grams of up to ``asked`` tokens; totals of those of up to ``answered`` tokens are known."""
    found: list[Level] = []
    for k in range(1, asked + 1):
        types, place, at = distinct(t.grams[k - 1])
        own = np.bincount(at, train, len(types)).astype(np.int64)
        away = np.ones(len(types), bool)
        if k > 2:  # counts of one and two tokens are asked for together
            lower = found[-1]
            away = ~lower.alone[lower.at[place]] & (t.starts[place] | ~lower.alone[lower.at[place - 1]])
        told = own * 4 + 3
        if k <= answered:
            told[away] = _answers(answers, k, small)
        found.append(Level(types, place, at, own, away, told >> 2, (told & 2).astype(bool), (told & 1).astype(bool)))
    return found


def ranges(keys: np.ndarray, count: int) -> np.ndarray:
    """The key range of each hash; ascending with the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as their least one and the gaps between them, in as many bytes as the largest gap needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    wide = np.zeros((len(gaps), 8), np.uint8)
    wide[:, :raw[0]] = gaps
    return np.cumsum(wide.view(np.uint64).ravel()) + np.frombuffer(raw, np.uint64, 1, 1)


def shrunk(values: np.ndarray) -> bytes:
    """Numbers from 0 on: a byte each, those from 255 on in full behind, all compressed."""
    large = values >= 255
    raw = np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype(np.int64).tobytes()
    return len(values).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def small(raw: bytes) -> np.ndarray:
    """What ``shrunk`` was given."""
    if not len(raw):
        return np.zeros(0, np.int64)
    count, size = (int.from_bytes(raw[a:a + 8], "little") for a in (0, 8))
    data = pa.decompress(raw[16:], size, codec="zstd", asbytes=True)
    values = np.frombuffer(data, np.uint8, count).astype(np.int64)
    values[values == 255] = np.frombuffer(data, np.int64, -1, count) if size > count else 0
    return values


def doubles(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, float)


def _sent(batch: int, kind: int, keys: np.ndarray, values: list[np.ndarray], count: int) -> Iterator[tuple]:
    """The parts of ascending keys and their values, by key range."""
    part = ranges(keys, count)
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=False):
        yield batch, kind, int(part[a]), packed(keys[a:b]), [shrunk(v[a:b]) if v.dtype == np.int64 else v[a:b].tobytes() for v in values]


_SENT = "batch bigint, kind int, part int, keys binary, values array<binary>"
_ANSWER = "batch bigint, kind int, part int, answer binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(("batch", "kind", "part", "keys", "values"), r, strict=True)) for r in rows], _arrow(_SENT))


def _batches(documents: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(batch, doc, held, text) as a table bucketed by batch, and its number of key ranges."""
    session = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()

    def deal(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in found:
            for first, last, data, _ in arrays.chunks(batch.column("text")):
                if size and size + len(data) > BATCH_BYTES:
                    at, size = at + 1, 0
                size += len(data)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, place | at)), *part.columns], ["batch", *part.schema.names])

    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))
    dealt = documents.select(F.col(key).alias("doc"), held.alias("held"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        deal, f"batch bigint, doc {kind}, held boolean, text string")
    name = f"batches_{uuid.uuid4().hex}"
    buckets = int(session.conf.get("spark.sql.shuffle.partitions"))
    (dealt.write.format("parquet").bucketBy(buckets, "batch").sortBy("batch").option("compression", "zstd")
     .option("path", f"{checkpoint_dir(session)}/{name}").saveAsTable(name))
    table = session.table(name)
    session.sql(f"DROP TABLE {name}")  # from the catalog only: the files are read by what was looked up
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return table, max(1, -(-size // RANGE_BYTES))


def _summary(counts: np.ndarray) -> np.ndarray:
    """Tokens, types, types that occur 1, 2, ... LARGE and more times, tokens of the last, types that occur LARGE + 1 times."""
    seen = counts[counts > 0]
    return np.concatenate([[seen.sum(), len(seen)], np.bincount(np.minimum(seen, LARGE + 1), minlength=LARGE + 2)[1:],
                           [seen[seen > LARGE].sum()], [(seen == LARGE + 1).sum()]]).astype(np.int64)


def _asked(batch: int, k: int, level: Level, parts: int) -> Iterator[tuple]:
    """The count rows of one length, and a summary of the grams that no other batch can have."""
    yield from _sent(batch, k, level.types[level.away], [level.own[level.away]], parts)
    if not level.away.all():
        yield batch, k, batch % parts, b"", [b"", _summary(level.own[~level.away]).tobytes()]


def _weight(mass: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts from their grams' discounted counts, the same grams' probabilities one token
    shorter, and the context's count; below zero where nothing is left, so that one more count is needed."""
    short = (count > 0) & (count - mass <= 1e-9)
    whole = count + short
    weight = np.where(count > 0, (whole - mass) / np.maximum(whole, 1) / (1 - known), 1.0)
    return np.where(short, -weight, weight)


def _totals(frame: pd.DataFrame) -> pd.DataFrame:
    """One key range of one length: an answer to every batch, and the range's summary (batch -1)."""
    keys = [unpacked(k) for k in frame["keys"]]
    counts = np.concatenate([small(v[0]) for v in frame["values"]])
    types, place, at = distinct(np.concatenate(keys))
    total = np.bincount(at, counts, len(types)).astype(np.int64)
    answer = (total * 4 + (np.bincount(at, minlength=len(types)) == 1) * 2)[at]
    answer[place] += 1
    summary = _summary(total) + sum(np.frombuffer(v[1], np.int64) for v in frame["values"] if len(v) > 1)
    ends = np.cumsum([len(k) for k in keys])
    return pd.DataFrame({"batch": [*frame["batch"], -1], "kind": frame["kind"].iloc[0], "part": frame["part"].iloc[0],
                         "answer": [*(shrunk(x) for x in np.split(answer, ends[:-1])), summary.tobytes()]})


def _weights(frame: pd.DataFrame) -> pd.DataFrame:
    """One key range of contexts: their weights to every batch."""
    keys = [unpacked(k) for k in frame["keys"]]
    mass, known = (np.concatenate([doubles(v[k]) for v in frame["values"]]) for k in (0, 1))
    total = np.concatenate([small(v[2]) for v in frame["values"]])
    types, place, at = distinct(np.concatenate(keys))
    weight = _weight(np.bincount(at, mass, len(types)), np.bincount(at, known, len(types)), total[place])[at]
    ends = np.cumsum([len(k) for k in keys])
    return pd.DataFrame({"batch": frame["batch"], "kind": frame["kind"].iloc[0], "part": frame["part"].iloc[0],
                         "answer": [x.tobytes() for x in np.split(weight, ends[:-1])]})


def _in_ranges(sent: DataFrame) -> DataFrame:
    """The answers of all key ranges, stored."""
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return (_totals if frame["kind"].iloc[0] > 0 else _weights)(frame)

    return written(sent.groupBy("kind", "part").applyInPandas(one, _ANSWER))


def _summaries(answers: DataFrame) -> dict[int, list[int]]:
    """Summed summaries by length of gram; numpy sums over one short row per key range."""
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(kind, k, int(x)) for kind, raw in zip(frame["kind"], frame["answer"], strict=True)
                                for k, x in enumerate(np.frombuffer(raw, np.int64))], columns=["kind", "k", "x"])

    rows = answers.filter("batch = -1").mapInPandas(add, "kind int, k int, x bigint").groupBy("kind", "k").agg(F.sum("x").alias("x")).collect()
    sums = {(r["kind"], r["k"]): r["x"] for r in rows}
    return {kind: [sums.get((kind, k), 0) for k in range(LARGE + 5)] for kind, _ in sums}


def _discounts(sums: list[int]) -> Discounts:
    counts = sums[2:]
    return good_turing([*counts[:LARGE], counts[LARGE + 2]])


def _words(sums: list[int]) -> Words:
    total, types, *counts = sums
    found = _discounts(sums)
    return Words.of(total, types, found, sum(found.factors[r] * r * counts[r - 1] for r in range(1, LARGE + 1)) + counts[LARGE + 1])


def _answers(answers: pa.Table, kind: int, read) -> np.ndarray:
    """One kind's answers of a batch, in the order of its ascending keys."""
    rows = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("part")
    return np.concatenate([read(x.as_py()) for x in rows.column("answer")]) if rows.num_rows else read(b"")


class Backoff(NamedTuple):
    """One length of gram above 1 in a batch: contexts are the grams of one token less, and last the begins."""

    context: np.ndarray  #: of each gram
    counts: np.ndarray  #: of each context
    asked: np.ndarray  #: contexts of other batches too, in the order of their hashes
    keys: np.ndarray  #: their hashes
    mass: np.ndarray  #: this batch's share of each context's discounted counts
    known: np.ndarray  #: and of the probabilities that its grams have one token shorter
    weight: np.ndarray  #: of each context; nothing of use for the asked ones before they are answered
    direct: np.ndarray  #: probability of each gram that occurs


def backoff(t: Tokens, found: list[Level], k: int, cut: Discounts, lower_direct: np.ndarray, answers: pa.Table, answered: bool) -> Backoff:
    lower, level = found[k - 2], found[k - 1]
    context = np.where(t.starts[level.place], len(lower.types), lower.at[level.place - 1])
    n = len(lower.types) + 1
    ends = found[0].total[np.searchsorted(found[0].types, END)]  # a text has one end, and begins once
    counts = np.append(lower.total, ends)
    use = level.booked & (level.total > 0)
    mass = np.bincount(context[use], cut.of(level.total[use]), n).astype(float)  # of nothing it would be whole numbers
    known = np.bincount(context[use], lower_direct[lower.at[level.place[use]]], n).astype(float)
    present = np.bincount(context, minlength=n) > 0
    asked = np.flatnonzero(present & ~np.append(lower.alone, False) & (counts > 0))
    keys = np.append(lower.types, begins(k - 1))[asked]
    order = np.argsort(keys)
    asked, keys = asked[order], keys[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = _weight(mass, known, counts)
    if answered:
        weight[asked] = _answers(answers, -k, doubles)
    whole = np.maximum(counts + (weight < 0), 1)[context]
    return Backoff(context, counts, asked, keys, mass, known, weight, cut.of(level.total) / whole)


def _backoffs(t: Tokens, found: list[Level], words: Words, cuts: dict[int, Discounts], answers: pa.Table, last: int, answered: int) -> list[Backoff]:
    """Lengths 2 to ``last``; weights of lengths up to ``answered`` are known."""
    out: list[Backoff] = []
    direct = words.probability(found[0].total)
    for k in range(2, last + 1):
        out.append(backoff(t, found, k, cuts[k], direct, answers, k <= answered))
        direct = out[-1].direct
    return out


def probabilities(found: list[Level], backs: list[Backoff], words: Words, k: int) -> np.ndarray:
    """Each token's probability after the ``k`` - 1 tokens before it: that of the whole gram where it occurs, else the
    context's weight times the probability after one token less."""
    level = found[k - 1]
    if k == 1:
        return words.probability(level.total)[level.at]
    back = backs[k - 2]
    backed = np.abs(back.weight[back.context])[level.at] * probabilities(found, backs, words, k - 1)
    return np.where((level.total > 0)[level.at], back.direct[level.at], backed)


def score(documents: DataFrame, key: str = "doc_id", order: int = 3) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every document row.

    A token is scored after the ``order`` - 1 tokens before it, begins where the text has fewer. Words are split
    at ASCII white space and lower-cased (A to Z); each text has one more token, its end.
    Rows whose crc32(key as text) mod 7 is 2 are held out: nothing is learned from them. A null
    key is learned from. A null text is empty: its end alone is scored. Repeated rows count each. Unknown
    words share one probability; without training rows all of it is theirs. Scores are sums of log10.
    """
    if order < 1:
        raise ValueError("order is at least 1")
    table, parts = _batches(documents, key)
    kind = documents.schema[key].dataType.simpleString()

    def read(found: pa.Table) -> tuple[int, Tokens, np.ndarray]:
        t = tokens(found.column("text"), order)
        return found.column("batch")[0].as_py(), t, ~found.column("held").to_numpy(zero_copy_only=False)[t.rows]

    def first(found: pa.Table) -> pa.Table:
        batch, t, train = read(found)
        return _rows([r for k, level in enumerate(levels(t, train, None, 0, min(order, 2)), 1) for r in _asked(batch, k, level, parts)])

    answers = _in_ranges(table.groupBy("batch").applyInArrow(first, _SENT))
    sums = _summaries(answers)
    empty = [0] * (LARGE + 5)
    words, cuts = _words(sums.get(1, empty)), {k: _discounts(sums.get(k, empty)) for k in range(2, min(order, 2) + 1)}
    cogroup = lambda work, schema: table.groupBy("batch").cogroup(answers.filter("batch >= 0").groupBy("batch")).applyInArrow(work, schema)

    def step(k: int, cuts: dict[int, Discounts]):
        """Ask for the weights of length k, and for the counts of length k + 1."""
        def work(found: pa.Table, told: pa.Table) -> pa.Table:
            batch, t, train = read(found)
            known = levels(t, train, told, k, min(order, k + 1))
            back = _backoffs(t, known, words, cuts, told, k, k - 1)[-1]
            at = back.asked
            rows = list(_sent(batch, -k, back.keys, [back.mass[at], back.known[at], back.counts[at]], parts))
            if k < order:
                rows += _asked(batch, k + 1, known[k], parts)
            return _rows(rows)
        return work

    for k in range(2, order + 1):
        more = _in_ranges(cogroup(step(k, dict(cuts)), _SENT))
        if k < order:
            cuts[k + 1] = _discounts(_summaries(more).get(k + 1, empty))
        answers = answers.unionByName(more)

    def evaluate(found: pa.Table, told: pa.Table) -> pa.Table:
        _, t, train = read(found)
        known = levels(t, train, told, order, order)
        logs = np.log10(probabilities(known, _backoffs(t, known, words, cuts, told, order, order), words, order))
        counts, n = known[0].total[known[0].at], found.num_rows
        return pa.table({
            key: found.column("doc"), "held_out": found.column("held"),
            "n_tokens": pa.array(np.bincount(t.rows, minlength=n).astype(np.int64)),
            "n_known": pa.array(np.bincount(t.rows, counts > 0, n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, words.total, np.int64)),
            "base_score": pa.array(np.bincount(t.rows, words.base(counts), n)),
            "score": pa.array(np.bincount(t.rows, logs, n)),
        })

    return cogroup(evaluate, f"{key} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
