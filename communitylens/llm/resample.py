"""Importance resampling towards a target distribution, over hashed word n-grams.

A batch's texts are joined with a sentinel byte that no UTF-8 text holds. One regular expression
pass over the joined bytes finds the words of all texts and the sentinels between them; sorted
document offsets tell each word's text, so n-grams that cross two texts are masked before the
buckets are counted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens.llm.store import written
from communitylens.session import literal_table

BUCKETS = 10_000
#: Text bytes that are joined at once (a longer text is worked on alone).
CHUNK_BYTES = 2 << 20
#: Words whose hashes a task remembers at most; it starts anew beyond them.
MEMORY = 500_000
#: Never part of UTF-8.
SENTINEL = b"\xff"
#: The class [^\x00-\x2F\x3A-\x60\x7B-\x7F] on lower-cased UTF-8 bytes, or a sentinel.
TOKENS = re.compile(rb"[0-9a-z\x80-\xf7]+|\xff")
#: CRC-32, reflected.
POLYNOMIAL = 0xEDB88320


class _Hashes(dict):
    """The CRC-32 of each word seen; -1 for the sentinel."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = -1 if word == SENTINEL else zlib.crc32(word)
        return code


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit numbers, given for each value of each of their four bytes."""
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24 & 255]


def _zero_bytes(count: int) -> list[np.ndarray]:
    """Maps of a CRC-32 to that of the same bytes and 1, 2, 4 ... zero bytes more, up to ``count``."""
    one = np.arange(256, dtype=np.int64)
    for _ in range(8):
        one = one >> 1 ^ POLYNOMIAL * (one & 1)
    value = np.arange(256, dtype=np.int64) << 8 * np.arange(4)[:, None]
    tables = [value >> 8 ^ one[value & 255]]
    while 1 << len(tables) <= count:
        tables.append(_applied(tables[-1], tables[-1]))
    return tables


def joined_hashes(crc: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from those of a and b and the byte lengths of b."""
    out = crc.copy()
    for k, table in enumerate(_zero_bytes(int(lengths.max()) if len(lengths) else 0)):
        bit = (lengths >> k & 1).astype(bool)
        out[bit] = _applied(table, out[bit])
    return out ^ more


class Grams:
    """Hashes of the n-grams of joined texts."""

    def __init__(self, grams: int):
        self.grams, self.known = grams, _Hashes()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words per text, and for each n-gram size the (text, CRC-32) of every n-gram within one text."""
        if len(self.known) > MEMORY:
            self.known.clear()
        tokens = TOKENS.findall(SENTINEL.join(texts).lower())
        codes = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        ends = np.flatnonzero(codes < 0)
        first = np.concatenate([[0], ends - np.arange(len(ends))])  # each text's first word
        words = codes[codes >= 0]
        owners = np.searchsorted(first, np.arange(len(words)), side="right") - 1
        found = [(owners, words)]
        if self.grams > 1 and len(words):
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))[codes >= 0]
            blank = np.full(len(words), zlib.crc32(b" "), np.int64)
            spaced = joined_hashes(blank, words, lengths)
            crc = words
            for size in range(2, min(self.grams, len(words)) + 1):
                crc = joined_hashes(crc[:-1], spaced[size - 1:], lengths[size - 1:] + 1)
                inside = owners[:len(crc)] == owners[size - 1:]
                found.append((owners[:len(crc)][inside], crc[inside]))
        return np.diff(np.append(first, len(words))), found


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of about CHUNK_BYTES; null counts as empty."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def bucket_counts(df: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts of ``df``; a task sends at most one row a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, totals = Grams(grams), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch):
                for _, crc in find(texts)[1]:
                    totals += np.bincount(crc % buckets, minlength=buckets)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], ["bucket", "n"])

    counted = df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    table = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share in the target over its share in the source, one added to each count."""
    every_s, every_t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (every_s + n) / ((s + 1.0) * (every_t + n))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weights(df: DataFrame, gain: np.ndarray, key: str = "doc_id", grams: int = 1) -> DataFrame:
    """key, n_words, n_features and weight (the sum of its features' gains) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, gain = Grams(grams), shared.value
        for batch in batches:
            for first, texts in _chunks(batch):
                words, found = find(texts)
                features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for owners, crc in found:
                    features += np.bincount(owners, minlength=len(texts))
                    weight += np.bincount(owners, gain[crc % len(gain)], len(texts)).astype(np.int64)  # exact below 2**53
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(first, len(texts)), pa.array(words), pa.array(features), pa.array(weight)],
                    [key, "n_words", "n_features", "weight"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, df["text"].cast("string").alias("text")).mapInArrow(
        run, f"{key} {kind}, n_words bigint, n_features bigint, weight bigint")


def _noise(key: str, seed: int) -> Column:
    """1000 times a Gumbel number that follows from the key alone, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    high = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((high + 0.5) / F.lit(4294967296.0))))


def ranks(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` (1, 2, 3 ...) in a total order, without a task that sees all rows.

    Rows are dealt to ranges by sampled bounds and numbered inside each; the ranges' sizes, one number
    a partition, shift the numbers.
    """
    placed = written(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = literal_table(df.sparkSession, rows, "part bigint, before bigint")
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    return (
        placed.join(offsets, F.shiftright("place", 33) == F.col("part"))
        .withColumn("rank", inside + F.col("before") + 1).drop("place", "part", "before")
    )


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, grams: int = 1,
             buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``documents`` (doc_id, text).

    ``target`` needs text only; further columns are not used. Of the N documents with ``min_words`` words
    or more, floor(percent * N / 100) are drawn: those with the highest scores, weight plus Gumbel noise, which
    draws without replacement in proportion to the weights; rank is null for the rest. Ties go to smaller ids,
    then to more features; a null id has noise of its own and comes last in a tie. Null and wordless texts have
    no features and weight 0. Rows that repeat are drawn each for itself. An empty target counts nothing and an
    empty table gives no rows.
    """
    gain = gains(bucket_counts(documents, grams, buckets), bucket_counts(target, grams, buckets))
    scored = weights(documents, gain, "doc_id", grams).withColumn("score", F.col("weight") + _noise("doc_id", seed))
    scored = written(scored)
    long_enough = F.col("n_words") >= min_words
    drawn = scored.filter(long_enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("n_words")]
    ranked = ranks(scored.filter(long_enough), order)
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("bigint")))
