"""Benchmark decontamination by winnowing.

Every window of consecutive words is stood for by the least hash of its k-grams, its
fingerprint. Two equal windows have equal fingerprints, so each shared span of a window's
length or more is found. Documents keep only windows whose fingerprint may be a benchmark
fingerprint; these are joined with the benchmark's windows by fingerprint and extended to
the whole window by comparing its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm import arrays
from communitylens.llm.bitmaps import bitmap
from communitylens.session import cut_lineage

WINDOW = 10
#: Bits of the fingerprint filter (one megabyte, whatever the benchmark's size).
FILTER_LOG2 = 23
#: Parts that a window's occurrences are dealt to, so that a common passage is no single task's work.
SALTS = 16


def fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """The winnowed fingerprint of every window of ``length`` words, by its first word."""
    k = (length + 1) // 2
    return arrays.sliding_min(arrays.gram_hashes(hashes, k), length - k + 1) ^ np.uint64(length)


def _window_rows(column: pa.Array, lengths: Sequence[int], whole_short: bool, bits: np.ndarray | None):
    """Per chunk: first row, words per row, and (row, length, start in row, fingerprint, words) of the windows."""
    for first, last, data, offsets in arrays.chunks(column):
        low = arrays.LOWER[data]
        starts, ends, bounds = arrays.words(low, offsets, arrays.ALNUM)
        hashes = arrays.span_hashes(low, starts, ends)
        counts = np.diff(bounds)
        found = []
        for length in lengths:
            rows, at = arrays.starts_within(bounds, length)
            if whole_short and length < max(lengths):  # only texts of just that many words
                same = counts[rows] == length
                rows, at = rows[same], at[same]
            prints = fingerprints(hashes, length)[at] if len(at) else np.zeros(0, np.uint64)
            if bits is not None and len(at):
                keep = arrays.set_bits(bits, prints)
                rows, at, prints = rows[keep], at[keep], prints[keep]
            raw = low.tobytes() if len(at) else b""
            for row, word, mark in zip(rows.tolist(), at.tolist(), prints.view(np.int64).tolist(), strict=True):
                text = b" ".join([raw[starts[i]:ends[i]] for i in range(word, word + length)])
                found.append((row, length, word - int(bounds[row]), mark, text.decode()))
        yield first, counts, found


def _windows(df: DataFrame, key: str, lengths: Sequence[int], whole_short: bool, bits: np.ndarray | None) -> DataFrame:
    """(row, key, n_words) for each text and (row, key, length, start, mark, words) for each of its windows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, found in _window_rows(batch.column("text"), lengths, whole_short, bits):
                part = batch.slice(first, len(counts))
                places = pa.array([x[0] for x in found], pa.int64())
                none = len(counts)
                both = pa.concat_arrays([pa.array(np.arange(none)), places])
                columns = [
                    part.column("row").take(both), part.column(key).take(both),
                    pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(len(found), pa.int64())]),
                ]
                for k, type_ in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.string())):
                    columns.append(pa.concat_arrays([pa.nulls(none, type_), pa.array([x[k] for x in found], type_)]))
                yield pa.RecordBatch.from_arrays(columns, ["row", key, "n_words", "length", "start", "mark", "words"])

    return df.select(F.monotonically_increasing_id().alias("row"), key, F.col("text").cast("string")).mapInArrow(
        run, f"row bigint, {key} {kind}, n_words bigint, length int, start bigint, mark bigint, words string"
    )


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: row, doc_id, n_words, n_hit, items (ids as sorted strings).

    documents need doc_id and text, benchmark item_id and text; other columns are not used.
    A null or wordless text has no words, hits or items; null or wordless items match nothing;
    repeated document rows each get a row, repeated items count once per item_id. A null item_id is
    left out. Items of fewer words than ``window`` match as a whole. An empty benchmark marks nothing.
    """
    items = _windows(benchmark.filter(F.col("item_id").isNotNull()), "item_id", range(1, window + 1), True, None)
    items = cut_lineage(items.filter("words is not null").select("item_id", "length", "mark", "words"))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``window`` values
    bits = bitmap(items, "mark", FILTER_LOG2)
    found = cut_lineage(_windows(documents, "doc_id", lengths, False, bits))
    salted = items.select("mark", "words", F.col("item_id").cast("string").alias("item")).distinct().withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    hits = (
        found.filter("words is not null").withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
        .join(salted, ["mark", "words", "salt"])
        .groupBy("row").agg(
            F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
            F.array_sort(F.collect_set("item")).alias("items"),
        )
    )
    covered = F.expr("""aggregate(spans, struct(0L AS upto, 0L AS n),
        (a, x) -> struct(greatest(a.upto, x.start + x.length) AS upto,
                         a.n + greatest(0L, x.start + x.length - greatest(a.upto, x.start)) AS n), a -> a.n)""")
    texts = found.filter("words is null").select("row", "doc_id", "n_words")
    return texts.join(hits, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document row."""
    return matches(documents, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a benchmark window; a null doc_id is kept."""
    bad = matches(documents, benchmark, window).filter("n_hit > 0").select(F.col("doc_id").alias("bad_id")).distinct()
    return documents.join(bad, documents["doc_id"] == bad["bad_id"], "left_anti")
