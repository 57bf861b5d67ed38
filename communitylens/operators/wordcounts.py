"""Every text's distinct words with their counts, and vectors of them: whole columns at a time, one pass over the texts."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: What Java's ``\\s`` matches besides the blank.
BLANKS = "\t\n\x0b\f\r"


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def _split(texts: pa.Array) -> pa.ListArray:
    """Words as ``pyspark.ml.feature.Tokenizer`` splits them: leading and repeated blanks leave empty words, trailing ones none."""
    for blank in BLANKS:
        texts = pc.replace_substring(texts, blank, " ")
    trimmed = pc.ascii_rtrim(texts, " ")
    only_blanks = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.equal(trimmed, ""))
    return _without(pc.split_pattern(trimmed, " "), pc.fill_null(only_blanks, True))


def _without(lists: pa.ListArray, rows: pa.Array) -> pa.ListArray:
    """The lists, empty in the given rows."""
    return pc.if_else(rows, pa.scalar([], lists.type), lists)


def counted(df: DataFrame, text: str, keep: Sequence[str], unwanted: Iterable[str] = ()) -> DataFrame:
    """(keep..., words, counts): a text's distinct words in lower case, without unwanted ones (in either case), and how often each occurs.

    The words are one text, joined by blanks, which is moved and stored many times faster than a list of words.
    """
    stop = sorted({w.lower() for w in unwanted})

    @F.arrow_udf("words string, counts array<int>")
    def count(texts: pa.Array) -> pa.Array:
        lists = _split(texts)
        coded = lists.flatten().dictionary_encode()
        known, codes = coded.dictionary, coded.indices.to_numpy()
        rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        wanted = ~pc.is_in(known, pa.array(stop, known.type)).to_numpy(zero_copy_only=False)[codes]
        pairs, n = np.unique(rows[wanted] * max(len(known), 1) + codes[wanted], return_counts=True)
        rows, codes = np.divmod(pairs, max(len(known), 1))
        offsets = _offsets(np.bincount(rows, minlength=len(lists)))
        words = pc.binary_join(pa.ListArray.from_arrays(offsets, known.take(pa.array(codes))), " ")
        return pa.StructArray.from_arrays([words, pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], ["words", "counts"])

    return df.select(*keep, count(F.lower(text)).alias("_c")).select(*keep, "_c.words", "_c.counts")


def _entries(words: pa.Array, counts: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, word and count of everything in a batch of counted texts."""
    lengths = pc.list_value_length(counts)
    lists = _without(pc.split_pattern(words, " "), pc.equal(lengths, 0))
    return np.repeat(np.arange(len(words)), lengths.to_numpy()), lists.flatten(), counts.flatten().to_numpy()


def leading(texts: DataFrame, min_df: int = 1, size: int | None = None) -> DataFrame:
    """(term, count, documents) of words in at least ``min_df`` counted texts, the ``size`` most frequent: ``terms.vocabulary``
    for counted texts. Every batch is summed before the exchange."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, words, n = _entries(*batch.columns)
            coded = words.dictionary_encode()
            at, known = coded.indices.to_numpy(), len(coded.dictionary)
            total = np.bincount(at, n, known).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(total), pa.array(np.bincount(at, minlength=known))], ["term", "n", "d"])

    parts = texts.select("words", "counts").mapInArrow(add_up, "term string, n bigint, d bigint")
    found = parts.groupBy("term").agg(F.sum("n").alias("count"), F.sum("d").alias("documents")).where(F.col("documents") >= min_df)
    return found if size is None else found.orderBy(F.desc("count"), "term").limit(size)


def with_vectors(texts: DataFrame, vocabulary: Sequence[str], target: str) -> DataFrame:
    """Adds the counts of the vocabulary's words as a sparse vector, as ``CountVectorizerModel`` makes it from the words."""
    size = len(vocabulary)

    @F.arrow_udf(VectorUDT())
    def place(words: pa.Array, counts: pa.Array) -> pa.Array:
        rows, found, n = _entries(words, counts)
        coded = found.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, pa.array(vocabulary, pa.string())), -1).to_numpy()[coded.indices.to_numpy()]
        held = np.flatnonzero(at >= 0)
        held = held[np.argsort(rows[held] * max(size, 1) + at[held])]
        offsets = _offsets(np.bincount(rows[held], minlength=len(words)))
        return pa.StructArray.from_arrays([
            pa.array(np.zeros(len(words), np.int8)), pa.array(np.full(len(words), size, np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(at[held].astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(n[held].astype(np.float64))),
        ], ["type", "size", "indices", "values"])

    return texts.withColumn(target, place("words", "counts"))
