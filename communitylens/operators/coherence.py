"""Topic coherence: do a topic's leading words occur in the same documents?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(docs: DataFrame, key: str, words: str, listed: DataFrame) -> DataFrame:
    """(topic, a, b, n_a, n_b, n_both) of every two words of a topic, a before b.

    ``listed`` has topic and term. A document keeps only listed words, once each, before it leaves its
    task; pairs are formed inside a topic, so a document gives rows by the topics' lists, not by its length. ``key`` is
    unique.
    """
    listed = listed.select("topic", "term").distinct()
    held = (
        docs.select(F.col(key).alias("_key"), F.explode(F.array_distinct(words)).alias("term"))
        .join(listed, "term").select("_key", "topic", "term")
    )
    grouped = held.groupBy("_key", "topic").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    pair = F.posexplode("_terms").alias("_at", "a")
    seen = grouped.select("topic", "_terms", pair).select(
        "topic", "a", F.explode(F.slice("_terms", F.col("_at") + 1, F.size("_terms"))).alias("b"))
    counts = seen.groupBy("topic", "a", "b").agg(F.count("*").alias("n"))  # b = a counts the word itself
    own = counts.where("a = b").select("topic", F.col("a").alias("term"), "n")
    sizes = listed.join(own, ["topic", "term"], "left").select("topic", "term", F.coalesce("n", F.lit(0)).alias("n"))
    left = sizes.select("topic", F.col("term").alias("a"), F.col("n").alias("n_a"))
    right = sizes.select("topic", F.col("term").alias("b"), F.col("n").alias("n_b"))
    both = counts.where("a < b").withColumnRenamed("n", "n_both")
    return (
        left.join(right, "topic").where("a < b").join(both, ["topic", "a", "b"], "left")
        .select("topic", "a", "b", "n_a", "n_b", F.coalesce("n_both", F.lit(0)).alias("n_both"))
    )


def coherence(docs: DataFrame, key: str, words: str, listed: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """(topic, pairs, npmi): the mean normalised pointwise mutual information of a topic's word pairs.

    A pair that never meets counts -1; one that is in every document counts 1.
    """
    total = docs.agg(F.count("*").cast("double").alias("_n"))
    pairs = pair_counts(docs, key, words, listed)
    n = total.scalar()
    together = F.col("n_both") / n
    value = F.when(F.col("n_both") == 0, -1.0).when(F.col("n_both") == n, 1.0).otherwise(
        F.log(together / ((F.col("n_a") / n) * (F.col("n_b") / n))) / -F.log(together))
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(value).alias("npmi"))


def document_counts(docs: DataFrame, words: str, listed: Sequence[str]) -> tuple[np.ndarray, int]:
    """Documents that hold both of every two listed words (on the diagonal: that hold the word), and all documents.

    One scan. A document leaves its row as the listed words it holds; every task adds up its own square of counts
    and sends what is filled, so what is sent depends on the list, never on the number of documents. ``listed`` has no
    word twice.
    """
    known, size = pa.array(listed, pa.string()), len(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((size, size)), 0
        for batch in batches:
            column = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            held = np.zeros((len(column), size))
            held[np.repeat(np.arange(len(column)), lengths), pc.index_in(column.flatten(), known).to_numpy()] = 1
            total += held.T @ held
            rows += len(column)
        a, b = np.nonzero(total)
        places = [pa.array(np.append(x, size), pa.int64()) for x in (a, b)]  # the last one: all documents
        yield pa.RecordBatch.from_arrays([*places, pa.array(np.append(total[a, b], rows).astype(np.int64))], ["a", "b", "n"])

    held = docs.select(F.array_intersect(words, F.lit(list(listed)).cast("array<string>")).alias("held"))
    table = held.mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size + 1, size + 1), np.int64)
    out[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("n").to_numpy()
    return out[:size, :size], int(out[size, size])
