"""Word counts, leading terms and term weights from token arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens.operators.ranking import top_k_per_group


def _laid_out(df: DataFrame, keys: Sequence[str], words: Column) -> DataFrame:
    """One row per word.

    ``explode_outer`` with a filter behind it: for a plain ``explode`` Spark adds a test
    for empty arrays below it, which makes the whole cleaning of each text run twice.
    """
    return df.select(*keys, F.explode_outer(words).alias("term")).where(F.col("term").isNotNull())


def word_count(df: DataFrame, words: str, keys: Sequence[str] = (), lemmas: DataFrame | None = None) -> DataFrame:
    """(keys..., term, count) over token arrays.

    Tokens are counted inside each task before the exchange. A ``(term, lemma)``
    table is applied to the counted terms, not to the tokens.
    """
    counted = (
        _laid_out(df, keys, F.col(words))
        .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("count"))
    )
    if lemmas is None:
        return counted
    return (
        with_lemma(counted, lemmas)
        .groupBy(*keys, F.col("lemma").alias("term")).agg(F.sum("count").alias("count"))
    )


def with_lemma(df: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Adds ``lemma``: the term's entry in a ``(term, lemma)`` table, else the term."""
    known = lemmas.select("term", F.col("lemma").alias("_lemma")).dropDuplicates(["term"])
    return df.join(known, "term", "left").withColumn("lemma", F.coalesce("_lemma", "term")).drop("_lemma")


def leading_terms(df: DataFrame, words: str, group: str, k: int, lemmas: DataFrame | None = None) -> DataFrame:
    """The k most frequent terms of each group: (group, rank, term, count)."""
    counts = word_count(df, words, [group], lemmas)
    best = top_k_per_group(counts, group, k, [F.desc("count"), F.asc("term")])
    return best.select(group, "rank", "term", "count")


def vocabulary(df: DataFrame, words: str, min_df: int = 1, size: int | None = None) -> DataFrame:
    """(term, count, documents) of terms in at least ``min_df`` documents (rows), the ``size`` most frequent.

    Sorting each row's words puts equal ones side by side, so a word's first
    occurrence is marked without an exchange; only (term, count, documents)
    partial sums are shuffled, never (document, term) pairs.
    """
    pairs = F.arrays_zip(F.col("_words").alias("term"), F.concat(F.array(F.lit("")), F.col("_words")).alias("left"))
    ordered = (
        df.select(F.sort_array(words).alias("_words"))
        .select(F.posexplode_outer(pairs).alias("_at", "_w"))
        .where(F.col("_w.term").isNotNull())
    )
    first = (F.col("_at") == 0) | (F.col("_w.term") != F.col("_w.left"))
    terms = (
        ordered.groupBy(F.col("_w.term").alias("term"))
        .agg(F.count(F.lit(1)).alias("count"), F.count(F.when(first, 1)).alias("documents"))
        .where(F.col("documents") >= min_df)
    )
    return terms if size is None else terms.orderBy(F.desc("count"), "term").limit(size)


def inverse_document_frequency(df: DataFrame, words: str, total: int | None = None) -> DataFrame:
    """(term, documents, idf) with idf = ln((N + 1) / (documents + 1)), N = all documents (rows)."""
    n = df.count() if total is None else total
    return (
        _laid_out(df, [], F.array_distinct(words))
        .groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
        .withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("documents") + 1.0)))
    )

