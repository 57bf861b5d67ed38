"""Largest, smallest and first-k selections with fixed order on ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def bottom_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.asc(by), F.asc(tie)).limit(k)


def extremes(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k largest and k smallest rows, each once, in ascending order."""
    return top_k(df, k, by, tie).unionByName(bottom_k(df, k, by, tie)).distinct().orderBy(by, tie)


def top_k_per_group(df: DataFrame, group: Sequence[str] | str, k: int, order: Sequence[Column],
                    rank_alias: str = "rank") -> DataFrame:
    """First k rows of each group.

    Spark applies the limit inside every task before the exchange, so at most k
    rows per group and task are shuffled however large the group is.
    """
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_alias, F.row_number().over(w)).where(F.col(rank_alias) <= k)


def most_frequent(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys with their ``count``."""
    return top_k(df.where(F.col(key).isNotNull()).groupBy(key).count(), k, "count", key)


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a (short) table of keys."""
    return df.join(keys.select(key), key, "left_semi")
