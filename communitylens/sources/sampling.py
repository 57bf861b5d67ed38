"""Samples that do not depend on file layout or partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K

_HASH_BINS = 1 << 16


def hash_fraction(key: Column | str, salt: str = "") -> Column:
    """A number in [0, 1) fixed by the key: the first 32 bits of its MD5."""
    key = F.col(key) if isinstance(key, str) else key
    text = key.cast("string")
    digest = F.md5(F.concat(F.lit(salt), text) if salt else text)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    return df.where(hash_fraction(key) < fraction)


def sample_fraction(df: DataFrame, fraction: float, seed: int = K.SEED) -> DataFrame:
    """Spark's Bernoulli sample; repeatable only over the same files and partitions."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_adaptive(df: DataFrame, key: str | None = None, fraction: float | None = None) -> DataFrame:
    """The share that the caller asks for, by hash of ``key`` or else by Spark's sample; None keeps every row.

    The caller adapts the fraction to the table (1 % and 5 % are common); no row count changes it here.
    """
    if fraction is None:
        return df
    return hash_sample(df, key, fraction) if key else sample_fraction(df, fraction)


def sample_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly ``n`` rows chosen by the hash of a unique key; all rows if n is 0 or too large.

    A first pass counts rows per hash bin (65,536 counts at most). Bins below the
    cut are kept by a plain filter; only the bin the cut falls into is sorted.
    """
    if not n:
        return df
    place = hash_fraction(key)
    bin_of = F.floor(place * _HASH_BINS)
    counts = df.groupBy(bin_of.alias("bin")).count().orderBy("bin").collect()
    if n >= sum(row["count"] for row in counts):
        return df
    kept, cut = 0, 0
    for row in counts:
        if kept + row["count"] > n:
            cut = row["bin"]
            break
        kept += row["count"]
    whole = df.where(bin_of < cut)
    rest = df.where(bin_of == cut).orderBy(place, key).limit(n - kept)
    return whole.unionByName(rest)


def split_by_hash(df: DataFrame, key: str, weights: tuple[float, ...] = (0.6, 0.2, 0.2),
                  salt: str = "split") -> tuple[DataFrame, ...]:
    """Disjoint parts covering ``df``, by hash of the key."""
    part = part_by_hash(key, weights, salt)
    return tuple(df.where(part == i) for i in range(len(weights)))


def part_by_hash(key: Column | str, weights: tuple[float, ...] = (0.6, 0.2, 0.2), salt: str = "split") -> Column:
    """The number of the part a row belongs to: one pass tags a table that is then filtered."""
    place, low, part = hash_fraction(key, salt), 0.0, None
    for i, weight in enumerate(weights[:-1]):
        low += weight / sum(weights)
        part = F.when(place < low, i) if part is None else part.when(place < low, i)
    return F.lit(0) if part is None else part.otherwise(len(weights) - 1)


def split_random(df: DataFrame, seed: int = K.SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """60/20/20 by two random splits; repeatable only over the same partitions."""
    rest, test = df.randomSplit([0.8, 0.2], seed=seed)
    train, validation = rest.randomSplit([0.75, 0.25], seed=seed)
    return train, validation, test
