"""Stored sketches: distinct counts and quantiles of any period without reading the rows again.

One sketch per group and finest period is kept in a table. Sketches merge, so coarser periods, unions of
groups and shared members come from that table alone, whose size depends on groups and periods only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the values a theta sketch keeps; up to that many distinct values it is exact.
LG_ENTRIES = 12
#: Size parameter of a KLL sketch.
KLL_SIZE = 800


# -------------------------------------------------------------- distinct values
def distinct_error(lg_entries: int = LG_ENTRIES, deviations: float = 3.0) -> float:
    """Relative error of a union's estimate at so many standard deviations."""
    return deviations / math.sqrt((1 << lg_entries) - 1)


def distinct_sketches(df: DataFrame, keys: Sequence[str], value: str, lg_entries: int = LG_ENTRIES, alias: str = "members") -> DataFrame:
    """(keys..., ``alias``): a theta sketch of the non-null values per group; partial sketches are merged, no rows are."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, F.lit(lg_entries)).alias(alias))


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def distinct_rollup(sketches: DataFrame, keys: Sequence[str], lg_entries: int = LG_ENTRIES, sketch: str = "members",
                    alias: str = "n") -> DataFrame:
    """(keys..., ``alias``): estimated distinct values per coarser group, from stored sketches."""
    merged = sketches.groupBy(*keys).agg(F.theta_union_agg(sketch, F.lit(lg_entries)).alias("_merged"))
    return merged.select(*keys, _estimate(F.col("_merged")).alias(alias))


def distinct_shared(sketches: DataFrame, group: str, lg_entries: int = LG_ENTRIES, sketch: str = "members") -> DataFrame:
    """(a, b, shared, joint): estimated shared and united members of every two groups, a before b.

    Sketches are first united per group, so pairs are formed of groups, one sketch each.
    """
    whole = sketches.groupBy(group).agg(F.theta_union_agg(sketch, F.lit(lg_entries)).alias("_s"))
    a, b = whole.select(F.col(group).alias("a"), F.col("_s").alias("_a")), whole.select(F.col(group).alias("b"), F.col("_s").alias("_b"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select(
        "a", "b", _estimate(F.theta_intersection("_a", "_b")).alias("shared"),
        _estimate(F.theta_union("_a", "_b", F.lit(lg_entries))).alias("joint"))


# -------------------------------------------------------------------- quantiles
def rank_error(size: int = KLL_SIZE) -> float:
    """Normalised rank error of one quantile that a KLL sketch keeps in 99 of 100 cases (the published fit)."""
    return 2.296 / size ** 0.9021


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, size: int = KLL_SIZE, alias: str = "values") -> DataFrame:
    """(keys..., ``alias``): a KLL sketch of the non-null values per group."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias(alias))


def quantile_rollup(sketches: DataFrame, keys: Sequence[str], share: float, size: int = KLL_SIZE, sketch: str = "values",
                    alias: str = "value") -> DataFrame:
    """(keys..., n, ``alias``): rows and the ``share`` quantile per coarser group, from stored sketches."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double(sketch, F.lit(size)).alias("_merged"))
    return merged.select(
        *keys, F.kll_sketch_get_n_double("_merged").alias("n"),
        F.kll_sketch_get_quantile_double("_merged", F.lit(float(share))).alias(alias))
