"""Sorted positions and the Gini coefficient per group, without collecting groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communitylens.operators.ordered import with_group_part
from communitylens.session import cut_lineage


def _histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., _x, _k, _range): how often each non-negative value occurs, and its value range.

    A group without such values keeps one row with _x null and _k 0.
    """
    number = F.col(value).cast("double")
    counted = (
        df.select(*keys, F.when((number >= 0) & ~F.isnan(number), number).alias("_x"))
        .groupBy(*keys, "_x").agg(F.count("_x").alias("_k"))
    )
    return with_group_part(counted, keys, "_x", "_range")


def _before(keys: list[str], column: str, order: str) -> Column:
    """Running total of ``column`` over the rows ordered before, within the keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value, count, first_position, last_position): 1-based places in the group's ascending order.

    One row per distinct non-negative value; its equals share the places between first
    and last. Same division into value ranges as in ``gini``.
    """
    keys = list(keys)
    histogram = cut_lineage(_histogram(df, keys, value).where(F.col("_x").isNotNull()))  # one division for both uses
    shifts = (
        histogram.groupBy(*keys, "_range").agg(F.sum("_k").alias("_n"))
        .select(
            F.struct(*keys).alias("_group"), F.col("_range").alias("_same_range"),
            _before(keys, "_n", "_range").alias("_shift"),
        )
    )
    placed = histogram.withColumn("_start", _before([*keys, "_range"], "_k", "_x")).join(
        shifts, F.struct(*keys).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_same_range"))
    )
    start = F.col("_start") + F.col("_shift")
    return placed.select(
        *keys, F.col("_x").alias(value), F.col("_k").alias("count"),
        (start + 1).alias("first_position"), (start + F.col("_k")).alias("last_position"),
    )


def gini(df: DataFrame, keys: Sequence[str], value: str, alias: str = "gini") -> DataFrame:
    """Gini coefficient of the non-negative values in each group, 0.0 if they sum to nothing.

    Equal values are first counted together. Ranks then come from running counts
    within 64 value ranges per group, between the group's own quantiles, shifted by the number of
    values in lower ranges. Each range is its own window partition: a group with most of the rows is
    spread over many tasks, whatever its values' scale, and no group is ever held as a list.
    """
    keys = list(keys)
    k, x = F.col("_k").cast("double"), F.col("_x")
    ranges = (
        _histogram(df, keys, value)
        .withColumn("_start", _before([*keys, "_range"], "_k", "_x"))
        .groupBy(*keys, "_range")
        .agg(
            F.sum(k).alias("_n"),
            F.sum(k * x).alias("_s"),
            F.sum(x * (k * F.col("_start") + k * (k + 1) / 2)).alias("_w"),
        )
    )
    n, s, w = F.col("_n"), F.col("_s"), F.col("_w")
    totals = (
        ranges.withColumn("_shift", _before(keys, "_n", "_range"))
        .groupBy(*keys)
        .agg(F.sum(n).alias("_n"), F.sum(s).alias("_s"), F.sum(w + F.col("_shift") * s).alias("_w"))
    )
    return totals.select(
        *keys,
        F.when((n > 0) & (s > 0), F.lit(2.0) * w / (n * s) - (n + 1) / n).otherwise(F.lit(0.0)).alias(alias),
    )
