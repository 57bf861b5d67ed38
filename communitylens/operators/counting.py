"""Counts, averages and report shapes over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_per_group(df: DataFrame, *keys: str, alias: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def distinct_per_group(df: DataFrame, keys: Sequence[str], column: str, alias: str, approximate: bool = False) -> DataFrame:
    """Distinct values per group.

    The exact form deduplicates on (keys, value) before counting, so a group with
    most of the rows is still spread over all tasks.
    """
    measure = F.approx_count_distinct(column) if approximate else F.count_distinct(F.col(column))
    return df.groupBy(*keys).agg(measure.alias(alias))


def count_and_mean(df: DataFrame, keys: Sequence[str], column: str, count_alias: str, mean_alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_alias), F.avg(column).alias(mean_alias))


def outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], fill_zero: bool = True) -> DataFrame:
    """Full outer join of two per-group tables, missing measures as 0."""
    merged = left.join(right, list(keys), "full_outer")
    return merged.na.fill(0) if fill_zero else merged


def with_total(df: DataFrame, columns: Sequence[str], alias: str) -> DataFrame:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return df.withColumn(alias, total)


def mean_over(df: DataFrame, key: str, columns: Sequence[str], sort_by: str) -> DataFrame:
    """Mean of per-period measures by key, largest first."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns]).orderBy(F.desc(sort_by), key)


def pivoted(df: DataFrame, index: str, column: str, value: str, values: Sequence, fill=None) -> DataFrame:
    """Long to wide. The output columns are named by the caller, so no extra pass finds them."""
    wide = df.groupBy(index).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.na.fill(fill)


def row_percent(df: DataFrame, index: str, value: str = "count", alias: str = "percent") -> DataFrame:
    """Each row's share in the total of its index, times 100. For aggregated tables."""
    whole = F.sum(value).over(Window.partitionBy(index))
    return df.withColumn(alias, F.col(value) / whole * 100)


def relative_to_max(df: DataFrame, group: str, value: str, alias: str = "relative") -> DataFrame:
    """Each row's value relative to the largest of its group.

    The maxima are aggregated and joined back, so no group has to pass through one task.
    """
    largest = df.groupBy(F.col(group).alias("_group")).agg(F.max(value).alias("_largest"))
    joined = df.join(largest, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn(alias, F.col(value) / F.col("_largest")).drop("_group", "_largest")


def overall_share(df: DataFrame, key: str, value: str = "count", alias: str = "share") -> DataFrame:
    """Each key's part in the grand total, which is one number computed beside the keys."""
    totals = df.groupBy(key).agg(F.sum(value).alias(value))
    return totals.withColumn(alias, F.col(value) / df.agg(F.sum(value)).scalar())


def peak_hours(df: DataFrame, hour: Column, alias: str = "hour", count_alias: str = "num_comments") -> DataFrame:
    return df.groupBy(hour.alias(alias)).agg(F.count(F.lit(1)).alias(count_alias)).orderBy(F.desc(count_alias), alias)
