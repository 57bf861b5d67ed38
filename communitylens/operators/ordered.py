"""Division of ordered values into parts of about equal size, for running counts in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of one table's values, and of each group's values.
PARTS, GROUP_PARTS = 256, 64


def _shares(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def _place(bounds: Column, value: str) -> Column:
    """How many bounds lie below a value; a null value has no part."""
    return F.when(F.col(value).isNotNull(), F.size(F.filter(bounds, lambda b: b < F.col(value))))


def with_part(df: DataFrame, value: str, alias: str, parts: int = PARTS) -> DataFrame:
    """Adds the part of ``value`` between quantiles of the table, ascending with the value.

    The quantiles are a list of ``parts`` numbers, looked up by one job; equal values share a part.
    """
    bounds = df.approxQuantile(value, _shares(parts), 1 / (4 * parts))
    return df.withColumn(alias, _place(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<double>"), value))


def with_group_part(df: DataFrame, keys: Sequence[str], value: str, alias: str, parts: int = GROUP_PARTS) -> DataFrame:
    """The same between quantiles of each group; they come back by a join on the keys."""
    bounds = df.groupBy(F.struct(*keys).alias("_bounds_of")).agg(
        F.percentile_approx(value, _shares(parts), 8 * parts).alias("_bounds"))
    return (
        df.join(bounds, F.struct(*keys).eqNullSafe(F.col("_bounds_of")))
        .withColumn(alias, _place(F.col("_bounds"), value)).drop("_bounds", "_bounds_of")
    )
