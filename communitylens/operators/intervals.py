"""Interval joins by time bins of length classes.

An interval of length n belongs to class ceil(log2 n) and covers at most two bins of that width. Two intervals
that overlap share a bin at the coarser class of the two, so a join on (class, bin) meets every overlapping pair
and an exact test keeps it; pairs that share two bins are kept in the later start's bin. Long and short, nested and
open intervals need no bins of a common size, and an interval's rows depend on the classes that occur, not on its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of missing starts and ends.
FIRST, LAST = -(1 << 61), 1 << 61


def _class(low: Column, high: Column) -> Column:
    """ceil(log2 of the length); 0 for lengths up to 1."""
    return F.when(high - low <= 1, 0).otherwise(F.length(F.bin(high - low - 1))).cast("int")


def _dealt(df: DataFrame, start: Column, end: Column, side: str) -> DataFrame:
    """The rows as one struct, with bounds and class; rows that cover nothing overlap nothing."""
    low = F.coalesce(start.cast("bigint"), F.lit(FIRST))
    high = F.coalesce(end.cast("bigint"), F.lit(LAST))
    rows = df.select(F.struct("*").alias(f"_{side}"), low.alias(f"_low_{side}"), high.alias(f"_high_{side}"))
    rows = rows.where(F.col(f"_low_{side}") < F.col(f"_high_{side}"))
    return rows.withColumn(f"_class_{side}", _class(F.col(f"_low_{side}"), F.col(f"_high_{side}")))


def _binned(rows: DataFrame, side: str, classes: list[int]) -> DataFrame:
    """A row per bin at each class that is not finer than the row's own."""
    coarser = F.filter(F.array(*map(F.lit, classes)), lambda c: c >= F.col(f"_class_{side}"))
    rows = rows.withColumn("_class", F.explode(coarser))
    low, high = F.expr(f"shiftright(_low_{side}, _class)"), F.expr(f"shiftright(_high_{side} - 1, _class)")
    return rows.withColumn("_bin", F.explode(F.sequence(low, high)))


def overlapping(left: DataFrame, right: DataFrame, left_start: str, left_end: str | None, right_start: str, right_end: str | None) -> DataFrame:
    """Every pair of a left and a right row whose intervals share a moment; the columns of both.

    Bounds are whole numbers (seconds, days): the start is inside, the end is not. Without an end column rows are moments
    of length 1. A null end is open, a null start has always been, and an interval without length shares nothing. Rows that
    repeat pair each for themselves. Columns must have different names on both sides.
    """
    def bounds(start: str, end: str | None) -> tuple[Column, Column]:
        return F.col(start), F.col(end) if end else F.when(F.col(start).isNotNull(), F.col(start).cast("bigint") + 1).otherwise(F.lit(FIRST))

    a, b = _dealt(left, *bounds(left_start, left_end), "a"), _dealt(right, *bounds(right_start, right_end), "b")
    found = a.select("_class_a").distinct().union(b.select("_class_b").distinct()).distinct().collect()  # at most 64 numbers
    classes = sorted(r[0] for r in found)
    if not classes:
        classes = [0]
    pairs = _binned(a, "a", classes).join(_binned(b, "b", classes), ["_class", "_bin"])
    pairs = pairs.where(
        (F.col("_class") == F.greatest("_class_a", "_class_b"))
        & (F.col("_low_a") < F.col("_high_b")) & (F.col("_low_b") < F.col("_high_a"))
        & (F.col("_bin") == F.expr("shiftright(greatest(_low_a, _low_b), _class)")))
    return pairs.select("_a.*", "_b.*")
