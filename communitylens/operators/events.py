"""Dated events against a series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.session import literal_table


def event_table(spark, events: Mapping[str, str] = K.EVENTS) -> DataFrame:
    """(event_date, label)"""
    rows = literal_table(spark, events.items(), "event_date string, label string")
    return rows.withColumn("event_date", F.to_date("event_date"))


def _literal_events(events: Mapping[str, str]) -> Column:
    return F.array(*[
        F.struct(F.lit(day).cast("date").alias("event_date"), F.lit(label).alias("label"))
        for day, label in events.items()
    ])


def events_in_span(series: DataFrame, period: str, events: Mapping[str, str] = K.EVENTS, clip: bool = True) -> DataFrame:
    """(event_date, label, span_start, span_end): events on the time axis of a series.

    ``clip`` keeps only events between the first and last period.
    """
    span = series.agg(F.min(period).cast("date").alias("span_start"), F.max(period).cast("date").alias("span_end"))
    placed = span.select(F.inline(_literal_events(events)), "span_start", "span_end")
    return placed.where(F.col("event_date").between(F.col("span_start"), F.col("span_end"))) if clip else placed


def before_after(df: DataFrame, date: str, value: str, days: int, events: Mapping[str, str] = K.EVENTS,
                 by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Volume and mean of ``value`` in the ``days`` before and from each event.

    (event_date, label, by..., avg_before, avg_after, delta, n_before, n_after).
    Rows are first reduced to one per date and ``by``; each date is then matched by
    equality with the dates an event covers, so no range join is needed. ``weight``
    names a row multiplicity.
    """
    by = list(by)
    weights = F.lit(1) if weight is None else F.col(weight)
    daily = df.groupBy(F.col(date).cast("date").alias("_day"), *by).agg(
        F.sum(F.col(value) * weights).alias("_sum"),
        F.sum(F.when(F.col(value).isNotNull(), weights)).alias("_valued"),
        F.sum(weights).alias("_rows"),
    )
    covered = (
        event_table(df.sparkSession, events)
        .withColumn("_offset", F.explode(F.sequence(F.lit(-days), F.lit(days - 1))))
        .withColumn("_day", F.date_add("event_date", F.col("_offset")))
    )
    before, after = F.col("_offset") < 0, F.col("_offset") >= 0

    def part(column: str, side: Column) -> Column:
        return F.sum(F.when(side, F.col(column)))

    def mean(side: Column) -> Column:
        return F.try_divide(part("_sum", side), part("_valued", side))

    return daily.join(covered, "_day").groupBy("event_date", "label", *by).agg(
        mean(before).alias("avg_before"),
        mean(after).alias("avg_after"),
        (mean(after) - mean(before)).alias("delta"),
        F.coalesce(part("_rows", before), F.lit(0)).cast("bigint").alias("n_before"),
        F.coalesce(part("_rows", after), F.lit(0)).cast("bigint").alias("n_after"),
    )
