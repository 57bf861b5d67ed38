"""Daily summary of trip records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(trips: DataFrame, year: int | None = 2021, pickup: str = "tpep_pickup_datetime", accuracy: int = 10_000) -> DataFrame:
    """dt_year, dt_month, dt_day, num_trips, mean_trip_distance, max_mta_tax, q95_fare_amount,
    min_tip_amount, mean_passenger_count; latest day first. The quantile's rank is off by at most trips / accuracy."""
    if year is not None:
        # A range on the raw column, in its own type, so that parquet statistics can skip row groups.
        kind = trips.schema[pickup].dataType
        trips = trips.where(
            (F.col(pickup) >= F.lit(f"{year}-01-01 00:00:00").cast(kind))
            & (F.col(pickup) < F.lit(f"{year + 1}-01-01 00:00:00").cast(kind))
        )
    dated = trips.withColumns({
        "dt_year": F.year(pickup), "dt_month": F.month(pickup), "dt_day": F.dayofmonth(pickup),
    })
    return (
        dated.groupBy("dt_year", "dt_month", "dt_day")
        .agg(
            F.count(F.lit(1)).alias("num_trips"),
            F.avg("trip_distance").alias("mean_trip_distance"),
            F.max("mta_tax").alias("max_mta_tax"),
            F.percentile_approx("fare_amount", 0.95, accuracy).alias("q95_fare_amount"),
            F.min("tip_amount").alias("min_tip_amount"),
            F.ceil(F.avg("passenger_count")).alias("mean_passenger_count"),
        )
        .orderBy(F.desc("dt_year"), F.desc("dt_month"), F.desc("dt_day"))
    )


def run_summary(days: DataFrame) -> DataFrame:
    """One row over the daily table: days, first and last month and day, trips in total and per day."""
    return days.agg(
        F.count(F.lit(1)).alias("days"),
        F.min("dt_month").alias("first_month"), F.min("dt_day").alias("first_day"),
        F.max("dt_month").alias("last_month"), F.max("dt_day").alias("last_day"),
        F.sum("num_trips").alias("total_trips"), F.avg("num_trips").alias("mean_daily_trips"),
    )
