"""Calendar expressions over epoch seconds, always in UTC.

Dates and hours are derived with integer arithmetic, so results do not depend on
``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_timestamp(epoch: Column | str) -> Column:
    return F.timestamp_seconds(_col(epoch))


def utc_clock(epoch: Column | str) -> Column:
    """Date and time in UTC, without a zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=_col(epoch))


def unix_time_text(epoch: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text in UTC."""
    return utc_clock(_col(epoch).cast("bigint")).cast("string")


def utc_date(epoch: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(_col(epoch) / _DAY).cast("int"))


def month_start(date: Column | str) -> Column:
    return F.trunc(_col(date), "month")


def utc_month(epoch: Column | str) -> Column:
    return month_start(utc_date(epoch))


def year_month_unpadded(date: Column | str) -> Column:
    """``2023-6``; sorts as text, so October comes before June."""
    return F.concat_ws("-", F.year(_col(date)), F.month(_col(date)))


def year_month_padded(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def utc_hour(epoch: Column | str) -> Column:
    return F.floor(F.pmod(_col(epoch), F.lit(_DAY)) / 3600).cast("int")


def utc_weekday(epoch: Column | str) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(utc_date(epoch))


def epoch_of(day: str) -> int:
    return int(datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp())


def months_between(start: str, end: str) -> list[date]:
    """First days of all months from ``start`` to ``end``."""
    first, last = (datetime.strptime(day, "%Y-%m-%d") for day in (start, end))
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    return [date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1) for i in range(count)]


def within(epoch: Column | str, start: str, end: str, end_inclusive: str = "instant") -> Column:
    """Rows from ``start`` 00:00:00 on.

    ``end_inclusive="instant"`` keeps rows up to ``end`` 00:00:00 exactly;
    ``"day"`` keeps the whole last day. Both bounds are integer literals compared
    with the raw column, so parquet row groups are skipped by their statistics.
    """
    if end_inclusive not in ("instant", "day"):
        raise ValueError(f"end_inclusive must be 'instant' or 'day', not {end_inclusive!r}")
    epoch = _col(epoch)
    low = F.lit(epoch_of(start))
    if end_inclusive == "instant":
        return (epoch >= low) & (epoch <= F.lit(epoch_of(end)))
    next_day = (datetime.strptime(end, "%Y-%m-%d") + timedelta(days=1)).strftime("%Y-%m-%d")
    return (epoch >= low) & (epoch < F.lit(epoch_of(next_day)))


def between_dates(date: Column | str, start: str, end: str) -> Column:
    return _col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
