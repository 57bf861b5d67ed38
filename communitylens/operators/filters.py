"""Row and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text, timeparts


def in_communities(df: DataFrame, names: Iterable[str], column: str = "subreddit", ignore_case: bool = False) -> DataFrame:
    if ignore_case:
        return df.where(F.lower(column).isin([n.lower() for n in names]))
    return df.where(F.col(column).isin(list(names)))


def in_period(df: DataFrame, start: str = K.DATE_START, end: str = K.DATE_END, column: str = "created_utc",
              end_inclusive: str = "instant") -> DataFrame:
    return df.where(timeparts.within(column, start, end, end_inclusive))


def scoped(df: DataFrame, names: Iterable[str] | None, start: str = K.DATE_START, end: str = K.DATE_END,
           end_inclusive: str = "instant") -> DataFrame:
    """Rows of the communities within the period, with their ``month``."""
    kept = in_period(df, start, end, end_inclusive=end_inclusive)
    if names is not None:
        kept = in_communities(kept, names)
    return kept.withColumn("month", timeparts.utc_month("created_utc"))


def live_comments(df: DataFrame, column: str = "body") -> DataFrame:
    """Comments whose text is neither missing, empty nor a deletion marker."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*K.DELETED_MARKERS) & (F.col(column) != ""))


def live_posts(df: DataFrame, column: str = "title") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def non_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def with_words(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``topic_text`` is not empty.

    Looks for a first letter instead of comparing the cleaned text with '': a filter on
    the cleaned text would make Spark clean every text twice.
    """
    return df.where(text.remove_urls(F.lower(column)).rlike("[a-z]"))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def select_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist; missing ones are left out silently."""
    return df.select(*[c for c in wanted if c in df.columns])


def zero_filled(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=list(columns) if columns is not None else None)


def coerced(df: DataFrame, dates: Sequence[str] = (), numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Dates that parse (else null), numbers that parse (else 0), text."""
    changes: dict[str, Column] = {c: F.try_to_date(F.col(c)) for c in dates}
    changes |= {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numbers}
    changes |= {c: F.col(c).cast("string") for c in texts}
    return df.withColumns(changes)
