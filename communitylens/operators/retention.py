"""Users who come back from one period to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from communitylens.functions.labels import guarded_ratio
from communitylens.session import literal_table

_BITS = 62


def _moves_by_lag(seen: DataFrame, community: str, period: str, author: str) -> DataFrame:
    """(community, period, _from, _users): users per period and their own period before it."""
    per_user = Window.partitionBy(community, author).orderBy(period)
    return (
        seen.distinct()
        .withColumn("_from", F.lag(period).over(per_user))
        .groupBy(community, period, "_from")
        .agg(F.count(author).alias("_users"))
    )


def _moves_by_mask(seen: DataFrame, community: str, period: str, author: str, periods: Sequence) -> DataFrame:
    """The same from a bit mask of periods per user, made while still on the map side.

    Users with the same mask are counted together before masks are taken apart again.
    """
    ordered = sorted(set(periods))
    kind = seen.schema[period].dataType.simpleString()
    places = literal_table(
        seen.sparkSession, [(p, i // _BITS, 1 << (i % _BITS)) for i, p in enumerate(ordered)],
        f"{period} {kind}, _word int, _bit bigint",
    )
    masks = [f"_mask{w}" for w in range((len(ordered) + _BITS - 1) // _BITS)]
    patterns = (
        seen.join(places, period)
        .groupBy(community, author)
        .agg(*[F.coalesce(F.bit_or(F.when(F.col("_word") == w, F.col("_bit"))), F.lit(0)).alias(m) for w, m in enumerate(masks)])
        .groupBy(community, *masks).agg(F.count(author).alias("_users"))
    )
    present = F.filter(
        F.array(*[
            F.when(F.col(masks[i // _BITS]).bitwiseAND(F.lit(1 << (i % _BITS))) != 0, F.lit(p).cast(kind))
            for i, p in enumerate(ordered)
        ]),
        lambda p: p.isNotNull(),
    )
    steps = F.arrays_zip(
        F.col("_present").alias("to"), F.concat(F.array(F.lit(None).cast(kind)), F.col("_present")).alias("from")
    )
    return (
        patterns.select(community, "_users", present.alias("_present"))
        .select(community, "_users", F.explode_outer(steps).alias("_step"))
        .where(F.col("_step.to").isNotNull())
        .groupBy(community, F.col("_step.to").alias(period), F.col("_step.from").alias("_from"))
        .agg(F.sum("_users").alias("_users"))
    )


def retention(df: DataFrame, community: str = "subreddit", period: str = "month", author: str = "author",
              previous: str = "present", exclude_authors: tuple[str, ...] = (), periods: Sequence | None = None) -> DataFrame:
    """active_users, returning_users and engagement_ratio per community and period.

    A user returns if also seen in the community's previous period: the previous
    one with any rows (``previous="present"``), or the previous calendar month
    (``"calendar"``). Missing authors count as nobody, but their rows make the
    period exist. The first period has no returning users.

    ``periods`` names all periods to look at. A user's periods then travel as a bit
    mask and the rows are shuffled once. Without it rows are deduplicated to
    (community, user, period) and each user's period before is a lag over at most one
    row per period. Either way only a small table of (period, period before) counts is
    matched with the community's calendar.
    """
    if previous not in ("present", "calendar"):
        raise ValueError(f"previous must be 'present' or 'calendar', not {previous!r}")
    seen = df.select(community, period, author)
    if exclude_authors:
        seen = seen.withColumn(author, F.when(~F.col(author).isin(*exclude_authors), F.col(author)))
    if periods is not None:
        moves = _moves_by_mask(seen, community, period, author, periods)
    else:
        moves = _moves_by_lag(seen, community, period, author)
    per_period = moves.groupBy(community, period).agg(
        F.sum("_users").alias("active_users"),
        F.collect_list(F.struct(F.col("_from"), F.col("_users"))).alias("_moves"),
    )
    if previous == "present":
        before = F.lag(period).over(Window.partitionBy(community).orderBy(period))
    else:
        before = F.add_months(F.col(period), -1)
    returning = F.aggregate(
        F.filter("_moves", lambda m: m["_from"] == F.col("_before")),
        F.lit(0).cast("bigint"),
        lambda total, m: total + m["_users"],
    )
    return (
        per_period.withColumn("_before", before)
        .withColumn("returning_users", returning)
        .select(
            community, period, "active_users", "returning_users",
            guarded_ratio("returning_users", "active_users").alias("engagement_ratio"),
        )
    )
