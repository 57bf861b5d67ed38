"""Activity, retention, concentration of attention, and shared audiences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text, timeparts
from communitylens.operators import counting, filters
from communitylens.operators.inequality import gini
from communitylens.operators.overlap import overlap
from communitylens.operators.retention import retention as returning


def activity(comments: DataFrame, submissions: DataFrame, communities: Sequence[str] | None = K.ACTIVITY_COMMUNITIES,
             start: str = K.DATE_START, end: str = K.DATE_END, approximate: bool = False) -> DataFrame:
    """subreddit, month, posts, comments, total_activity"""
    keys = ["subreddit", "month"]
    merged = counting.outer_merge(
        counting.distinct_per_group(filters.scoped(submissions, communities, start, end), keys, "id", "posts", approximate),
        counting.distinct_per_group(filters.scoped(comments, communities, start, end), keys, "id", "comments", approximate),
        keys,
    )
    return counting.with_total(merged, ["posts", "comments"], "total_activity")


def retention(comments: DataFrame, submissions: DataFrame, communities: Sequence[str] | None = K.RETENTION_COMMUNITIES,
              start: str = K.DATE_START, end: str = K.DATE_END, previous: str = "present",
              exclude_authors: tuple[str, ...] = ()) -> DataFrame:
    """subreddit, month, active_users, returning_users, engagement_ratio"""
    columns = ["subreddit", "month", "author"]
    everyone = filters.scoped(comments, communities, start, end).select(*columns).unionByName(
        filters.scoped(submissions, communities, start, end).select(*columns)
    )
    return returning(
        everyone, previous=previous, exclude_authors=exclude_authors, periods=timeparts.months_between(start, end)
    )


def attention(comments: DataFrame, submissions: DataFrame, communities: Sequence[str] | None = K.GINI_COMMUNITIES,
              start: str = K.DATE_START, end: str = K.DATE_END) -> DataFrame:
    """subreddit, month, gini_comments, gini_scores; a side without rows stays null"""
    keys = ["subreddit", "month"]
    replies = (
        filters.scoped(comments, communities, start, end)
        .withColumn("post_id", text.strip_post_prefix("link_id"))
    )
    replies_per_post = counting.distinct_per_group(replies, [*keys, "post_id"], "id", "comments_on_post")
    score_per_post = (
        filters.scoped(submissions, communities, start, end)
        .groupBy(*keys, "id").agg(F.max("score").alias("post_score"))
    )
    merged = counting.outer_merge(
        gini(replies_per_post, keys, "comments_on_post", "gini_comments"),
        gini(score_per_post, keys, "post_score", "gini_scores"),
        keys, fill_zero=False,
    )
    return merged.orderBy(*keys)


def attention_mean(attention_table: DataFrame) -> DataFrame:
    """subreddit, gini_comments, gini_scores averaged over months, most concentrated first"""
    return counting.mean_over(attention_table, "subreddit", ["gini_comments", "gini_scores"], "gini_comments")


def audience_overlap(comments: DataFrame, submissions: DataFrame, communities: Sequence[str] = K.OVERLAP_COMMUNITIES,
                     start: str = K.DATE_START, end: str = K.DATE_END,
                     exclude_authors: tuple[str, ...] = ()) -> DataFrame:
    """a, b, shared, joint, jaccard"""
    columns = ["subreddit", "author"]
    everyone = filters.scoped(comments, communities, start, end).select(*columns).unionByName(
        filters.scoped(submissions, communities, start, end).select(*columns)
    )
    return overlap(everyone, communities, exclude_authors=exclude_authors)


def overlap_matrix(pairs: DataFrame, communities: Sequence[str] = K.OVERLAP_COMMUNITIES) -> DataFrame:
    """One row and one column per community."""
    named = pairs.select(F.col("a").alias("subreddit"), F.col("b").alias("other"), "jaccard")
    return counting.pivoted(named, "subreddit", "other", "jaccard", communities)
