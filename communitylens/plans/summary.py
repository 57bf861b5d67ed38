"""What the collected tables contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.functions import timeparts
from communitylens.operators import counting, ranking
from communitylens.session import cut_lineage


def cells(df: DataFrame) -> DataFrame:
    """(subreddit, year_month, n, score_sum, scored, first, last): all three reports are sums over this one.

    Without a ``year_month`` or ``score`` column the reports that need it have none.
    """
    month = F.col("year_month") if "year_month" in df.columns else timeparts.year_month_padded("date")
    score = F.col("score") if "score" in df.columns else F.lit(None).cast("bigint")
    return df.groupBy("subreddit", month.alias("year_month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("score_sum"), F.count(score).alias("scored"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


def _global(counted: DataFrame, name: str) -> DataFrame:
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.min("first").cast("string").alias("date_range_start"),
        F.max("last").cast("string").alias("date_range_end"),
    ).select(
        F.lit(name).alias("data_type"), "total_rows", F.round(F.col("total_rows") * 0.000001, 2).alias("size_gb"),
        "date_range_start", "date_range_end",
    )


def global_stats(df: DataFrame, name: str) -> DataFrame:
    """Rows, first and last date in one pass. ``size_gb`` is an estimate of 1 KB per row."""
    return _global(df.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")), name)


def dataset_summary(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """data_type, total_rows, size_gb, date_range_start, date_range_end"""
    return global_stats(comments, "comments").unionByName(global_stats(submissions, "submissions"))


def community_statistics(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """subreddit, num_comments, avg_comment_score, num_submissions, avg_submission_score, total_rows"""
    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"), F.count("score").alias("scored"))

    return _community(counted(comments), counted(submissions))


def _community(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    def side(counted: DataFrame, count: str, mean: str) -> DataFrame:
        return counted.groupBy("subreddit").agg(
            F.sum("n").alias(count), F.try_divide(F.sum("score_sum"), F.sum("scored")).alias(mean))
    merged = counting.outer_merge(
        side(comments, "num_comments", "avg_comment_score"), side(submissions, "num_submissions", "avg_submission_score"), ["subreddit"])
    return counting.with_total(merged, ["num_comments", "num_submissions"], "total_rows")


def temporal_distribution(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """year_month, num_comments, num_submissions, total_rows"""
    return _temporal(cells(comments), cells(submissions))


def _temporal(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    merged = counting.outer_merge(
        comments.groupBy("year_month").agg(F.sum("n").alias("num_comments")),
        submissions.groupBy("year_month").agg(F.sum("n").alias("num_submissions")), ["year_month"])
    return counting.with_total(merged, ["num_comments", "num_submissions"], "total_rows")


def unique_totals(comments: DataFrame, approximate: bool = False) -> DataFrame:
    """unique_comments, unique_users; counted apart, since two exact counts in one pass would double every row."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    if approximate:
        return comments.agg(distinct(F.col("id")).alias("unique_comments"), distinct(F.col("author")).alias("unique_users"))
    one = comments.sparkSession.range(1)
    return one.select(
        comments.agg(distinct(F.col("id"))).scalar().alias("unique_comments"),
        comments.agg(distinct(F.col("author"))).scalar().alias("unique_users"),
    )


def top_communities(comments: DataFrame, k: int = 10) -> DataFrame:
    """subreddit, num_comments of the k largest communities"""
    return ranking.top_k(
        counting.rows_per_group(comments, "subreddit", alias="num_comments"), k, "num_comments", "subreddit"
    )


def peak_hours(comments: DataFrame) -> DataFrame:
    """hour (UTC), num_comments, busiest first"""
    return counting.peak_hours(comments, timeparts.utc_hour("created_utc"))


def tables(comments: DataFrame, submissions: DataFrame) -> dict[str, DataFrame]:
    """The three reports from one pass over each table."""
    left, right = cut_lineage(cells(comments)), cut_lineage(cells(submissions))
    return {
        "dataset_summary": _global(left, "comments").unionByName(_global(right, "submissions")),
        "subreddit_statistics": _community(left, right),
        "temporal_distribution": _temporal(left, right),
    }


def forum_basics(comments: DataFrame) -> dict[str, DataFrame]:
    return {
        "dataset_stats": unique_totals(comments),
        "top_subreddits": top_communities(comments),
        "peak_hours": peak_hours(comments),
    }
