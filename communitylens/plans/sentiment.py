"""Sentiment by community, month and category, and around events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text, timeparts
from communitylens.operators import counting, filters, ranking
from communitylens.operators.events import before_after
from communitylens.operators.sentiment import Rules, score_sentiment, with_class
from communitylens.session import cut_lineage, literal_table
from communitylens.sources import sinks
from communitylens.sources.sampling import hash_sample


def documents(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Live comments and posts as (text, subreddit, date, created_utc, upvotes, type)."""
    columns = ["subreddit", "date", "created_utc"]
    left = filters.live_comments(comments).select(
        F.col("body").alias("text"), *columns, F.col("score").alias("upvotes"), F.lit("comment").alias("type")
    )
    right = filters.live_posts(submissions).select(
        text.title_and_text("title", "selftext").alias("text"), *columns,
        F.col("score").alias("upvotes"), F.lit("submission").alias("type"),
    )
    return left.unionByName(right).withColumn("text", text.sentiment_text("text"))


def cube(docs: DataFrame, lexicon: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """(subreddit, year_month, sentiment_category, n, total): every sentiment table is a sum over this one."""
    keyed = docs.withColumn("year_month", timeparts.year_month_unpadded("date"))
    scored = score_sentiment(keyed, "text", ["subreddit", "year_month"], lexicon, copies="copies", rules=rules)
    return (
        with_class(scored).groupBy("subreddit", "year_month", "sentiment_category")
        .agg(F.sum("copies").alias("n"), F.sum(F.col("sentiment_score") * F.col("copies")).alias("total"))
    )


def _mean(cells: DataFrame, keys: Sequence[str], count_alias: str) -> DataFrame:
    return cells.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("avg_sentiment"), F.sum("n").alias(count_alias))


def distribution(cells: DataFrame) -> DataFrame:
    """sentiment_category, count; largest first"""
    return cells.groupBy("sentiment_category").agg(F.sum("n").alias("count")).orderBy(F.desc("count"))


def by_community(cells: DataFrame) -> DataFrame:
    """subreddit, avg_sentiment, total_posts; most positive first"""
    return _mean(cells, ["subreddit"], "total_posts").orderBy(F.desc("avg_sentiment"), "subreddit")


def by_month(cells: DataFrame) -> DataFrame:
    """year_month, avg_sentiment, total_posts"""
    return _mean(cells, ["year_month"], "total_posts").orderBy("year_month")


def by_community_month(cells: DataFrame) -> DataFrame:
    """subreddit, year_month, avg_sentiment, post_count"""
    return _mean(cells, ["subreddit", "year_month"], "post_count").orderBy("subreddit", "year_month")


def distribution_by_community(cells: DataFrame) -> DataFrame:
    """subreddit, sentiment_category, count"""
    return (
        cells.groupBy("subreddit", "sentiment_category").agg(F.sum("n").alias("count"))
        .orderBy("subreddit", "sentiment_category")
    )


def category_percent(cells: DataFrame, k: int = 20) -> DataFrame:
    """subreddit, sentiment_category, count, percent for the k communities with most texts"""
    counts = distribution_by_community(cells)
    sizes = counts.groupBy("subreddit").agg(F.sum("count").alias("total_posts"))
    chosen = ranking.top_k(sizes, k, "total_posts", "subreddit")
    return counting.row_percent(ranking.keep_keys(counts, chosen, "subreddit"), "subreddit")


def tables(cells: DataFrame) -> dict[str, DataFrame]:
    return {
        "sentiment_distribution_overall": distribution(cells),
        "sentiment_by_subreddit": by_community(cells),
        "sentiment_trends": by_month(cells),
        "sentiment_subreddit_time": by_community_month(cells),
        "sentiment_distribution": distribution_by_community(cells),
    }


def run(comments: DataFrame, submissions: DataFrame, folder: str, lexicon: DataFrame | None = None, rules: Rules = Rules()) -> None:
    """Score every text once, store the cube, and write the five tables from it."""
    cells = cut_lineage(cube(documents(comments, submissions), lexicon, rules))
    sinks.write_tables(tables(cells), folder, {
        "sentiment_distribution_overall": [F.desc("count")],
        "sentiment_by_subreddit": [F.desc("avg_sentiment"), "subreddit"],
        "sentiment_trends": ["year_month"],
        "sentiment_subreddit_time": ["subreddit", "year_month"],
        "sentiment_distribution": ["subreddit", "sentiment_category"],
    })


def categorised(df: DataFrame, categories: Mapping[str, Sequence[str]] = K.CATEGORIES, column: str = "subreddit") -> DataFrame:
    """Rows of communities that belong to a category, with it; a community may belong to several."""
    pairs = [(category, name) for category, names in categories.items() for name in names]
    return df.join(literal_table(df.sparkSession, pairs, f"category string, {column} string"), column)


def category_scores(comments: DataFrame, categories: Mapping[str, Sequence[str]] = K.CATEGORIES,
                    start: str = K.DATE_START, end: str = K.DATE_END, key: str = "id",
                    fraction: float | None = None, lexicon: DataFrame | None = None,
                    rules: Rules = Rules()) -> DataFrame:
    """(category, subreddit, month, date, sentiment_score, n): mean score of each community and day, in one scan.

    ``fraction`` samples by hash of ``key``; None scores everything. Categories are
    attached to the daily means, not to the texts.
    """
    names = sorted({name for members in categories.values() for name in members})
    kept = filters.scoped(comments, names, start, end).where(F.col("body").isNotNull())
    if fraction is not None:
        kept = hash_sample(kept, key, fraction)
    dated = kept.withColumn("date", timeparts.utc_date("created_utc"))
    scored = score_sentiment(dated, "body", ["subreddit", "month", "date"], lexicon, copies="copies", rules=rules)
    daily = scored.groupBy("subreddit", "month", "date").agg(
        (F.sum(F.col("sentiment_score") * F.col("copies")) / F.sum("copies")).alias("sentiment_score"),
        F.sum("copies").alias("n"),
    )
    return categorised(daily, categories)


def category_trend(scores: DataFrame) -> DataFrame:
    """month, avg_sentiment, category"""
    return scores.groupBy("month", "category").agg(
        (F.sum(F.col("sentiment_score") * F.col("n")) / F.sum("n")).alias("avg_sentiment")
    ).select("month", "avg_sentiment", "category").orderBy("category", "month")


def event_impact(scores: DataFrame, days: int = 30, events: Mapping[str, str] = K.EVENTS) -> DataFrame:
    """event_date, label, category, avg_before, avg_after, delta, n_before, n_after"""
    return before_after(scores, "date", "sentiment_score", days, events, by=["category"], weight="n")
