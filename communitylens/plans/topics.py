"""Topics of all texts and their spread over months and communities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text, timeparts
from communitylens.operators import counting, filters, models, ranking
from communitylens.operators.events import before_after
from communitylens.session import cut_lineage


def documents(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """(text, subreddit, date, created_utc, clean_text) of live comments and posts with words left after cleaning."""
    columns = ["subreddit", "date", "created_utc"]
    left = filters.live_comments(comments).select(F.col("body").alias("text"), *columns)
    right = filters.live_posts(submissions).select(text.title_and_text("title", "selftext").alias("text"), *columns)
    return filters.with_words(left.unionByName(right), "text").withColumn("clean_text", text.topic_text("text"))


def community_grid(community_table: DataFrame, k: int = 20, topics: int = K.TOPIC_COUNT) -> DataFrame:
    """One row per community (the k largest), one column per topic."""
    sizes = community_table.groupBy("subreddit").agg(F.sum("count").alias("documents"))
    chosen = ranking.keep_keys(community_table, ranking.top_k(sizes, k, "documents", "subreddit"), "subreddit")
    return counting.pivoted(chosen, "subreddit", "dominant_topic", "count", range(topics), fill=0)


def month_grid(trend_table: DataFrame, topics: int = K.TOPIC_COUNT) -> DataFrame:
    """One row per month, one column per topic."""
    return counting.pivoted(trend_table, "year_month", "dominant_topic", "count", range(topics), fill=0)


def around_events(assigned: DataFrame, days: int = 30, events: Mapping[str, str] = K.EVENTS) -> DataFrame:
    """event_date, label, dominant_topic, n_before, n_after, share_before, share_after, delta (of the shares)"""
    counts = before_after(assigned.withColumn("_one", F.lit(1.0)), "date", "_one", days, events, by=["dominant_topic"])
    counts = cut_lineage(counts.select("event_date", "label", "dominant_topic", "n_before", "n_after"))
    whole = counts.groupBy("event_date", "label").agg(F.sum("n_before").alias("_before"), F.sum("n_after").alias("_after"))
    before, after = F.try_divide("n_before", "_before"), F.try_divide("n_after", "_after")
    return counts.join(whole, ["event_date", "label"]).select(
        "event_date", "label", "dominant_topic", "n_before", "n_after",
        before.alias("share_before"), after.alias("share_after"), (after - before).alias("delta"),
    )


def run(docs: DataFrame, k: int = K.TOPIC_COUNT, vocabulary: int = K.TOPIC_VOCABULARY, min_df: int = K.TOPIC_MIN_DF,
        iterations: int = K.TOPIC_ITERATIONS, words: int = K.TOPIC_WORDS, parts: int | None = None) -> dict[str, DataFrame]:
    """topics, topic_trends, topic_by_subreddit and topic_shares.

    Documents per (subreddit, date, topic) are counted once and stored; the tables
    are sums over that. ``parts``: see ``in_parts``.
    """
    names, vectors = models.topic_vectors(docs, ["subreddit", "date"], vocabulary=vocabulary, min_df=min_df)
    lda = models.fit_topics(vectors, k, iterations, parts=parts)
    assigned = models.dominant_topic(lda, vectors)
    monthly = assigned.withColumn("year_month", timeparts.year_month_unpadded("date"))
    cells = cut_lineage(counting.rows_per_group(monthly, "subreddit", "year_month", "dominant_topic"))

    def summed(*keys: str) -> DataFrame:
        return cells.groupBy(*keys).agg(F.sum("count").alias("count"))

    return {
        "topics": models.topic_words(names, lda, words),
        "topic_trends": summed("year_month", "dominant_topic").orderBy("year_month", "dominant_topic"),
        "topic_by_subreddit": summed("subreddit", "dominant_topic").orderBy(
            "subreddit", F.desc("count"), "dominant_topic"
        ),
        "topic_shares": counting.overall_share(cells, "dominant_topic"),
    }
