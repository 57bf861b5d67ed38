"""Discussion types and their leading terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text
from communitylens.operators import counting, filters
from communitylens.operators.discussion import discussion_type
from communitylens.operators.terms import leading_terms
from communitylens.session import cut_lineage


def contents(comments: DataFrame, submissions: DataFrame, communities: Sequence[str] | None = K.DISCUSSION_COMMUNITIES,
             start: str = K.DATE_START, end: str = K.DATE_END) -> DataFrame:
    """(subreddit, month, content) of comments and posts."""
    columns = ["subreddit", "month", "content"]
    left = filters.scoped(comments, communities, start, end).withColumnRenamed("body", "content")
    right = filters.scoped(submissions, communities, start, end).withColumn(
        "content", text.title_and_text_padded("title", "selftext")
    )
    return left.select(*columns).unionByName(right.select(*columns))


def tables(docs: DataFrame, classes: Mapping[str, Sequence[str]] = K.KEYWORD_CLASSES,
           unwanted: Sequence[str] | None = None, lemmas: DataFrame | None = None,
           terms: int = K.CLOUD_MAX_WORDS) -> dict[str, DataFrame]:
    """Counts per type, type and community, type and month, and the leading terms of each type.

    The three counts are sums over one stored table of (community, month, type).
    """
    typed = discussion_type(docs, "content", classes, unwanted, lemmas=lemmas)
    cells = cut_lineage(counting.rows_per_group(typed, "subreddit", "month", "topic_type"))

    def summed(*keys: str) -> DataFrame:
        return cells.groupBy(*keys).agg(F.sum("count").alias("count"))

    return {
        "discussion_types": summed("topic_type"),
        "discussion_types_by_subreddit": summed("subreddit", "topic_type"),
        "discussion_types_by_month": summed("month", "topic_type"),
        "discussion_terms": leading_terms(typed, "tokens", "topic_type", terms, lemmas),
    }
