"""Who talks where, and in which tone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions.labels import sentiment_sign
from communitylens.operators import filters, network
from communitylens.operators.sentiment import Rules, score_sentiment
from communitylens.sources.sampling import sample_adaptive


def messages(comments: DataFrame, communities: Sequence[str] | None = K.NETWORK_COMMUNITIES, start: str = K.DATE_START,
             end: str = K.DATE_END, fraction: float | None = None, key: str | None = "id") -> DataFrame:
    """(author, subreddit, body, created_utc) with author and body present; ``fraction`` samples them by hash of ``key``."""
    kept = filters.not_null(filters.in_period(comments, start, end), "author", "body")
    if communities is not None:
        kept = filters.in_communities(kept, communities)
    return sample_adaptive(kept, key, fraction).select("author", "subreddit", "body", "created_utc")


def signed(rows: DataFrame, lexicon: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """(author, subreddit, created_utc, sentiment_score in -1, 0, 1; copies)"""
    scored = score_sentiment(
        rows, "body", ["author", "subreddit", "created_utc"], lexicon, alias="compound", copies="copies", rules=rules
    )
    return scored.withColumn("sentiment_score", sentiment_sign("compound"))


def graph(rows: DataFrame, users: int = K.NETWORK_USERS, lexicon: DataFrame | None = None, rules: Rules = Rules(),
          pick: str = "mean") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over the most active users.

    The users are chosen before any text is scored, so only their messages are.
    """
    scores = signed(network.active_users(rows, users), lexicon, rules)
    edges = network.edges(scores, pick=pick, order_by="created_utc" if pick == "last" else None, copies="copies")
    return network.nodes(edges), edges.select("user", "subreddit", "weight", "sentiment")
