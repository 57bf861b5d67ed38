"""The user-community interaction graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.operators.ranking import keep_keys, most_frequent


def active_users(df: DataFrame, k: int = K.NETWORK_USERS, author: str = "author") -> DataFrame:
    """Rows of the k users with most rows."""
    return keep_keys(df, most_frequent(df, author, k), author)


def edges(df: DataFrame, author: str = "author", community: str = "subreddit", sentiment: str = "sentiment_score",
          pick: str = "mean", order_by: str | None = None, copies: str | None = None) -> DataFrame:
    """(user, subreddit, weight = 1, sentiment, n): one row per pair that occurs.

    ``pick="mean"`` averages the pair's sentiment; ``"last"`` takes it from the pair's
    latest row by ``order_by``.
    """
    weight = F.lit(1) if copies is None else F.col(copies)
    if pick == "mean":
        value = F.sum(F.col(sentiment) * weight) / F.sum(weight)
    elif pick == "last" and order_by:
        value = F.max_by(sentiment, F.struct(order_by, sentiment))
    else:
        raise ValueError("pick must be 'mean', or 'last' together with order_by")
    return (
        df.groupBy(F.col(author).alias("user"), F.col(community).alias("subreddit"))
        .agg(value.alias("sentiment"), F.sum(weight).alias("n"), F.sum(F.col(sentiment) * weight).alias("total"))
        .withColumn("weight", F.lit(1))
        .select("user", "subreddit", "weight", "sentiment", "n", "total")
    )


def degrees(edge_table: DataFrame) -> DataFrame:
    """(id, type, degree): distinct neighbours of each node."""
    return _per_node(edge_table, F.count(F.lit(1)).alias("degree"))


def node_means(edge_table: DataFrame) -> DataFrame:
    """(id, type, sentiment): mean sentiment over the node's rows (not over its edges)."""
    return _per_node(edge_table, (F.sum("total") / F.sum("n")).alias("sentiment"))


def nodes(edge_table: DataFrame) -> DataFrame:
    """(id, type, degree, sentiment)"""
    return _per_node(
        edge_table, F.count(F.lit(1)).alias("degree"), (F.sum("total") / F.sum("n")).alias("sentiment")
    )


def _per_node(edge_table: DataFrame, *measures) -> DataFrame:
    """Each edge counts for both of its ends. Edges are already one row per pair."""
    ends = F.array(
        F.struct(F.col("user").alias("id"), F.lit("user").alias("type")),
        F.struct(F.col("subreddit").alias("id"), F.lit("subreddit").alias("type")),
    )
    return edge_table.select(F.inline(ends), "n", "total").groupBy("id", "type").agg(*measures)
