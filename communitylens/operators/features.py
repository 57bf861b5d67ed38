"""Feature stages for the models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    IDF, CountVectorizer, HashingTF, StopWordsRemover, Tokenizer, VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import labels, text, timeparts

BEHAVIOUR = ("comment_length", "has_url", "hour_of_day", "day_of_week")


def behaviour_features(df: DataFrame, body: str = "body", epoch: str = "created_utc") -> DataFrame:
    """Length, URL flag, UTC hour and weekday of comments that have a text."""
    return df.withColumns({
        "comment_length": F.length(body),
        "has_url": text.has_url(body),
        "hour_of_day": timeparts.utc_hour(epoch),
        "day_of_week": timeparts.utc_weekday(epoch),
    }).where(F.col(body).isNotNull())


def class_weights(df: DataFrame, label: str = "label") -> dict[int, float]:
    """{0: total / (2 n0), 1: total / (2 n1)}; a class without rows counts as 1."""
    counts = {row[label]: row["count"] for row in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    return {c: total / (2 * counts.get(c, 1)) for c in (0, 1)}


def class_weight_table(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, class_weight) of the labels that occur."""
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("class_weight", total / (F.col("n") * 2))


def with_class_weight(df: DataFrame, label: str = "label", alias: str = "class_weight") -> DataFrame:
    weights = class_weights(df, label)
    return df.withColumn(alias, F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]))


def tokenizer(source: str, target: str = "words") -> Tokenizer:
    return Tokenizer(inputCol=source, outputCol=target)


def stop_words_remover(source: str, target: str, extra: Sequence[str] = ()) -> StopWordsRemover:
    return StopWordsRemover(inputCol=source, outputCol=target, stopWords=[*K.ENGLISH_STOP_WORDS, *extra])


def hashed_tfidf(source: str, size: int, target: str = "features") -> list:
    """Stages from text to TF-IDF over ``size`` hash buckets (columns words, filtered_words)."""
    return [
        tokenizer(source),
        stop_words_remover("words", "filtered_words"),
        HashingTF(inputCol="filtered_words", outputCol="raw_features", numFeatures=size),
        IDF(inputCol="raw_features", outputCol=target),
    ]


def counted_tfidf(source: str, vocabulary: int, min_df: float, extra: Sequence[str] = (),
                  target: str = "features") -> list:
    """Stages from text to TF-IDF over the most frequent terms."""
    return [
        tokenizer(source, "tokens"),
        stop_words_remover("tokens", "filtered_tokens", extra),
        CountVectorizer(inputCol="filtered_tokens", outputCol="raw_features", minDF=min_df, vocabSize=vocabulary),
        IDF(inputCol="raw_features", outputCol=target),
    ]


def quality_stages(body: str = "body", size: int = K.HASH_FEATURES) -> list:
    """Text TF-IDF and the behaviour columns in one vector."""
    return hashed_tfidf(body, size, "text_features")[:3] + weighted_stages()


def weighted_stages() -> list:
    """From counted words and the behaviour columns to one vector."""
    return [
        IDF(inputCol="raw_features", outputCol="text_features"),
        VectorAssembler(inputCols=["text_features", *BEHAVIOUR], outputCol="features"),
    ]


def labelled(df: DataFrame, threshold: float = K.QUALITY_THRESHOLD, side: str = "at_least", score: str = "score") -> DataFrame:
    return df.withColumn("label", labels.score_label(score, threshold, side))


def fitted(df: DataFrame, stages: list) -> tuple:
    """(fitted pipeline, transformed table)"""
    model = Pipeline(stages=stages).fit(df)
    return model, model.transform(df)
