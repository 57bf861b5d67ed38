"""Groups of posts by language."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text
from communitylens.operators import features, filters, models
from communitylens.operators.sentiment import Rules, score_sentiment
from communitylens.session import cut_lineage, in_parts
from communitylens.sources import sinks
from communitylens.sources.sampling import sample_n


def documents(submissions: DataFrame, key: str = "id", sample_size: int = 0) -> DataFrame:
    """Posts with ``raw_text`` and the letters-only ``text``; blank ones are left out before cleaning."""
    rows = sample_n(submissions, key, sample_size).withColumn("raw_text", text.title_and_text("title", "selftext"))
    return filters.non_blank(rows, "raw_text").withColumn("text", text.cluster_text("raw_text"))


def cluster_sentiment(assigned: DataFrame, source: str, key: str, lexicon: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """cluster, avg_sentiment, n"""
    scored = score_sentiment(assigned, source, ["cluster", key], lexicon, copies="copies", rules=rules)
    return scored.groupBy("cluster").agg(
        (F.sum(F.col("sentiment_score") * F.col("copies")) / F.sum("copies")).alias("avg_sentiment"),
        F.sum("copies").alias("n"),
    )


def elbow(docs: DataFrame, low: int = K.ELBOW_MIN_K, high: int = K.ELBOW_MAX_K, size: int = K.CLUSTER_FEATURES) -> DataFrame:
    """k, wcss"""
    _, vectors = models.cluster_features(docs, size=size)
    return models.elbow(vectors, range(low, high + 1))


def run(docs: DataFrame, key: str = "id", k: int = K.CLUSTER_K, size: int = K.CLUSTER_FEATURES,
        lexicon: DataFrame | None = None, rules: Rules = Rules(), points: bool = True, parts: int | None = None,
        ks: Iterable[int] | None = None, folder: str | None = None) -> tuple:
    """(model, {assignments, profile, points, sentiment, elbow}).

    Texts are cleaned once: text, words and counts are stored, and fits and tables work on
    those. ``points`` fits the plane too, which the other tables do not need. ``parts``: see ``in_parts``.
    ``elbow`` is there when ``ks`` is given: (k, wcss) of a K-Means model for every k, fitted as the one of ``k``.
    The model is saved in ``folder``, when one is given.
    """
    stages = features.hashed_tfidf("text", size)
    words = Pipeline(stages=stages[:3]).fit(docs).transform(docs)
    stored = cut_lineage(words.select(key, "raw_text", "filtered_words", "raw_features"))
    vectors = stages[3].fit(stored).transform(stored)
    fitting = in_parts(vectors.select("features"), parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = models.fit_each(fitting, [k, *(ks or ())])
        model = fits[k]
        assigned = model.transform(vectors)
        if points:
            placed = models.plane(assigned, fitting)
    finally:
        fitting.unpersist()
    if folder:
        sinks.save_model(model, folder)
    made = {
        "assignments": assigned.select(key, "cluster"),
        "profile": models.cluster_profile(assigned),
        "sentiment": cluster_sentiment(assigned, "raw_text", key, lexicon, rules),
    }
    if points:
        made["points"] = models.cluster_points(placed, key)
    if ks:
        made["elbow"] = models.training_costs(docs.sparkSession, {n: fits[n] for n in sorted(set(ks))})
    return model, made
