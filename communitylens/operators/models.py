"""Topic, cluster and classification models on MLlib."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, KMeans, KMeansModel, LDAModel
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions.labels import argmax, class_probability
from communitylens.operators import counting, features, passes, terms, wordcounts
from communitylens.session import cut_lineage, in_parts, literal_table, written
from communitylens.sources.sampling import hash_fraction


# ------------------------------------------------------------------ classifier
def fit_classifier(train: DataFrame, body: str = "body", size: int = K.HASH_FEATURES,
                   iterations: int = K.CLASSIFIER_ITERATIONS) -> PipelineModel:
    """Class-weighted logistic regression over text and behaviour features."""
    model = LogisticRegression(
        featuresCol="features", labelCol="label", maxIter=iterations, weightCol="class_weight"
    )
    return Pipeline(stages=features.quality_stages(body, size) + [model]).fit(train)


def fit_counted(train: DataFrame, iterations: int = K.CLASSIFIER_ITERATIONS) -> PipelineModel:
    """The same from rows whose texts are counted already (``raw_features``)."""
    model = LogisticRegression(
        featuresCol="features", labelCol="label", maxIter=iterations, weightCol="class_weight"
    )
    return Pipeline(stages=[*features.weighted_stages(), model]).fit(train)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., label, prediction, prob) with prob = probability of label 1."""
    scored = model.transform(df)
    return scored.select(*keep, "label", "prediction", class_probability("probability").alias("prob"))


# ---------------------------------------------------------------------- topics
def topic_vectors(df: DataFrame, keep: Sequence[str], text: str = "clean_text", vocabulary: int = K.TOPIC_VOCABULARY,
                  min_df: int = K.TOPIC_MIN_DF, extra: Sequence[str] = K.TOPIC_STOP_WORDS) -> tuple[list[str], DataFrame]:
    """(vocabulary, table of keep... and TF-IDF features).

    Texts are read once: every one's distinct words are stored with their counts, from which come the vocabulary and the
    vectors. Those are stored too, so that weights, model and assignment work from short sparse vectors.
    """
    texts = written(wordcounts.counted(df, text, keep, [*K.ENGLISH_STOP_WORDS, *extra]))
    chosen = [row["term"] for row in wordcounts.leading(texts, min_df, vocabulary).collect()]
    counted = cut_lineage(wordcounts.with_vectors(texts, chosen, "raw_features").select(*keep, "raw_features"))
    weighted = IDF(inputCol="raw_features", outputCol="features").fit(counted).transform(counted)
    return chosen, weighted.select(*keep, "features")


def fit_topics(vectors: DataFrame, k: int = K.TOPIC_COUNT, iterations: int = K.TOPIC_ITERATIONS, seed: int = K.SEED,
               parts: int | None = None) -> LDAModel:
    """Online LDA; each iteration looks at a sample of the vectors, which are kept meanwhile. ``parts``: see ``in_parts``."""
    kept = in_parts(vectors.select("features"), parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return LDA(k=k, maxIter=iterations, optimizer="online", seed=seed, featuresCol="features").fit(kept)
    finally:
        kept.unpersist()


def topic_words(vocabulary: Sequence[str], lda: LDAModel, words: int = K.TOPIC_WORDS) -> DataFrame:
    """(topic, rank, term, weight, relative): leading terms per topic, weight also relative to the topic's largest."""
    described = lda.describeTopics(maxTermsPerTopic=words)
    names = literal_table(described.sparkSession, enumerate(vocabulary), "index int, term string")
    listed = (
        described.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
        .select("topic", (F.col("rank") + 1).alias("rank"), F.col("t.termIndices").alias("index"),
                F.col("t.termWeights").alias("weight"))
        .join(names, "index")
    )
    return counting.relative_to_max(listed, "topic", "weight").select("topic", "rank", "term", "weight", "relative")


def dominant_topic(lda: LDAModel, vectors: DataFrame) -> DataFrame:
    """The columns kept with the vectors, and dominant_topic."""
    keep = [c for c in vectors.columns if c != "features"]
    return lda.transform(vectors).select(*keep, argmax(vector_to_array("topicDistribution")).alias("dominant_topic"))


# -------------------------------------------------------------------- clusters
def cluster_features(df: DataFrame, text: str = "text", size: int = K.CLUSTER_FEATURES,
                     keep: Sequence[str] | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fitted TF-IDF stages and the table with words, filtered_words and features.

    The weights are fitted on stored counts, with which the texts are split and counted once. With ``keep`` only
    these columns are stored with the counts, as compressed Parquet: the table has them and features.
    """
    stages = features.hashed_tfidf(text, size)
    counter = Pipeline(stages=stages[:3]).fit(df)
    counted = counter.transform(df)
    counted = cut_lineage(counted) if keep is None else written(counted.select(*keep, "raw_features"))
    weights = stages[3].fit(counted)
    vectors = weights.transform(counted)
    return PipelineModel([*counter.stages, weights]), vectors if keep is None else vectors.select(*keep, "features")


def fit_clusters(vectors: DataFrame, k: int = K.CLUSTER_K, seed: int = K.SEED) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)


def fit_each(vectors: DataFrame, ks: Iterable[int], seed: int = K.SEED) -> dict[int, KMeansModel]:
    """A K-Means model for every k, fitted one after the other as by ``fit_clusters``; the vectors should be kept meanwhile."""
    return {k: fit_clusters(vectors, k, seed) for k in sorted(set(ks))}


def training_costs(spark: SparkSession, fits: Mapping[int, KMeansModel]) -> DataFrame:
    """(k, wcss): within-cluster sum of squares around the centres of each model."""
    return literal_table(spark, [(k, model.summary.trainingCost) for k, model in fits.items()], "k int, wcss double")


def centre_gaps(model: KMeansModel, vectors: DataFrame) -> DataFrame:
    """Adds gaps: the squared distance to each centre, less the vector's own square, which is the same for all of them.

    The vectors are multiplied with the centres where they are; no row is repeated or sent for a centre.
    """
    centres = np.array(model.clusterCenters())
    squares = F.array(*[F.lit(float(c @ c)) for c in centres])
    along = passes.projected(vectors, centres.T, alias="_along")
    return along.withColumn("gaps", F.zip_with(vector_to_array("_along"), squares, lambda x, square: square - 2 * x)).drop("_along")


def elbow(vectors: DataFrame, ks: Iterable[int] = range(K.ELBOW_MIN_K, K.ELBOW_MAX_K + 1), seed: int = K.SEED) -> DataFrame:
    """(k, wcss): within-cluster sum of squares per k; every scan of the vectors serves all k."""
    kept = vectors.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        curve = passes.cluster_curve(kept, ks, seed=seed)
    finally:
        kept.unpersist()
    return literal_table(vectors.sparkSession, curve.costs.items(), "k int, wcss double")


def plane(vectors: DataFrame, fitting: DataFrame | None = None) -> DataFrame:
    """Adds pca_features: the places along the first two principal axes of ``fitting`` (by default of the same vectors).

    The axes come from scans with a few columns, so the number of features is no matter of memory squared. The
    vectors are kept between the scans, unless the caller keeps them already.
    """
    source = vectors if fitting is None else fitting
    kept = source.select("features")
    if not source.is_cached:
        kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        axes = passes.principal_axes(kept, oversample=14, tolerance=1e-6).axes
    finally:
        if not source.is_cached:
            kept.unpersist()
    return passes.projected(vectors, axes)


def cluster_points(assigned: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, pc1, pc2, cluster) of all documents, or of ``limit`` documents chosen by hash of the key."""
    xy = vector_to_array("pca_features")
    chosen = assigned if limit is None else assigned.orderBy(hash_fraction(key), key).limit(limit)
    return (
        chosen.select(key, F.get(xy, F.lit(0)).alias("pc1"), F.get(xy, F.lit(1)).alias("pc2"), "cluster")
    )


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_profile(assigned: DataFrame, k: int = K.CLUSTER_TERMS, words: str = "filtered_words",
                    sizes: DataFrame | None = None) -> DataFrame:
    """(cluster, size, top_terms): the most frequent words of all documents of each cluster.

    ``sizes`` is for when the sizes are known more cheaply than from ``assigned``.
    """
    best = terms.leading_terms(assigned, words, "cluster", k)
    listed = best.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("top_terms")
    )
    return (cluster_sizes(assigned) if sizes is None else sizes).join(listed, "cluster", "left")
