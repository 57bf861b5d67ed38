from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__
from communitylens import constants as K
from communitylens.operators import evaluation, features, models
from communitylens.plans import clusters, quality, topics
from communitylens.sources import sinks
from communitylens.sources.sampling import hash_fraction, sample_adaptive, sample_n, split_by_hash, split_random
from helpers import at


def _scored(spark, n=400, levels=37):
    rng = random.Random(6)
    rows = [(i, int(rng.random() < 0.3), rng.randint(0, levels) / levels) for i in range(n)]
    rows += [(n + i, 1, 0.5) for i in range(n)]  # one score holds half of all rows
    return rows, spark.createDataFrame(
        [(i, y, s, float(s >= 0.5)) for i, y, s in rows], "id int, label int, prob double, prediction double"
    ).repartition(5)


def test_auc_equals_pairs_and_mllib(spark):
    rows, df = _scored(spark)
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    by_pairs = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = evaluation.auc(df).first()["auc"]
    assert got == pytest.approx(by_pairs, abs=1e-12)
    mllib = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0).evaluate(df)
    assert got == pytest.approx(mllib, abs=1e-9)


def test_auc_of_close_scores(spark):
    rows = [(i, i % 2, 0.5 + i * 1e-9) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label int, prob double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    assert evaluation.auc(df).first()["auc"] == pytest.approx(sum(p > n for p in pos for n in neg) / 900)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5)], "label int, prob double")
    assert evaluation.auc(df).first()["auc"] is None


def test_curves(spark):
    rows, df = _scored(spark)
    pos, neg = sum(y for _, y, _ in rows), sum(1 - y for _, y, _ in rows)
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in evaluation.roc_curve(df).collect()}
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluation.pr_curve(df).collect()}
    points = [(1.0, 0.0)]
    for t in sorted({s for _, _, s in rows}, reverse=True):
        tp = sum(y for _, y, s in rows if s >= t)
        fp = sum(1 - y for _, y, s in rows if s >= t)
        assert roc[t] == pytest.approx((fp / neg, tp / pos))
        assert pr[t] == pytest.approx((tp / (tp + fp), tp / pos))
        points.append((tp / (tp + fp), tp / pos))
    area = sum((r1 - r0) * (p0 + p1) / 2 for (p0, r0), (p1, r1) in zip(points, points[1:]))
    assert evaluation.average_precision_area(df).first()["aupr"] == pytest.approx(area)


def test_rounded_curve_is_shorter(spark):
    _, df = _scored(spark)
    assert evaluation.roc_curve(df, digits=1).count() == 11


def test_confusion_and_scores(spark):
    df = spark.createDataFrame([(0, 0.0)] * 5 + [(0, 1.0)] * 2 + [(1, 0.0)] * 1 + [(1, 1.0)] * 4, "label int, prediction double")
    assert tuple(evaluation.confusion(df).first()) == (5, 2, 1, 4)
    assert [tuple(r) for r in evaluation.confusion_matrix(df).collect()] == [("true_0", 5, 2), ("true_1", 1, 4)]
    assert tuple(evaluation.classification(evaluation.confusion(df)).first()) == pytest.approx((9 / 12, 4 / 6, 4 / 5, 8 / 11))
    none = evaluation.classification(evaluation.confusion(df.where("label = 0 and prediction = 0"))).first()
    assert tuple(none) == (1.0, 0.0, 0.0, 0.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert features.class_weights(df) == {0: 8 / 12, 1: 2.0}
    assert features.class_weights(df.where("label = 0")) == {0: 0.5, 1: 3.0}
    assert {r["label"]: r["class_weight"] for r in features.class_weight_table(df).collect()} == {0: 8 / 12, 1: 2.0}
    assert {(r["label"], r["class_weight"]) for r in features.with_class_weight(df).collect()} == {(0, 8 / 12), (1, 2.0)}


# ---------------------------------------------------------------------- sampling
def test_splits_cover_everything_once(spark):
    df = spark.range(5000).withColumn("id", F.col("id").cast("string"))
    parts = split_by_hash(df, "id")
    again = split_by_hash(df.repartition(9), "id")
    assert sum(p.count() for p in parts) == 5000 == parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().count()
    for p, q, share in zip(parts, again, (0.6, 0.2, 0.2)):
        assert p.count() == pytest.approx(5000 * share, rel=0.1)
        assert {r["id"] for r in p.collect()} == {r["id"] for r in q.collect()}
    assert sum(p.count() for p in split_random(df)) == 5000


@pytest.mark.parametrize("n", [0, 1, 777, 3000, 9999])
def test_sample_n_is_exact(spark, n):
    df = spark.range(3000)
    got = {r["id"] for r in sample_n(df.repartition(5), "id", n).collect()}
    assert len(got) == (n if 0 < n < 3000 else 3000)
    ranked = [r["id"] for r in df.orderBy(hash_fraction("id"), "id").collect()]
    assert got == set(ranked[:n] if n else ranked)


def test_sample_adaptive_takes_what_the_caller_asks_for(spark):
    df = spark.range(20_000)
    assert sample_adaptive(df, "id").count() == 20_000
    assert sample_adaptive(df, "id", 0.05).count() == pytest.approx(1000, rel=0.15)
    assert sample_adaptive(df, fraction=0.01).count() == pytest.approx(200, rel=0.4)


def test_saturated_scores_and_margins_are_spread(spark):
    n = 20_000
    saturated = spark.range(n).select((F.col("id") % 2).cast("int").alias("label"), (F.lit(1.0) / (1 + F.exp(14 + F.col("id") / n))).alias("prob"))
    margins = spark.range(n).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 37.5 - 4e5).alias("prob"))
    for df in (saturated, margins):
        bins = evaluation.histogram(df).groupBy("_bin").count().agg(F.max("count"), F.count("*")).first()
        assert bins[0] <= n // 50 and bins[1] <= 256
        mllib = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0).evaluate(df)
        assert evaluation.auc(df).first()["auc"] == pytest.approx(mllib, abs=1e-9)


# ------------------------------------------------------------------------ models
@pytest.fixture(scope="module")
def forum(spark):
    rng = random.Random(7)
    themes = (["neural", "model", "training", "data"], ["galaxy", "star", "planet", "orbit"], ["python", "code", "bug", "test"])
    rows = []
    for i in range(240):
        theme = i % 3
        body = " ".join(rng.choices(themes[theme], k=12))
        rows.append((f"d{i}", "ABC"[theme], f"u{i % 20}", body, themes[theme][0], body, 30 if theme == 0 else 3, at("2023-06-02") + i * 9000))
    df = spark.createDataFrame(rows, "id string, subreddit string, author string, body string, title string, selftext string, score bigint, created_utc bigint")
    return df.withColumn("date", F.to_date(F.timestamp_seconds("created_utc")))


def test_quality_classifier(spark, forum, tmp_path):
    model, predictions, made = quality.run(forum, size=256)
    row = made["model_metrics_summary"].first()
    assert row["model"] == "LogisticRegression" and row["auc"] > 0.95 and row["f1"] > 0.9
    assert made["confusion_matrix"].select(F.sum(F.col("pred_0") + F.col("pred_1"))).first()[0] == predictions.count()
    sinks.save_model(model, str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    test = split_by_hash(quality.prepared(forum), "id")[2]
    assert {tuple(r) for r in models.predict(loaded, test, ["id"]).collect()} == {tuple(r) for r in predictions.collect()}


def test_quality_label_is_set_before_texts_are_checked(comments):
    got = {r["id"]: r["label"] for r in quality.prepared(comments).collect()}
    assert "c6" not in got and got["c7"] == 1 and got["c4"] == 0
    flags = {r["id"]: r["has_url"] for r in quality.prepared(comments).collect()}
    assert flags["c4"] == 1 and flags["c7"] == 0


def test_topics_find_the_themes(spark, forum):
    docs = topics.documents(forum.limit(0), forum)
    made = topics.run(docs, k=3, min_df=2, iterations=15, words=4)
    words = made["topics"].collect()
    assert len(words) == 12 and all(0 < r["relative"] <= 1 for r in words)
    assert sum(r["count"] for r in made["topic_trends"].collect()) == 240
    assert sum(r["share"] for r in made["topic_shares"].collect()) == pytest.approx(1)
    largest = made["topic_by_subreddit"].groupBy("subreddit").agg(F.max("count").alias("n")).collect()
    assert all(r["n"] > 40 for r in largest)
    grid = topics.community_grid(made["topic_by_subreddit"], topics=3).collect()
    assert sum(r["0"] + r["1"] + r["2"] for r in grid) == 240
    assert topics.month_grid(made["topic_trends"], topics=3).count() == made["topic_trends"].select("year_month").distinct().count()


def test_clusters(spark, forum):
    docs = clusters.documents(forum)
    model, made = clusters.run(docs, k=3, size=128)
    profile = made["profile"].collect()
    assert sum(r["size"] for r in profile) == 240 and all(1 <= len(r["top_terms"]) <= K.CLUSTER_TERMS for r in profile)
    assert made["points"].count() == 240 and made["points"].columns == ["id", "pc1", "pc2", "cluster"]
    assert sum(r["n"] for r in made["sentiment"].collect()) == 240
    curve = {r["k"]: r["wcss"] for r in clusters.elbow(docs, 2, 4, 128).collect()}
    assert set(curve) == {2, 3, 4} and curve[3] < curve[2]


def test_clusters_come_with_their_elbow_and_saved_model(spark, forum, tmp_path):
    docs = clusters.documents(forum)
    model, made = clusters.run(docs, k=3, size=128, ks=(2, 3, 5), folder=str(tmp_path / "model"))
    curve = {r["k"]: r["wcss"] for r in made["elbow"].collect()}
    assert set(curve) == {2, 3, 5} and curve[3] == model.summary.trainingCost and curve[5] < curve[2]
    loaded = KMeansModel.load(str(tmp_path / "model"))
    assert np.array_equal(loaded.clusterCenters(), model.clusterCenters()) and loaded.getK() == 3
    _, vectors = models.cluster_features(docs, size=128)
    for k in (2, 5):
        assert curve[k] == pytest.approx(models.fit_clusters(vectors, k).summary.trainingCost)
    axes = PCA(k=2, inputCol="features", outputCol="p").fit(vectors).pc.toArray()
    place = {r["id"]: np.abs(r["features"].toArray() @ axes) for r in vectors.collect()}
    assert all(np.allclose(np.abs([r["pc1"], r["pc2"]]), place[r["id"]], atol=1e-4) for r in made["points"].collect())
    assert "elbow" not in clusters.run(docs, k=2, size=64, points=False)[1]


def test_the_clusters_job_has_every_output(spark):
    rows = __spark_entry__.queries()["job_text_clusters"](spark, "/root/testdata/sf0.001").collect()
    assert {r["report"]: r["n"] for r in rows}["elbow"] == K.ELBOW_MAX_K - K.ELBOW_MIN_K + 1 and "model" in {r["report"] for r in rows}
    assert len(rows) == 6 and all(r["in_range"] for r in rows)


def test_blank_posts_are_not_clustered(posts):
    assert {r["id"] for r in clusters.documents(posts).collect()} == {"p1", "p2", "p3", "p4", "p5"}
    assert {r["id"] for r in clusters.documents(posts.withColumn("selftext", F.lit(None).cast("string"))).collect()} == {"p1", "p2", "p4"}


def test_feature_vector_ends_with_behaviour(spark, forum):
    df = features.behaviour_features(forum)
    got = features.fitted(df, features.quality_stages("body", 64))[1].select(vector_to_array("features").alias("v"), *features.BEHAVIOUR).first()
    assert len(got["v"]) == 68 and got["v"][64:] == [got[c] for c in features.BEHAVIOUR]
