"""Can a comment's score be told from its text and timing?"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.operators import evaluation, features, models
from communitylens.session import cut_lineage, in_parts, parts_for
from communitylens.sources.sampling import part_by_hash


def prepared(comments: DataFrame, threshold: float = K.QUALITY_THRESHOLD, side: str = "at_least") -> DataFrame:
    """Comments with label and behaviour features; the label is set before texts are checked."""
    return features.behaviour_features(features.labelled(comments, threshold, side))


def evaluate(predictions: DataFrame, model: str = "LogisticRegression") -> dict[str, DataFrame]:
    """model_metrics_summary, confusion_matrix, roc, pr and aupr of (label, prediction, prob) rows."""
    measures = ["accuracy", "precision", "recall", "f1", "auc"]
    counts = evaluation.histogram(predictions)
    rows = evaluation.classification(evaluation.confusion(predictions)).unionByName(
        evaluation.auc(counts), allowMissingColumns=True
    )
    return {
        "model_metrics_summary": rows.agg(*[F.max(m).alias(m) for m in measures]).select(
            F.lit(model).alias("model"), *measures
        ),
        "confusion_matrix": evaluation.confusion_matrix(predictions),
        "roc": evaluation.roc_curve(counts),
        "pr": evaluation.pr_curve(counts),
        "aupr": evaluation.average_precision_area(counts),
    }


def counted(comments: DataFrame, key: str = "id", size: int = K.HASH_FEATURES, keep: tuple[str, ...] = ("score",)) -> tuple:
    """(text stages, stored key, part, kept columns, counted words and behaviour features).

    Texts are read here and nowhere else: any number of labels can be set on the result and fitted.
    """
    stages = features.hashed_tfidf("body", size)[:3]
    rows = features.behaviour_features(comments).withColumn("part", part_by_hash(key))
    counter = Pipeline(stages=stages).fit(rows)
    return counter, cut_lineage(counter.transform(rows).select(key, "part", *keep, "raw_features", *features.BEHAVIOUR))


def fit_and_evaluate(counter: PipelineModel, kept: DataFrame, key: str = "id", iterations: int = K.CLASSIFIER_ITERATIONS,
                     parts: int | None = None) -> tuple:
    """(model, predictions on the test part, evaluation tables) from counted rows with a label.

    The model is trained on 60 % of the rows, chosen by hash of ``key``; its weights are fitted on the stored counts.
    """
    train = features.with_class_weight(in_parts(kept.where("part = 0"), parts))
    fitted = models.fit_counted(train, iterations)
    predictions = cut_lineage(models.predict(fitted, kept.where("part = 2"), [key]))
    return PipelineModel([*counter.stages, *fitted.stages]), predictions, evaluate(predictions)


def run(comments: DataFrame, key: str = "id", threshold: float = K.QUALITY_THRESHOLD, side: str = "at_least",
        size: int = K.HASH_FEATURES, iterations: int = K.CLASSIFIER_ITERATIONS) -> tuple:
    """(model, predictions on the test part, evaluation tables) for one label; see ``run_labels`` for several."""
    return run_labels(comments, {"": (threshold, side)}, key, size, iterations)[""]


def run_labels(comments: DataFrame, labels: dict[str, tuple[float, str]], key: str = "id", size: int = K.HASH_FEATURES,
               iterations: int = K.CLASSIFIER_ITERATIONS, part_rows: int | None = None) -> dict[str, tuple]:
    """For each named (threshold, side) what ``run`` gives; texts are counted once for all of them.

    ``part_rows``: fits read parts of about so many counted rows, as many parts as that makes; see ``in_parts``.
    """
    counter, kept = counted(comments, key, size)
    parts = None if part_rows is None else parts_for(kept, part_rows)
    return {
        name: fit_and_evaluate(counter, features.labelled(kept, threshold, side), key, iterations, parts)
        for name, (threshold, side) in labels.items()
    }
