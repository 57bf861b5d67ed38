"""Rule-based discussion types."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import text
from communitylens.operators.terms import with_lemma


def stop_words(extra: Iterable[str] = K.CLOUD_STOP_WORDS) -> list[str]:
    """The English stop words and the extra ones."""
    return sorted(set(K.ENGLISH_STOP_WORDS) | set(extra))


def discussion_type(df: DataFrame, content: str = "content", classes: Mapping[str, Sequence[str]] = K.KEYWORD_CLASSES,
                    unwanted: Sequence[str] | None = None, min_length: int = K.CLOUD_MIN_TOKEN_LENGTH,
                    lemmas: DataFrame | None = None) -> DataFrame:
    """Adds ``tokens`` (cleaned words) and ``topic_type``.

    The type is the first class with a keyword inside the cleaned, lemmatised text. Without
    lemmas that is a row expression. With them the texts' distinct words meet the lemma table in a
    join, and the best class of each text comes back by the hashes of its content.
    """
    unwanted = stop_words() if unwanted is None else unwanted
    body = F.coalesce(F.col(content), F.lit(""))
    typed = df.withColumn("tokens", text.cloud_tokens(body, unwanted, min_length))
    names = list(classes)
    if lemmas is None or not names:
        hits = [(F.array_join("tokens", " ").rlike(text.any_of(classes[name])), name) for name in names]
        return typed.withColumn("topic_type", _first(hits, K.OTHER_CLASS))
    words = typed.select(
        F.xxhash64(body).alias("_hash1"), F.hash(body).alias("_hash2"), F.explode(F.array_distinct("tokens")).alias("term"))
    place = _first([(F.col("lemma").rlike(text.any_of(classes[name])), k) for k, name in enumerate(names)], None)
    best = (
        with_lemma(words, lemmas).withColumn("_place", place).where(F.col("_place").isNotNull())
        .groupBy("_hash1", "_hash2").agg(F.min("_place").alias("_place"))
    )
    joined = typed.withColumns({"_hash1": F.xxhash64(body), "_hash2": F.hash(body)}).join(best, ["_hash1", "_hash2"], "left")
    found = F.get(F.array(*map(F.lit, names)), F.col("_place"))
    return joined.withColumn("topic_type", F.coalesce(found, F.lit(K.OTHER_CLASS))).drop("_hash1", "_hash2", "_place")


def _first(choices: list[tuple[Column, object]], otherwise: object) -> Column:
    result = F.lit(otherwise)
    for hit, value in reversed(choices):
        result = F.when(hit, value).otherwise(result)
    return result
