from __future__ import annotations

from datetime import date

import pytest
from pyspark.ml.feature import StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import labels, text, timeparts
from communitylens.operators import filters
from helpers import at


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = at("2023-06-30", "23:30:00")
        assert one(spark, timeparts.utc_date("t"), t=t) == date(2023, 6, 30)
        assert one(spark, timeparts.utc_month("t"), t=t) == date(2023, 6, 1)
        assert one(spark, timeparts.utc_hour("t"), t=t) == 23
        assert one(spark, timeparts.utc_weekday("t"), t=at("2023-07-02")) == 1  # a Sunday
        assert one(spark, timeparts.utc_date("t"), t=-1) == date(1969, 12, 31)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_month_texts(spark):
    d = date(2023, 6, 5)
    assert one(spark, timeparts.year_month_unpadded("d"), d=d) == "2023-6"
    assert one(spark, timeparts.year_month_padded("d"), d=d) == "2023-06"


@pytest.mark.parametrize("mode,kept", [("instant", {"c10"}), ("day", {"c10", "c11"})])
def test_period_end(comments, mode, kept):
    inside = filters.in_period(comments, end_inclusive=mode)
    assert {r["id"] for r in inside.collect()} & {"c10", "c11"} == kept
    assert "c1" in {r["id"] for r in inside.collect()}


def test_period_rejects_unknown_mode(comments):
    with pytest.raises(ValueError):
        filters.in_period(comments, end_inclusive="week")


def test_community_names_are_case_sensitive_unless_asked(comments):
    assert {r["subreddit"] for r in filters.in_communities(comments, ["A"]).collect()} == {"A"}
    assert {r["subreddit"] for r in filters.in_communities(comments, ["A"], ignore_case=True).collect()} == {"A", "a"}


def test_live_text(comments, posts):
    assert {r["id"] for r in filters.live_comments(comments).collect()} == {
        "c1", "c4", "c7", "c8", "c9", "c10", "c11", "c12", "c13"}
    assert {r["id"] for r in filters.live_posts(posts).collect()} == {"p1", "p2", "p4"}


def test_select_available_keeps_order_and_drops_missing(comments):
    assert filters.select_available(comments, ["score", "permalink", "id"]).columns == ["score", "id"]


def test_with_words_equals_cleaned_text(spark):
    samples = ["", "   ", "123 !!", "http://only.url", "www.only.url", "a", "É", "é b", "HTTP://upper.url", None, "x http://y"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    kept = {r["i"] for r in filters.with_words(df, "t").collect()}
    cleaned = {r["i"] for r in df.where(text.topic_text("t") != "").collect()}
    assert kept == cleaned


@pytest.mark.parametrize("given,topic,cluster,tone", [
    ("It's  GREAT! see http://a.b/c?d or www.x.y", "it s great see or", "Its  GREAT see httpabcd or wwwxy", "It's GREAT! see or "),
    ("*bold* _it_ ~s~ `c` # h", "bold it s c h", "bold it s c  h", " bold it s c h"),
    ("http without space", "http without space", "http without space", "http without space"),
    ("www and 42", "www and", "www and ", "www and 42"),
])
def test_cleaners(spark, given, topic, cluster, tone):
    assert one(spark, text.topic_text("t"), t=given) == topic
    assert one(spark, text.cluster_text("t"), t=given) == cluster
    assert one(spark, text.sentiment_text("t"), t=given) == tone


def test_title_and_text(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("a", "b"), (None, None)], "t string, s string")
    assert [r[0] for r in df.select(text.title_and_text("t", "s")).collect()] == ["a", "b", "a b", ""]
    assert [r[0] for r in df.select(text.title_and_text_padded("t", "s")).collect()] == ["a ", " b", "a b", " "]


def test_tokens_match_mllib(spark):
    samples = [" Two  spaces ", "tab\tand\nnewline", "", "   ", "one", "trailing   ", "  leading"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for row in Tokenizer(inputCol="t", outputCol="w").transform(df).withColumn("x", text.tokens("t", False)).collect():
        assert row["x"] == row["w"], row["t"]
    assert one(spark, text.tokens("t"), t=" Two  spaces ") == ["two", "spaces"]


def test_english_stop_words_are_sparks(spark):
    assert list(K.ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_cloud_tokens(spark):
    got = one(spark, text.cloud_tokens("t", ["the"]), t="The CAT's http://x y-axis of the ox, www, dot; moves")
    assert got == ["cat", "axis", "dot", "moves"]


@pytest.mark.parametrize("word,stem", [("training", "train"), ("worked", "work"), ("boxes", "box"), ("cats", "cat"),
                                       ("gas", "gas"), ("is", "is"), ("ing", ""), ("model", "model")])
def test_suffix_stem(spark, word, stem):
    assert one(spark, text.suffix_stem("w"), w=word) == stem


@pytest.mark.parametrize("given,expected", [
    ("a neural bias", "technical"), ("bias and society", "ethical"), ("the future", "societal"), ("hi", "other"), ("remodelling", "technical")])
def test_keyword_class_takes_the_first(spark, given, expected):
    assert one(spark, text.keyword_class("t", K.KEYWORD_CLASSES), t=given) == expected


@pytest.mark.parametrize("score,name,sign", [(0.05, "positive", 1.0), (0.049, "neutral", 0.0), (-0.05, "negative", -1.0), (0.0, "neutral", 0.0)])
def test_sentiment_limits(spark, score, name, sign):
    assert one(spark, labels.sentiment_class("s"), s=score) == name
    assert one(spark, labels.sentiment_sign("s"), s=score) == sign


def test_score_labels(spark):
    df = spark.createDataFrame([(20,), (19,), (-1,), (0,), (None,)], "s int")
    assert [r[0] for r in df.select(labels.score_label("s")).collect()] == [1, 0, 0, 0, 0]
    assert [r[0] for r in df.select(labels.score_label("s", 0, "below")).collect()] == [0, 0, 1, 0, 0]


def test_small_sets(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [tuple(r) for r in df.select(
        labels.shared_size("a", "b"), labels.joint_size("a", "b"),
        labels.jaccard(labels.shared_size("a", "b"), labels.joint_size("a", "b"))).collect()] == [(2, 4, 0.5), (0, 0, 0.0)]


def test_argmax_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],), ([],)], "w array<double>")
    assert [r[0] for r in df.select(labels.argmax("w")).collect()] == [1, -1]


def test_coerced(spark):
    df = spark.createDataFrame([("2023-06-01", "5", 1), ("soon", "many", 2)], "m string, n string, s int")
    got = filters.coerced(df, dates=["m"], numbers=["n"], texts=["s"]).collect()
    assert [tuple(r) for r in got] == [(date(2023, 6, 1), 5.0, "1"), (None, 0.0, "2")]


