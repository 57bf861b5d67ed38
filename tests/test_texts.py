from __future__ import annotations

import math
import random
import string
from collections import Counter
from datetime import date

import pytest
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.operators import discussion, events, network, sentiment, terms
from communitylens.operators.sentiment import Rules, score_sentiment
from communitylens.plans import discussion as discussion_plan
from communitylens.plans import network as network_plan
from communitylens.plans import sentiment as sentiment_plan
from communitylens.session import literal_table
from helpers import at, in_order, table

LEXICON = (("good", 1.9), ("bad", -2.5), ("great", 3.1), (":)", 2.0), ("no", -1.2), ("kind", 2.4), ("stop", -1.2), ("right", 0.5))
RULES = Rules(negators=("not", "never"), boosters=("very", "so"), dampeners=("slightly",), contrast="but")


# --------------------------------------------------------------------- sentiment
def word_by_rules(i, words, low, valence, shouted, capitals, loud, rules) -> float:
    """One word's valence, rule after rule."""
    modifiers = {w: 0.293 for w in rules.boosters} | {w: -0.293 for w in rules.dampeners} | {p: -0.293 for p in rules.phrases}
    before = lambda n: low[i - n] if i >= n else ""
    if low[i] in rules.boosters + rules.dampeners or (low[i] == "kind" and low[i + 1:i + 2] == ["of"]):
        return 0.0
    v = valence[low[i]]
    if low[i] == "no" and i + 1 < len(low) and low[i + 1] in valence:
        v = 0.0
    if "no" in (before(1), before(2)) or (before(3) == "no" and before(1) in ("or", "nor")):
        v = valence[low[i]] * -0.74
    if shouted:
        v += 0.733 if v > 0 else -0.733
    for n, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
        if i < n or before(n) in valence:
            continue
        if before(n) in rules.boosters + rules.dampeners:
            step = modifiers[before(n)] * (-1 if v < 0 else 1)
            if capitals and loud(words[i - n]):
                step += 0.733 if v > 0 else -0.733
            v += step * damping
        negates = before(n) in rules.negators or "n't" in before(n)
        if n == 1:
            v *= -0.74 if negates else 1
        else:
            never = before(n) == "never" and before(n - 1) in ("so", "this")
            doubt = before(n) == "without" and before(n - 1) == "doubt"
            if n == 3:
                never, doubt = never or before(1) in ("so", "this"), doubt or before(1) == "doubt"
            v *= 1.25 if never else 1 if doubt else -0.74 if negates else 1
        if n == 3:
            idioms, join = dict(rules.idioms), " ".join
            sequences = [join(low[i - 1:i + 1]), join(low[i - 2:i + 1]), join(low[i - 2:i]), join(low[i - 3:i]), join(low[i - 3:i - 1])]
            v = next((idioms[s] for s in sequences if s in idioms), v)
            for s in (join(low[i:i + 2]), join(low[i:i + 3])):
                v = idioms.get(s, v)
            v += sum(modifiers[s] for s in (sequences[3], sequences[4], sequences[2]) if s in rules.phrases)
    if before(1) == "least" and "least" not in valence and (i == 1 or before(2) not in ("at", "very")):
        v *= -0.74
    return v


def score_by_hand(body: str | None, rules: Rules = RULES, lexicon=LEXICON) -> float:
    """The published rules, one word at a time."""
    body = body or ""
    valence = dict(lexicon)

    def bare(w):
        inner = w.strip(string.punctuation)
        return w if len(inner) <= 2 else inner

    def loud(w):
        return w == w.upper() and w != w.lower()

    raw = body.split()
    words = [bare(w) for w in raw]
    capitals = any(map(loud, raw)) and not all(map(loud, raw))
    low = [w.lower() for w in words]
    turn = low.index(rules.contrast) if rules.contrast in low else None
    total = 0.0
    for i, w in enumerate(words):
        if low[i] not in valence:
            continue
        value = word_by_rules(i, words, low, valence, capitals and loud(w), capitals, loud, rules)
        if turn is not None and i != turn:
            value *= 0.5 if i < turn else 1.5
        total += value
    asks = body.count("?")
    emphasis = min(body.count("!"), 4) * 0.292 + (0 if asks <= 1 else asks * 0.18 if asks <= 3 else 0.96)
    total += emphasis * ((total > 0) - (total < 0))
    return total / math.sqrt(total * total + 15)


@pytest.mark.parametrize("body, expected", [("very not good", -0.399), ("good no problem", 0.629), ("the least good", -0.341)])
def test_order_of_rules(spark, body, expected):
    """Modifier and negation alternate; "no" turns the next word; "least" turns what follows."""
    df = spark.createDataFrame([(1, body)], "i int, t string")
    got = score_sentiment(df, "t", ["i"]).first()["sentiment_score"]
    assert got == pytest.approx(score_by_hand(body, Rules(), sentiment.LEXICON)) and got == pytest.approx(expected, abs=0.01)


def random_texts(n: int) -> list[str]:
    rng = random.Random(4)
    vocabulary = ["good", "Good", "BAD", "great!", "(great)", "no", "not", "NEVER", "very", "VERY", "so", "slightly", "but",
                  "but,", ":)", "the", "cat", "A", "x??", "???", "!!", "\n", "\t", "", "ÉTÉ", "least", "at", "this", "without", "doubt", "or",
                  "kind", "of", "sort", "isn't", "bus", "stop", "yeah", "right", "No"]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 6])
def test_sentiment_equals_the_rules_word_by_word(spark, partitions):
    texts = random_texts(400) + ["", None, "   ", "no lexicon words here", "GOOD DAY", "good " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(partitions)
    lexicon = literal_table(spark, LEXICON, "term string, valence double")
    got = {r["i"]: r["sentiment_score"] for r in score_sentiment(df, "t", ["i"], lexicon, rules=RULES).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(score_by_hand(t), abs=1e-9), repr(t)


def test_equal_rows_keep_their_number(spark):
    df = spark.createDataFrame([("a", "good")] * 500 + [("a", "bad")] * 3 + [("b", "good"), ("b", None), ("b", None)], "k string, t string")
    got = score_sentiment(df, "t", ["k"], literal_table(spark, LEXICON, "term string, valence double"), copies="n")
    one = 1.9 / math.sqrt(1.9 ** 2 + 15)
    rows = sorted((r["k"], r["n"], round(r["sentiment_score"], 6)) for r in got.collect())
    assert rows == sorted([("a", 500, round(one, 6)), ("a", 3, round(-2.5 / math.sqrt(2.5 ** 2 + 15), 6)), ("b", 1, round(one, 6)), ("b", 2, 0.0)])


def test_repeated_lexicon_terms_do_not_multiply_words(spark):
    lexicon = literal_table(spark, [("good", 1.9), ("good", 1.0)], "term string, valence double")
    df = spark.createDataFrame([(1, "good")], "i int, t string")
    assert score_sentiment(df, "t", ["i"], lexicon).first()["sentiment_score"] == pytest.approx(1.9 / math.sqrt(1.9 ** 2 + 15))


def _dated(spark):
    texts = random_texts(120)
    rows = [(f"c{i}", "AB"[i % 2], t, 1, at(f"2023-{6 + i % 6:02d}-10"), date(2023, 6 + i % 6, 10)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, subreddit string, body string, score bigint, created_utc bigint, date date")


def test_sentiment_tables_add_up(spark):
    comments = _dated(spark)
    posts = comments.select("id", "subreddit", F.lit("t").alias("title"), F.col("body").alias("selftext"), "score", "created_utc", "date")
    docs = sentiment_plan.documents(comments, posts)
    cells = sentiment_plan.cube(docs, literal_table(spark, LEXICON, "term string, valence double"), RULES)
    made = {name: df.collect() for name, df in sentiment_plan.tables(cells).items()}
    n = docs.count()
    assert sum(r["count"] for r in made["sentiment_distribution_overall"]) == n
    assert sum(r["total_posts"] for r in made["sentiment_by_subreddit"]) == n
    assert sum(r["total_posts"] for r in made["sentiment_trends"]) == n
    assert sum(r["post_count"] for r in made["sentiment_subreddit_time"]) == n
    assert sum(r["count"] for r in made["sentiment_distribution"]) == n
    for community in made["sentiment_by_subreddit"]:
        months = [r for r in made["sentiment_subreddit_time"] if r["subreddit"] == community["subreddit"]]
        mean = sum(r["avg_sentiment"] * r["post_count"] for r in months) / community["total_posts"]
        assert mean == pytest.approx(community["avg_sentiment"])
    order = [r["year_month"] for r in made["sentiment_trends"]]
    assert order == sorted(order) and order[0] == "2023-10"
    percent = sentiment_plan.category_percent(cells).groupBy("subreddit").agg(F.sum("percent").alias("p")).collect()
    assert all(r["p"] == pytest.approx(100) for r in percent)


def test_sentiment_run_writes_the_tables(spark, tmp_path):
    comments = _dated(spark)
    posts = comments.select("id", "subreddit", F.lit("t").alias("title"), F.col("body").alias("selftext"), "score", "created_utc", "date")
    sentiment_plan.run(comments, posts, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [
        "sentiment_by_subreddit.csv", "sentiment_distribution.csv", "sentiment_distribution_overall.csv",
        "sentiment_subreddit_time.csv", "sentiment_trends.csv"]


def test_a_community_may_be_in_several_categories(spark):
    df = spark.createDataFrame([("A",), ("B",), ("Z",)], "subreddit string")
    got = sentiment_plan.categorised(df, {"x": ("A", "B"), "y": ("B",)})
    assert table(got, "subreddit", "category") == [("A", "x"), ("B", "x"), ("B", "y")]


# ------------------------------------------------------------------------ events
def test_events_in_span(spark):
    months = spark.createDataFrame([(date(2023, 7, 1),), (date(2024, 4, 1),)], "month date")
    clipped = events.events_in_span(months, "month")
    assert [r["label"] for r in clipped.orderBy("event_date").collect()] == ["Claude 2 Launch", "OpenAI Developer Day", "Gemini Launch"]
    assert events.events_in_span(months, "month", clip=False).count() == len(K.EVENTS)


def test_before_after(spark):
    rows = [(date(2023, 7, 9), 1.0), (date(2023, 7, 10), 3.0), (date(2023, 7, 11), None), (date(2023, 7, 12), 5.0),
            (date(2023, 7, 14), 7.0), (date(2023, 7, 15), 100.0)]
    df = spark.createDataFrame(rows, "date date, v double")
    got = events.before_after(df, "date", "v", 3, {"2023-07-12": "e"}).collect()
    assert [tuple(r) for r in got] == [(date(2023, 7, 12), "e", 2.0, 6.0, 4.0, 3, 2)]
    only_after = events.before_after(df.where("date > '2023-07-13'"), "date", "v", 3, {"2023-07-12": "e"}).first()
    assert only_after["avg_before"] is None and only_after["n_before"] == 0


# ------------------------------------------------------------------------- terms
DOCS = [(1, ["a", "b", "a", ""]), (2, ["a", "c"]), (3, []), (4, ["", "", "b"])]


def test_word_count_and_vocabulary(spark):
    df = spark.createDataFrame(DOCS, "i int, w array<string>")
    assert table(terms.word_count(df, "w"), "term", "count") == in_order([("a", 3), ("b", 2), ("c", 1), ("", 3)])
    got = {r["term"]: (r["count"], r["documents"]) for r in terms.vocabulary(df, "w").collect()}
    assert {t: got[t] for t in "abc"} == {"a": (3, 2), "b": (2, 2), "c": (1, 1)}
    assert [r["term"] for r in terms.vocabulary(df, "w", min_df=2, size=2).collect()] == ["", "a"]


def test_vocabulary_equals_count_vectorizer(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 9))]) for i in range(80)], "i int, w array<string>")
    fitted = CountVectorizer(inputCol="w", outputCol="f", minDF=25).fit(df)
    assert set(fitted.vocabulary) == {r["term"] for r in terms.vocabulary(df, "w", min_df=25).collect()}


def test_empty_terms_count_documents_once(spark):
    df = spark.createDataFrame([(1, ["", "", "x"]), (2, [""])], "i int, w array<string>")
    got = {r["term"]: (r["count"], r["documents"]) for r in terms.vocabulary(df, "w").collect()}
    assert got == {"": (3, 2), "x": (1, 1)}


def test_idf_equals_mllib(spark):
    df = spark.createDataFrame([(i, w) for i, w in DOCS], "i int, w array<string>")
    table_ = {r["term"]: r["idf"] for r in terms.inverse_document_frequency(df, "w").collect()}
    model = CountVectorizerModel.from_vocabulary(["a", "b", "c"], inputCol="w", outputCol="tf")
    counted = model.transform(df)
    weighted = IDF(inputCol="tf", outputCol="f").fit(counted).transform(counted).withColumn("f", vector_to_array("f"))
    first = weighted.where("i = 1").first()["f"]
    assert first[0] == pytest.approx(2 * table_["a"]) and first[1] == pytest.approx(table_["b"])


def test_leading_terms_break_ties_by_name(spark):
    df = spark.createDataFrame([("g", ["z", "y", "x", "x"]), ("h", ["z"])], "g string, w array<string>")
    assert table(terms.leading_terms(df, "w", "g", 2), "g", "rank", "term", "count") == [("g", 1, "x", 2), ("g", 2, "y", 1), ("h", 1, "z", 1)]


# -------------------------------------------------------------------- discussion
def test_discussion_types_use_lemmas(spark):
    lemmas = literal_table(spark, [("policies", "policy"), ("societies", "society"), ("jobbed", "work"), ("cats", "cat")], "term string, lemma string")
    texts = ["new policies soon", "two societies", "jobbed", "neural policies", "jobs", "Cats!", None, "the of and"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    typed = discussion.discussion_type(df, lemmas=lemmas)
    by_lemma = {k: v for k, v in [("policies", "policy"), ("societies", "society"), ("jobbed", "work"), ("cats", "cat")]}

    def by_hand(words):
        joined = " ".join(by_lemma.get(w, w) for w in words)
        for name, keywords in K.KEYWORD_CLASSES.items():
            if any(k in joined for k in keywords):
                return name
        return "other"

    for r in typed.collect():
        assert r["topic_type"] == by_hand(r["tokens"]), r["content"]
    assert Counter(r["topic_type"] for r in typed.collect()) == {"societal": 3, "technical": 1, "other": 4}
    best = terms.leading_terms(typed, "tokens", "topic_type", 5, lemmas)
    assert ("societal", "policy", 1) in {(r["topic_type"], r["term"], r["count"]) for r in best.collect()}


def test_discussion_tables(comments, posts):
    docs = discussion_plan.contents(comments, posts, ["A", "B"])
    made = discussion_plan.tables(docs)
    counts = {r["topic_type"]: r["count"] for r in made["discussion_types"].collect()}
    assert sum(counts.values()) == docs.count()
    assert counts["technical"] == 3 and counts["ethical"] == 1
    assert sum(r["count"] for r in made["discussion_types_by_month"].collect()) == docs.count()


# ----------------------------------------------------------------------- network
def test_network(spark):
    rows = [("u1", "A", "good"), ("u1", "A", "bad"), ("u1", "B", "good"), ("u2", "A", "good"), ("u3", "A", "bad"), (None, "A", "bad"), ("u2", "A", None)]
    df = spark.createDataFrame([(f"c{i}", *r, at("2023-07-01") + i) for i, r in enumerate(rows)],
                               "id string, author string, subreddit string, body string, created_utc bigint")
    lexicon = literal_table(spark, LEXICON, "term string, valence double")
    kept = network_plan.messages(df, ["A", "B"])
    nodes, edges = network_plan.graph(kept, 2, lexicon, RULES)
    assert table(edges, "user", "subreddit", "weight", "sentiment") == [("u1", "A", 1, 0.0), ("u1", "B", 1, 1.0), ("u2", "A", 1, 1.0)]
    got = {r["id"]: (r["type"], r["degree"], round(r["sentiment"], 6)) for r in nodes.collect()}
    assert got == {"u1": ("user", 2, round(1 / 3, 6)), "u2": ("user", 1, 1.0), "A": ("subreddit", 2, round(1 / 3, 6)), "B": ("subreddit", 1, 1.0)}
    last = network_plan.graph(kept, 2, lexicon, RULES, pick="last")[1]
    assert ("u1", "A", 1, -1.0) in table(last, "user", "subreddit", "weight", "sentiment")
    with pytest.raises(ValueError):
        network.edges(df, pick="first")


def test_default_lexicon_has_no_doubles():
    assert len({t for t, _ in sentiment.LEXICON}) == len(sentiment.LEXICON)
