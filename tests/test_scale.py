"""What a task reads, and what is sent, must not grow with the tables beyond their share."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__
from communitylens.functions import text
from communitylens.operators import features, models, overlap, terms, wordcounts
from communitylens.operators.sentiment import Rules, score_sentiment
from communitylens.plans import quality
from communitylens.session import parts_for, written
from communitylens.sources import tables
from workload import roles
from workload import tables as queries

ROOT = "/root/testdata/sf0.001"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --------------------------------------------------------------------- sentiment
@pytest.mark.parametrize("rules", [Rules(), roles.RULES])
def test_scoring_is_compiled(spark, rules):
    """The virtual machine leaves methods of more than 8,000 bytes uncompiled, which costs most of the time."""
    df = spark.createDataFrame([(1, "a good day")], "i int, t string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else code is generated stage by stage
    try:
        code = score_sentiment(df, "t", ["i"], roles.lexicon(spark), rules=rules)._jdf.queryExecution().debug().codegenToSeq().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"ByteCodeStats\((\d+),", code)]
    assert sizes and max(sizes) < 8000


def test_large_files_are_dealt_into_more_parts(spark, tmp_path, small_splits):
    path = str(tmp_path / "t")
    spark.range(40_000).selectExpr("id", "uuid() AS t").coalesce(1).write.parquet(path)
    df = tables.scan_parquet(spark, path, partitions=16)
    assert df.rdd.getNumPartitions() > 100 and df.agg(F.count("*"), F.sum("id")).first()[:] == (40_000, 40_000 * 39_999 // 2)


# -------------------------------------------------------------------- classifier
def test_fits_read_parts_of_bounded_size(spark, monkeypatch):
    assert [parts_for(spark.range(n), 20) for n in (0, 20, 21, 100)] == [1, 1, 2, 5]
    seen = []
    monkeypatch.setattr(quality, "in_parts", lambda df, parts: seen.append(parts) or df.coalesce(parts))
    quality.run_labels(roles.docs(spark, ROOT), {"high": (1000, "at_least")}, size=64, iterations=2, part_rows=50)
    assert seen == [4]  # 200 documents


# --------------------------------------------------------------------------- csv
def test_csv_files_become_more_with_the_table(spark, small_splits):
    made = __spark_entry__.queries()["scan_csv"](spark, ROOT)
    assert len(made.inputFiles()) > 16 and made.count() == 200


# ----------------------------------------------------------------------- overlap
def test_pairs_of_communities_are_not_exchanged(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "subreddit string, author string")
    made = overlap.shared_by_index(df)
    assert "Exchange" not in _plan(made).split("Generate explode(_left")[0]
    assert {tuple(r) for r in made.collect()} == {("a", "a", 2), ("b", "b", 1), ("a", "b", 1), ("b", "a", 1)}


def test_lists_of_communities_are_not_exchanged(spark, monkeypatch):
    """The lists of an author were sent to the places of each two blocks, about nine times the index."""
    pick = random.Random(5)
    rows = {(f"c{pick.randrange(40)}", f"u{pick.randrange(60)}") for _ in range(900)} | {(f"c{k}", "bot") for k in range(40)}
    df = spark.createDataFrame([*rows, *rows], "subreddit string, author string")
    want = Counter((a, b) for a, u in rows for b, v in rows if u == v)
    for group, place_rows, blocks in ((64, 48_000_000, 4), (1, 48_000_000, 4), (2, 150, 16)):  # (1, ...): most authors have parts
        monkeypatch.setattr(overlap, "GROUP", group)
        monkeypatch.setattr(overlap, "PLACE_ROWS", place_rows)
        made = overlap.shared_by_index(df)
        assert "Exchange" not in _plan(made) and made.rdd.getNumPartitions() == blocks * (blocks + 1) // 2
        assert {(r["a"], r["b"]): r["shared"] for r in made.collect()} == want and made.count() == len(want)


# ---------------------------------------------------------------------- clusters
def test_letters_are_one_class_of_listed_characters(spark):
    """Java tests unions of ranges and ``\\s`` one after the other: over 173 MB of texts 15.8 s instead of 1 s."""
    chars = "".join(map(chr, [*range(1, 0x180), 0x2028, 0x3000, 0x4E2D, 0x1F600]))
    df = spark.createDataFrame([(chars,), ("",), (None,), ("Straße 42\u00a0\t\x0b\r\n\x0c\x1f ÄB\U0001f600c",)], "t string")
    made = df.select(text.cluster_text("t").alias("a"), text.letters_only("t").alias("b"))
    want = df.select(F.regexp_replace("t", r"[^A-Za-z\s]", ""), F.regexp_replace("t", r"[^a-z\s]", " "))
    assert made.collect() == want.collect()
    assert not re.search(r"a-z|\\s", _plan(made))


def test_gaps_to_centres(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 4))
    df = spark.createDataFrame([(i, Vectors.dense(v) if i % 2 else Vectors.sparse(4, range(4), v)) for i, v in enumerate(x)], ["id", "features"])
    model = models.fit_clusters(df, 3)
    centres = np.array(model.clusterCenters())
    made = models.centre_gaps(model, model.transform(df))
    for r in made.collect():
        want = ((x[r["id"]] - centres) ** 2).sum(axis=1)
        assert np.allclose(np.array(r["gaps"]) + x[r["id"]] @ x[r["id"]], want) and int(np.argmin(r["gaps"])) == r["cluster"]
    assert not re.search("Exchange|Join", _plan(made))


def test_texts_are_counted_once_for_their_weights(spark):
    _, vectors = models.cluster_features(roles.docs(spark, ROOT), "body")
    assert "FileScan" not in _plan(vectors) and vectors.count() == 200


def test_models_are_saved_without_copies_of_the_texts(spark, monkeypatch):
    """Every fit and answer exchanged the texts twice, and they were stored uncompressed next to all their words."""
    texts, stored = [], []
    monkeypatch.setattr(queries, "written", lambda df: stored.append(df) or written(df))
    monkeypatch.setattr(models, "written", lambda df: texts.append(df) or written(df))
    monkeypatch.setattr(models, "cut_lineage", lambda df: pytest.fail("an uncompressed copy"))
    made = __spark_entry__.queries()["save_model"](spark, ROOT)
    assert all(r["n"] == r["equal_rows"] == 200 for r in made.collect())
    assert [df.columns for df in stored] == [["id", "body", "created_utc", "score"]] and [df.columns for df in texts] == [["id", "raw_features"]]
    assert len(re.findall(r"Exchange .*text", _plan(stored[0]))) <= 1 and "body" not in str(re.findall(r"Exchange .*", _plan(made)))


def test_unlabelled_documents_are_those_of_docs(spark, tmp_path):
    documents = [(1, "a b", "en", "src1", 3), (2, "c", "de", "src2", 1), (2, "d", "de", "src2", 1), (None, "e", "en", "src1", 1), (4, None, "en", None, None)]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 0), (2, 1), (2, 0), (2, None), (None, 1), (None, 0), (9, 1), (9, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    want = roles.docs(spark, str(tmp_path)).drop("label")
    made = roles.unlabelled(spark, str(tmp_path))
    assert made.columns == want.columns and made.count() == 1 + 3 + 3 + 1 + 1
    assert sorted(map(repr, made.collect())) == sorted(map(repr, want.collect()))


# ------------------------------------------------------------------------ topics
def test_perplexity_is_one_pass(spark, monkeypatch):
    calls, plain = [], LDAModel.logPerplexity
    monkeypatch.setattr(LDAModel, "logPerplexity", lambda self, df: calls.append(1) or plain(self, df))
    assert __spark_entry__.queries()["lda_fit"](spark, ROOT).first()["is_finite"] and calls == [1]


def test_topic_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    df = spark.createDataFrame([(i, "cat dog bird"[: 3 + i % 9]) for i in range(40)], "id int, t string").withColumn("clean_text", seen("t"))
    words, vectors = models.topic_vectors(df, ["id"], min_df=1)
    assert vectors.count() == 40 and set(words) >= {"cat", "dog"} and read.value == 40


def test_counted_texts_are_those_of_the_stages(spark):
    """Split, counted and made vectors as by Tokenizer, StopWordsRemover and CountVectorizerModel."""
    texts = ["the cat sat  on The mat cat", "", "   ", " lead\ttab\n\n x\x0by\r\fz  ", "\u0130stanbul \u212aELVIN \u00c9 cat", "the the", "cat\u00a0dog mat\u2003x", "mat ", " "]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "id int, t string").coalesce(2)
    stages = Pipeline(stages=[features.tokenizer("t", "tokens"), features.stop_words_remover("tokens", "words", ["CAT"])])
    words = stages.fit(df).transform(df.where("t IS NOT NULL"))
    made = wordcounts.counted(df, "t", ["id"], [*features.K.ENGLISH_STOP_WORDS, "CAT"])
    for min_df, size in ((1, None), (2, None), (1, 3)):
        want = terms.vocabulary(words, "words", min_df, size)
        assert sorted(wordcounts.leading(made, min_df, size).collect()) == sorted(want.collect())
    listed = ["mat", "x", "", "tab", "z"]
    want = CountVectorizerModel.from_vocabulary(listed, inputCol="words", outputCol="v").transform(words)
    got = {r["id"]: r["v"] for r in wordcounts.with_vectors(made, listed, "v").collect()}
    assert {r["id"]: r["v"] for r in want.collect()} | {len(texts): Vectors.sparse(5, [], [])} == got
