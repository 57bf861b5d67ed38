from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from communitylens.llm import quality

SF = "/root/testdata/sf0.1"


def test_isotonic_equals_min_max_formula():
    pick = random.Random(3)
    for _ in range(50):
        n = pick.randint(1, 30)
        sums, counts = np.array([pick.randint(0, 5) for _ in range(n)], float), np.array([pick.randint(1, 6) for _ in range(n)], float)
        places = np.arange(n, dtype=float)
        where, values = quality.isotonic(places, sums, counts)
        want = [max(min(sums[a:b + 1].sum() / counts[a:b + 1].sum() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.unique(np.round(values, 9)))
        assert (np.diff(where) > 0).all()


def test_statistics_do_not_depend_on_neighbours():
    texts = ["One two\nthree, THREE!!", "", "one one one one", "é漢 %%% &&&", "x" * 5000, "a b c " * 500]
    raw = [t.encode() for t in texts]
    together = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for line, text in zip(together, raw, strict=True):
        assert np.allclose(line, quality.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])
    assert together.shape == (len(texts), quality.N_STATISTICS)


def test_normal_equations_equal_one_matrix(spark):
    random_ = np.random.default_rng(1)
    stats, labels = random_.normal(size=(200, quality.N_STATISTICS)), random_.integers(0, 2, 200)
    df = spark.createDataFrame([(s.tolist(), float(y)) for s, y in zip(stats, labels, strict=True)], "stats array<double>, label double").repartition(5)
    n = quality.N_STATISTICS
    model = quality.Model(np.zeros(n), np.ones(n), random_.normal(size=(n, 20)), np.zeros(20), np.zeros(21), np.zeros(1), np.zeros(1))
    z = model.features(stats)
    assert np.allclose(quality._normal_equations(df, model), z.T @ np.hstack([z, labels[:, None]]))


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return quality.score(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    assert (scored["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in scored["doc_id"]]).all()
    held = scored[scored["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.98
    good = held[held["quality"] == 1]
    assert (good["predicted"] == 1).mean() > 0.99
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= 0.7) == (scored["predicted"] == 1)).all()


def test_held_out_labels_are_not_used(spark, documents):
    rows = [(i, "good words in a row " * (1 + i % 5) if i % 3 else "%%% &&& ### " * (1 + i % 4)) for i in range(300)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, "x") for i in range(300)], "doc_id bigint, quality int, score string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    both = [sorted(map(tuple, quality.score(documents(rows), x).collect())) for x in (labels, other)]
    assert both[0] == both[1]
    assert {(r[0], r[3]) for r in both[0]} == {(i, 1 if i % 3 else 0) for i in range(300)}


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (2, ""), (None, "text here"), (3, "word " * 50_000)]
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {(r.score, r.predicted) for r in quality.score(documents(rows), none).collect()} == {(1.0, 1)}
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (3, 1), (99, 0)], "doc_id bigint, quality int")
    got = quality.score(documents(rows), odd)
    assert got.count() == len(rows) and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(documents([]), odd).count() == 0
    df = documents(rows)
    assert quality.keep(df, odd).columns == df.columns
