"""Axes, curves, sketches, intervals, phrases, lemmas, coherence, list-free overlap, increments and streams by brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import at, in_order, table
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from communitylens.operators import coherence, intervals, lemmas, overlap, passes, phrases, sketches
from communitylens.plans import ingest
from communitylens.sources import sinks, tables
from communitylens.streaming import counts


# ------------------------------------------------------------ axes and curves
def matrix(rows=90, size=40, seed=1):
    random_ = np.random.default_rng(seed)
    dense = random_.random((rows, size)) * (random_.random((rows, size)) < 0.2)
    dense[:, 3] *= 9
    dense[:, 7] = dense[:, 3] * 0.5 + dense[:, 7] * 4
    dense[5] = 0
    return dense


def vectors(spark, dense, partitions=4):
    rows = [(k, Vectors.dense(x) if k % 5 == 0 else Vectors.sparse(len(x), [(int(i), float(x[i])) for i in np.flatnonzero(x)])) for k, x in enumerate(dense)]
    schema = StructType([StructField("id", LongType()), StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema).repartition(partitions)


def test_axes_are_those_of_the_covariance(spark):
    dense = matrix()
    found = passes.principal_axes(vectors(spark, dense), k=3, tolerance=1e-9)
    values, axes = np.linalg.eigh(np.cov(dense.T))
    assert found.variance == pytest.approx(values[::-1][:3], rel=1e-8) and found.total == pytest.approx(values.sum())
    assert np.abs(np.sum(found.axes * axes[:, ::-1][:, :3], axis=0)) == pytest.approx(1, abs=1e-6)
    assert found.residual <= 1e-9 and all(found.axes[np.abs(found.axes[:, k]).argmax(), k] > 0 for k in range(3))
    placed = passes.projected(vectors(spark, dense), found.axes).select("id", vector_to_array("pca_features").alias("v")).collect()
    assert np.array([r["v"] for r in sorted(placed)]) == pytest.approx(dense @ found.axes)


def test_axes_of_few_features_and_vectors(spark):
    for dense in (matrix()[:, :1], matrix()[:2], np.zeros((4, 6)), matrix()[:1]):
        found = passes.principal_axes(vectors(spark, dense))
        want = np.linalg.eigvalsh(np.atleast_2d(np.cov(dense.T)))[::-1][:2] if len(dense) > 1 else np.zeros(2)
        assert found.variance == pytest.approx(want[:len(found.variance)], abs=1e-9)
        assert passes.projected(vectors(spark, dense), found.axes).count() == len(dense)


def test_chunks_do_not_matter(spark, monkeypatch):
    dense = matrix()
    want = passes.principal_axes(vectors(spark, dense)).variance
    monkeypatch.setattr(passes, "CHUNK", 7)
    assert passes.principal_axes(vectors(spark, dense, 1)).variance == pytest.approx(want)


def cost(dense, centres):
    return ((dense[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_curve_costs_are_of_its_centres_and_fall(spark):
    dense = np.concatenate([matrix(60, 12, s) + 8 * s for s in range(4)])
    curve = passes.cluster_curve(vectors(spark, dense), range(1, 8))
    assert list(curve.costs) == list(range(1, 8)) and curve.costs[1] == pytest.approx(((dense - dense.mean(axis=0)) ** 2).sum())
    for k, centres in curve.centres.items():
        assert len(centres) == k and curve.costs[k] == pytest.approx(cost(dense, centres))
    assert all(b <= a for a, b in itertools.pairwise(curve.costs.values())) and curve.costs[4] < curve.costs[3] / 2


def test_all_cluster_numbers_share_scans(spark):
    df = vectors(spark, matrix(80, 10, 4)).persist()
    together = passes.cluster_curve(df, range(2, 11), iterations=5)
    apart = sum(passes.cluster_curve(df, [k], iterations=5).scans for k in range(2, 11))
    df.unpersist()
    assert together.scans < apart / 2


def test_fewer_different_vectors_than_clusters(spark):
    dense = np.array([[1.0, 2.0]] * 5 + [[4.0, 0.0]] * 3)
    curve = passes.cluster_curve(vectors(spark, dense), range(1, 5))
    assert [len(curve.centres[k]) for k in range(1, 5)] == [1, 2, 2, 2] and curve.costs[2] == pytest.approx(0, abs=1e-9) == curve.costs[4]
    assert passes.cluster_curve(vectors(spark, dense).limit(0), [2, 3]).costs == {2: 0.0, 3: 0.0}


# --------------------------------------------------------------------- sketches
def test_distinct_sketches_merge(spark):
    rows = [(f"g{k % 3}", k % 12, (k * k) % 5000) for k in range(30_000)] + [("g0", 1, None), ("empty", 1, None)]
    df = spark.createDataFrame(rows, "g string, month int, v int")
    stored = sketches.distinct_sketches(df, ["g", "month"], "v")
    exact = {}
    for g, _, v in rows:
        exact.setdefault(g, set()).update([] if v is None else [v])
    got = {r["g"]: r["n"] for r in sketches.distinct_rollup(stored, ["g"]).collect()}
    assert got.keys() == exact.keys() and all(abs(got[g] - len(exact[g])) <= sketches.distinct_error() * len(exact[g]) for g in got)
    small = {r["month"]: r["n"] for r in sketches.distinct_rollup(sketches.distinct_sketches(df.where("v < 900"), ["month"], "v"), ["month"]).collect()}
    assert small == {m: len({v for _, k, v in rows if k == m and v is not None and v < 900}) for m in small}  # exact below the sketch's size
    for r in sketches.distinct_shared(stored, "g").collect():
        a, b = exact[r["a"]], exact[r["b"]]
        assert abs(r["shared"] - len(a & b)) <= sketches.distinct_error() * max(len(a | b), 1)


def test_quantile_sketches_merge(spark):
    pick = random.Random(3)
    rows = [(k % 40, pick.choice([pick.random() ** 3 * 1e6, 5.0])) for k in range(20_000)] + [(1, None)]
    stored = sketches.quantile_sketches(spark.createDataFrame(rows, "day int, v double"), ["day"], "v")
    values = sorted(v for _, v in rows if v is not None)
    for share in (0.05, 0.5, 0.95):
        got = sketches.quantile_rollup(stored.withColumn("all", F.lit(1)), ["all"], share).first()
        below, upto = np.searchsorted(values, got["value"]) / len(values), np.searchsorted(values, got["value"], side="right") / len(values)
        assert got["n"] == len(values) and below <= share + sketches.rank_error() and upto >= share - sketches.rank_error()


# -------------------------------------------------------------------- intervals
def spans(seed, n, reach):
    pick, out = random.Random(seed), []
    for k in range(n):
        start = pick.randint(-reach, reach)
        length = pick.choice([0, 1, 2, 3, pick.randint(0, 9), pick.randint(0, reach)])
        out.append((k, None if pick.random() < 0.1 else start, None if pick.random() < 0.1 else start + length - (pick.random() < 0.05)))
    return out + out[:3]


def meet(a, b, c, d):
    low = lambda x: -math.inf if x is None else x
    high = lambda x: math.inf if x is None else x
    return low(a) < high(b) and low(c) < high(d) and low(a) < high(d) and low(c) < high(b)


@pytest.mark.parametrize("seed,reach", [(1, 20), (2, 1000), (3, 1 << 40)])
def test_overlaps_equal_brute_force(spark, seed, reach):
    left, right = spans(seed, 80, reach), spans(seed + 50, 60, reach)
    got = intervals.overlapping(
        spark.createDataFrame(left, "i int, a bigint, b bigint"), spark.createDataFrame(right, "j int, c bigint, d bigint"), "a", "b", "c", "d")
    want = [(i, j) for i, a, b in left for j, c, d in right if meet(a, b, c, d)]
    assert table(got, "i", "j") == in_order(want)


def test_moments_and_empty_sides(spark):
    right = spark.createDataFrame(spans(9, 40, 30), "j int, c bigint, d bigint")
    left = spark.createDataFrame([(k, k - 30) for k in range(60)] + [(99, None)], "i int, t int")
    got = intervals.overlapping(left, right, "t", None, "c", "d")
    assert table(got, "i", "j") == in_order((i, j) for i, t in [(k, k - 30) for k in range(60)] for j, c, d in spans(9, 40, 30) if meet(t, t + 1, c, d))
    assert intervals.overlapping(left.limit(0), right, "t", None, "c", "d").count() == 0 == intervals.overlapping(left, right.limit(0), "t", None, "c", "d").count()


# ----------------------------------------------------------------------- phrases
def walked(words, listed):
    out, k = [], 0
    longest = max((len(p.split(" ")) for p in listed), default=0)
    while k < len(words):
        sizes = [n for n in range(1, longest + 1) if k + n <= len(words) and " ".join(w or "\0" for w in words[k:k + n]) in listed]
        if sizes:
            out.append((k, sizes[-1], " ".join(words[k:k + sizes[-1]])))
        k += sizes[-1] if sizes else 1
    return out


def test_phrases_equal_brute_force(spark):
    pick, letters = random.Random(5), "abcd"
    for sizes in ((1,), (2, 3), (1, 2, 5)):
        listed = {" ".join(pick.choice(letters) for _ in range(pick.choice(sizes))) for _ in range(25)}
        rows = [(k, [pick.choice([*letters, None, "x", "a b"]) for _ in range(pick.randint(0, 15))]) for k in range(120)] + [(500, None)]
        df = spark.createDataFrame(rows, "id int, words array<string>")
        got = {r["id"]: None if r["f"] is None else [tuple(x) for x in r["f"]] for r in df.select("id", phrases.Phrases(sorted(listed)).found("words").alias("f")).collect()}
        # a word with a blank inside is no two words
        assert {k: v for k, v in got.items() if not any(" " in (w or "") for w in dict(rows)[k] or [])} == {
            k: None if w is None else walked(w, listed) for k, w in rows if not any(" " in (x or "") for x in w or [])}


def test_phrase_scores(spark):
    df = spark.createDataFrame([(1, "kiss of death or a kiss".split()), (2, []), (3, None)], "id int, words array<string>")
    lexicon = spark.createDataFrame([("kiss of death", -1.5), ("kiss of death", -2.0), ("kiss", 1.0), ("of", 9.0), (None, 5.0)], "term string, valence double")
    assert table(phrases.phrase_score(df, "words", ["id"], lexicon), "id", "phrases", "valence") == [(1, 2, -0.5), (2, 0, 0.0), (3, 0, 0.0)]
    assert table(phrases.phrase_score(df, "words", ["id"], lexicon.limit(0)), "phrases") == [(0,), (0,), (0,)]
    with pytest.raises(ValueError):
        phrases.Phrases(["two  blanks"])


def test_one_scan_for_a_thousand_phrases(spark):
    listed = [f"w{a} w{b}" for a in range(40) for b in range(25)]
    found = spark.range(10).select(F.split(F.lit("w1 w2 w3 w4"), " ").alias("w")).select(phrases.Phrases(listed).found("w").alias("f"))
    assert "Join" not in found._jdf.queryExecution().toString() and found.first()["f"] == [(0, 2, "w1 w2"), (2, 2, "w3 w4")]


# ------------------------------------------------------------------------ lemmas
def test_lemmas_by_rules(spark):
    terms = ["wolves", "boxes", "running", "baked", "cities", "women", "best", "wives", "s", "is", "was", "nicest", "wolf", None, "runs", "unknowns"]
    words = ["wolf", "box", "bake", "city", "woman", "wife", "nice", "run", "was", "bak"]
    df = spark.createDataFrame([(t,) for t in terms * 2], "term string")
    vocabulary = spark.createDataFrame([(w,) for w in words * 2], "word string")
    named = spark.createDataFrame([("best", "good"), ("wives", "wife"), ("best", "well")], "term string, lemma string")
    got = {r["term"]: r["lemma"] for r in lemmas.lemma_table(df, vocabulary, named).collect()}
    assert got == {"wolves": "wolf", "boxes": "box", "running": "running", "baked": "bake", "cities": "city", "women": "woman", "best": "good",
                   "wives": "wife", "s": "s", "is": "is", "was": "was", "nicest": "nice", "wolf": "wolf", "runs": "run", "unknowns": "unknowns"}


# --------------------------------------------------------------------- coherence
def test_coherence_by_hand(spark):
    docs = [(1, ["a", "b", "a"]), (2, ["a"]), (3, ["b", "c"]), (4, []), (5, None), (6, ["a", "b", "d"])]
    listed = [(0, "a"), (0, "b"), (0, "zzz"), (1, "a"), (1, "c"), (1, "c")]
    got = {r["topic"]: (r["pairs"], r["npmi"]) for r in coherence.coherence(
        spark.createDataFrame(docs, "id int, words array<string>"), "id", "words", spark.createDataFrame(listed, "topic int, term string")).collect()}
    ab = math.log((2 / 6) / ((3 / 6) * (3 / 6))) / -math.log(2 / 6)
    assert got[0] == (3, pytest.approx((ab - 2) / 3)) and got[1] == (1, -1.0)


def test_words_that_meet_are_counted_in_one_bounded_pass(spark, monkeypatch):
    listed = [f"w{k}" for k in range(12)]
    docs = [(i, [f"w{k}" for k in range(14) if i >> k & 1] * 2) for i in range(1 << 12)] + [(-1, []), (-2, None)]  # every set of words
    df = spark.createDataFrame(docs, "id int, words array<string>").repartition(5)
    sent, plain = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: sent.append(plain(self)) or sent[-1])
    seen, total = coherence.document_counts(df, "words", listed)
    want = [[sum(1 for _, ws in docs if ws and a in ws and b in ws) for b in listed] for a in listed]
    assert seen.tolist() == want and total == len(docs)
    assert sum(t.num_rows for t in sent) == 12 * 12 + 1  # by the list, not by the documents
    assert coherence.document_counts(spark.createDataFrame([], "words array<string>"), "words", ["a"])[1] == 0


# ----------------------------------------------------------------------- overlap
def test_overlap_without_a_list(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 3)
    pick = random.Random(8)
    rows = [(f"c{pick.randrange(9)}", f"u{int(pick.random() ** 2 * 30)}") for _ in range(500)] + [(None, "u1"), ("c1", None)] + [(f"c{k}", "bot") for k in range(9)]
    df = spark.createDataFrame(rows, "subreddit string, author string")
    sets = {}
    for c, u in rows:
        if c and u and u != "u2":
            sets.setdefault(c, set()).add(u)
    want = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if sets[a] & sets[b]]
    assert table(overlap.shared_by_index(df, exclude_authors=("u2",)), "a", "b", "shared") == in_order(want)
    assert table(overlap.shared_by_index(df, exclude_authors=("u2",), least=12), "a", "b", "shared") == in_order(r for r in want if r[2] >= 12)


# ------------------------------------------------------------------------ ingest
def test_two_runs_equal_one(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    def rows(first, last):
        made = [(f"i{k}", "A" if k % 3 else "other", f"u{k}", k, at("2023-06-01") + k * 40_000) for k in range(first, last)]
        return spark.createDataFrame(made, "id string, subreddit string, author string, score int, created_utc bigint")
    columns = ("id", "subreddit", "author", "score", "created_utc")
    run = lambda: ingest.run_new(spark, source, target, ["A"], columns)
    sinks.write_parquet(rows(0, 120).repartition(2), f"{source}/one")
    assert run()["files"] == 2 and run() == {"files": 0, "months": 0}
    sinks.write_parquet(rows(100, 160).repartition(1), f"{source}/two")  # twenty rows once more
    assert run()["files"] == 1
    got = tables.scan_parquet(spark, f"{target}/data")
    assert table(got, *columns) == table(ingest.filtered(rows(0, 160), ["A"], columns), *columns)
    assert {(r["yyyy"], r["mm"]) for r in got.select("yyyy", "mm").distinct().collect()} == {(2023, 6), (2023, 7), (2023, 8)}


def test_a_run_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    df = spark.createDataFrame([(f"i{k}", "A", at("2023-06-01") + k) for k in range(10)], "id string, subreddit string, created_utc bigint")
    sinks.write_parquet(df.coalesce(1), source)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest.run_new(spark, source, target, ["A"], ["id", "subreddit", "created_utc"])
    monkeypatch.undo()
    assert ingest.run_new(spark, source, target, ["A"], ["id", "subreddit", "created_utc"])["files"] == 1
    assert tables.scan_parquet(spark, f"{target}/data").count() == 10


# --------------------------------------------------------------------- streaming
def test_stream_counts_and_late_rows(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    day = datetime(2024, 1, 1)
    files = [
        [(day + timedelta(hours=h), "a") for h in (0, 1, 7, 9)],
        [(day + timedelta(hours=h), "b") for h in (2, 30, 31)],
        [(day + timedelta(hours=h), "a") for h in (3, 29, 40)],  # three o'clock comes 28 hours behind
    ]
    schema = "ts timestamp, kind string"
    made = lambda: counts.windowed_counts(counts.scan_stream(spark, source, schema, 1), "ts", ["kind"], "6 hours", "12 hours")
    dropped = 0
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        dropped += counts.Counter(made(), ["kind"], folder).advance()  # a new Counter goes on
    got = table(counts.Counter(made(), ["kind"], folder).table(), "start", "kind", "count")
    kept = [r for f in files for r in f if r != (day + timedelta(hours=3), "a")]
    want = Counter((t.replace(hour=t.hour // 6 * 6), k) for t, k in kept)
    assert got == in_order((s, k, n) for (s, k), n in want.items()) and dropped == 1
    assert counts.Counter(made(), ["kind"], folder).advance() == 0
    batch = counts.windowed_counts(spark.createDataFrame(kept, schema), "ts", ["kind"], "6 hours", "12 hours")
    assert table(batch, "start", "kind", "count") == got
