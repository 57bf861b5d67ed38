from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from communitylens.llm import vectors


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by comparing every pair."""
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(links[i]), least, vec is None or vec == least))
    return sorted(out, key=str)


def clustered(seed, n, dimensions=24):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, dimensions))
    rows = []
    for i in range(n):
        x = centres[random.integers(12)] + random.normal(size=dimensions) * random.choice([0.02, 0.2, 0.35])
        rows.append((i * 2, [float(np.float32(v)) for v in x], int(random.integers(3))))
    return rows + [(10_000 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(20_000, [2 * v for v in rows[0][1]], rows[0][2])]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return df.select("*", *[F.lit("x").alias(c) for c in ("row", "key", "unit", "node", "copies", "home", "mark", "n_links")]).repartition(3)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = clustered(1, 400)
    got = sorted(map(tuple, vectors.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = brute(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert found >= 0.98 * all_links
    assert sum(a[2:] == b[2:] for a, b in zip(got, want, strict=True)) >= 0.98 * len(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1),
        (9, [1.0, 0.01], 1), (9, [1.0, 0.01], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e30, 0.0], 1), (13, [-1.0, 0.0], 1), (None, None, 1),
    ]
    assert sorted(map(tuple, vectors.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert vectors.near_duplicates(frame(spark, [])).count() == 0
    nothing = [(1, None, 1), (2, [0.0], 1)]
    assert sorted(map(tuple, vectors.near_duplicates(frame(spark, nothing)).collect()), key=str) == brute(nothing)


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    got, want = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str), brute(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)


def test_codes_approximate_cosines():
    random = np.random.default_rng(5)
    units = random.normal(size=(600, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    index = vectors.fit(units, 8)
    home = index.home(units)
    place = int(np.bincount(home).argmax())
    members = units[home == place]
    error = index.approximate(units, place, index.codes(members, home[home == place])) - units @ members.T
    assert np.abs(error).mean() < 0.05
    assert all(h in p for h, p in zip(home, index.probes(units), strict=True))


@pytest.mark.parametrize("unit", [True, False])
def test_means_give_as_many_centres(unit):
    points = np.eye(6)
    assert vectors._means(points, 4, 3, np.random.default_rng(0), unit).shape == (4, 6)


def planted(seed, n, sample, dimensions=64):
    """Isotropic unit vectors, the first ``sample`` of them to fit on, and a partner at cosine 0.93 to 0.95 for each of the others."""
    random = np.random.default_rng(seed)
    units = random.normal(size=(n, dimensions))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rest = units[sample:]
    aside = random.normal(size=rest.shape)
    aside -= np.einsum("ij,ij->i", aside, rest)[:, None] * rest
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosines = random.uniform(0.93, 0.95, len(rest))[:, None]
    return units, cosines * rest + np.sqrt(1 - cosines ** 2) * aside


def test_codes_of_vectors_outside_the_sample_lose_no_link():
    units, partners = planted(4, 4000, 800)
    index = vectors.fit(units[:800], 50)
    rest = units[800:]
    home = index.home(rest)
    codes = index.codes(rest, home)
    floors = index.floors(rest, home, codes, 0.93)
    near = np.array([index.approximate(q[None], h, c[None])[0, 0] for q, h, c in zip(partners, home, codes, strict=True)])
    assert (near < 0.93 - 0.25).any()  # a fixed distance below the threshold does not do
    assert (near >= floors).all()
    assert np.mean([index.approximate(rest, h, c[None])[:, 0] >= f for h, c, f in zip(home[:200], codes[:200], floors[:200], strict=True)]) < 0.2


def test_planted_links_on_a_table_larger_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE", 500)
    units, partners = planted(8, 2500, 500)
    rows = [(i, u.tolist(), 1) for i, u in enumerate(np.concatenate([units, partners]))]
    got = dict(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).select("vec_id", "n_links").collect())
    both = np.array([r[1] for r in rows])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    want = (both @ both.T >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(len(rows)))
    assert sum(got.values()) >= 0.995 * want.sum()
