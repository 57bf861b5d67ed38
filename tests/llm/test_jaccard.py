from __future__ import annotations

import random
import re

import numpy as np
from conftest_llm import rows_of

from communitylens.llm import jaccard
from communitylens.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted([(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def near_copies(seed, n):
    pick = random.Random(seed)
    bases = [[f"t{pick.randrange(200)}" for _ in range(pick.randint(8, 90))] for _ in range(6)]
    line = "the same common line stands in many of these texts".split()
    out = []
    for i in range(n):
        words = list(pick.choice(bases))
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(len(words))] = f"new{pick.randrange(1000)}"
        out.append((i * 3, " ".join(words + (line if pick.random() < 0.5 else []))))
    return out


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "One two three"), (8, "One two three"),
    (None, "one two three"), (9, "one two three four"), (10, "a b " * 30_000), (11, "A b " * 30_000), (12, "É é x y z"), (13, "é é x y z"), (None, "alone here"),
]


def test_equals_brute_force(documents):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 50)):
        rows = near_copies(seed, 150) + EDGES
        assert rows_of(jaccard.classes(documents(rows), k, percent), "doc_id", "n_shingles", "component_id") == brute(rows, k, percent)


def test_frequent_tokens_everywhere(documents):
    line = " ".join(f"c{i}" for i in range(12))
    rows = [(i, f"{line} u{i} v{i} w{i}" if i % 3 else line) for i in range(120)]
    assert rows_of(jaccard.classes(documents(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_empty_table(documents):
    assert jaccard.classes(documents([])).count() == 0


def test_keep_first(documents):
    rows = near_copies(5, 80) + EDGES
    df = documents(rows)
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    want = sorted(((d, t) for (d, t), (e, _, c) in zip(sorted(rows, key=lambda r: str(r[0])), sorted(brute(rows, 5, 80), key=lambda r: str(r[0])), strict=True) if e is None or e == c), key=str)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _ in want if d is not None)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_blocks_equal_brute_force(documents, monkeypatch):
    """Nearly all comparisons in blocks, of a few sets each."""
    for name, value in (("LIST", 2), ("BLOCK_SETS", 7), ("BLOCK_TOKENS", 300), ("PART", 9), ("MEETINGS", 50)):
        monkeypatch.setattr(jaccard, name, value)
    for seed, k, percent in ((4, 4, 85), (6, 5, 80), (7, 2, 50)):
        rows = near_copies(seed, 200) + EDGES
        assert rows_of(jaccard.classes(documents(rows), k, percent), "doc_id", "n_shingles", "component_id") == brute(rows, k, percent)


def test_group_just_below_the_threshold(documents):
    """Copies of one text that differ from each other by a little more, or a little less, than the threshold."""
    pick = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in pick.sample(range(100), 2):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    assert rows_of(jaccard.classes(documents(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_intersections_from_a_reference_set():
    random_ = np.random.default_rng(3)
    for size, spread in ((1, 5), (40, 60), (90, 300)):
        sides = []
        for n in (17, 23):
            base = random_.choice(spread, min(spread, 30), replace=False)
            sets = [np.unique(np.concatenate([base[random_.random(len(base)) < 0.9], random_.integers(0, spread, random_.integers(0, size + 1))])) for _ in range(n)]
            sides.append((np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets), n, sets))
        got = jaccard.common_counts(sides[0][:3], sides[1][:3])
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sides[1][3]] for a in sides[0][3]]
