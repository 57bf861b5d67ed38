from __future__ import annotations

import collections
import math
import random
import re
import statistics
import zlib

import numpy as np
import pytest

from communitylens.llm import katz

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ("end",)]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute(rows, order):
    """The model from its definition, over dictionaries; checks that each context's probabilities add up to one."""
    grams = [collections.Counter() for _ in range(order)]
    runs = lambda t, k: [tuple(([("begin",)] * (k - 1) + t)[i:i + k]) for i in range(len(t))]
    for doc, text in rows:
        if not held(doc):
            for k in range(order):
                grams[k].update(runs(tokens(text), k + 1))
    words = {w: c for (w,), c in grams[0].items()}
    total, types = sum(words.values()), len(words)
    factors = [katz.good_turing([sum(x == r for x in c.values()) for r in range(1, 7)]).factors for c in grams]
    cut = lambda k, c: c * (factors[k][c] if c <= 5 else 1)
    whole, left = total, total - sum(cut(0, c) for c in words.values())
    if left <= 1e-9:
        whole, left = total + 1, left + 1
    after = [collections.defaultdict(dict) for _ in range(order)]
    for k in range(1, order):
        for g, c in grams[k].items():
            after[k][g[:-1]][g[-1]] = c

    def probability(context, w):
        k = len(context)
        if k == 0:
            return (cut(0, words[w]) if w in words else left) / whole
        if w in after[k].get(context, ()):
            return cut(k, after[k][context][w]) / weights[context][0]
        return (weights[context][1] if context in weights else 1) * probability(context[1:], w)

    weights = {}
    for k in range(1, order):
        for context, seen in after[k].items():
            n, mass = sum(seen.values()), sum(cut(k, c) for c in seen.values())
            n += n - mass <= 1e-9
            weights[context] = n, (n - mass) / n / (1 - sum(probability(context[1:], w) for w in seen))
            everything = sum(probability(context, w) for w in words) + probability(context, ("never",))
            assert abs(everything - 1) < 1e-9
    out = []
    for doc, text in rows:
        t = tokens(text)
        score = sum(math.log10(probability(g[:-1], g[-1])) for g in runs(t, order))
        base = sum(math.log10((words.get(w, 0) + 1) / (total + types + 1)) for w in t)
        out.append((doc, held(doc), len(t), sum(w in words for w in t), total, base, score))
    return sorted(out, key=lambda r: (str(r[0]), r[2]))


def check(df, rows, order=3):
    got = sorted((tuple(r) for r in katz.score(df, order=order).collect()), key=lambda r: (str(r[0]), r[2]))
    want = brute(rows, order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


def test_edges(documents):
    rows = [(1, "a b a b a"), (2, None), (3, ""), (None, "x y Z"), (4, "A b"), (4, "A b"), (8, "q q q"), (9, " \t\n"), (5, "word " * 50_000)]
    check(documents(rows), rows)


def test_nothing_to_discount(documents):
    rows = [(i, "a b " * 8) for i in range(20)]
    check(documents(rows), rows)


def test_no_training_rows(documents):
    rows = [(i, "a b") for i in range(200) if held(i)]
    check(documents(rows), rows)
    assert katz.score(documents([])).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_many_batches_and_ranges(documents, monkeypatch, order):
    monkeypatch.setattr(katz, "BATCH_BYTES", 3000)
    monkeypatch.setattr(katz, "RANGE_BYTES", 3000)
    pick = random.Random(2)
    rows = [(i, " ".join(f"w{int(pick.paretovariate(0.7)) % 400}" for _ in range(pick.randint(0, 120)))) for i in range(300)]
    rows += [(1000 + i, rows[i % 40][1]) for i in range(80)]  # copies in other batches, some of them held out
    check(documents(rows), rows, order)


def test_packed_numbers_come_back():
    pick = random.Random(4)
    keys = np.unique(np.array([pick.getrandbits(64) for _ in range(1000)], np.uint64))
    for found in (keys, keys[:1], keys[:0], np.array([0, 2 ** 64 - 1], np.uint64)):
        assert katz.unpacked(katz.packed(found)).tolist() == found.tolist()
    for found in ([], [0], [255, 3, 254, 10 ** 12], [7] * 5000):
        assert katz.small(katz.shrunk(np.array(found, np.int64))).tolist() == found


def test_good_turing_is_used_where_it_holds():
    assert 0 < katz.good_turing([1000, 400, 220, 140, 95, 70]).factors[1] < 1
    assert list(katz.good_turing([0, 4, 2, 1, 1, 1]).factors[1:3]) == [0.5, 0.75]


def katz_factors(n, k):
    """Katz (1987): r* / r with r* = (r + 1) n[r + 1] / n[r], scaled so that what is taken off is n[1]."""
    rest = (k + 1) * n[k + 1] / n[1]
    return [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]


def test_one_bad_factor_lowers_the_cut_off():
    n = [0, 1000, 400, 220, 140, 150, 70]  # 5 n5 > 4 n4: the factor of 4 is above 1
    assert katz_factors(n, 5)[3] > 1
    got = katz.good_turing(n[1:]).factors
    assert all(math.isclose(a, b) for a, b in zip(got, [1, *katz_factors(n, 3), 1, 1], strict=True))


def test_counts_of_counts_are_smoothed_where_no_cut_off_holds():
    n = [1000, 600, 150, 0, 60, 20]  # the factor of 1 is above 1 at any cut-off
    slope = statistics.linear_regression([math.log(r + 1) for r, x in enumerate(n) if x], [math.log(x) for x in n if x]).slope
    want = katz_factors([0, *[r ** slope for r in range(1, 7)]], 5)
    got = katz.good_turing(n).factors
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, [1, *want], strict=True))
    assert all(0 < x < 1 for x in got[1:])
