"""Importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import rows_of

from communitylens.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def grams(text, size):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[k:k + n]) for n in range(1, size + 1) for k in range(len(words) - n + 1)]


def brute(documents, target, percent=10, min_words=20, size=1, buckets=10_000, seed=2024):
    bucket = lambda feature: zlib.crc32(feature.encode()) % buckets
    source, wanted = Counter(), Counter()
    for _, text in documents:
        source.update(map(bucket, grams(text, size)[1]))
    for text in target:
        wanted.update(map(bucket, grams(text, size)[1]))
    all_s, all_t = sum(source.values()), sum(wanted.values())
    rows = []
    for doc, text in documents:
        n, features = grams(text, size)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (all_s + buckets) / ((source[b] + 1) * (all_t + buckets)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long_enough = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    for k, row in enumerate(long_enough[:len(long_enough) * percent // 100]):
        row[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def texts():
    pick = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "été", "漢字", "x1", "ünder", "the", "of", "zeta9", "Ж"]
    signs = [" ", ", ", "-", "\n", " \x00", "é", "..."]
    rows = [(k, "".join(pick.choice(words) + pick.choice(signs) for _ in range(pick.randint(0, 60)))) for k in range(150)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, "alpha " * 30), (None, "beta " * 25), (None, None), (200, None), (201, ""), (202, "?! --")]
    return rows + [(203, "gamma " * 40_000), (204, "alpha beta " * 9 + "alpha"), (205, "alpha beta " * 10), (-3, "x1 " * 22)]


TARGET = ["alpha beta gamma", "été été", None, "", "The OF 漢字"]


@pytest.mark.parametrize("size,buckets,percent", [(1, 10_000, 10), (1, 7, 100), (3, 500, 33)])
def test_equals_brute_force(spark, documents, size, buckets, percent):
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id int, text string")
    got = resample.resample(documents(texts()), target, percent, 20, size, buckets)
    assert rows_of(got, *COLUMNS) == brute(texts(), TARGET, percent, 20, size, buckets)


def test_chunks_do_not_matter(spark, documents, monkeypatch):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    monkeypatch.setattr(resample, "CHUNK_BYTES", 100)
    monkeypatch.setattr(resample, "MEMORY", 3)
    assert rows_of(resample.resample(documents(texts(), 7), target, grams=2, buckets=50), *COLUMNS) == brute(texts(), TARGET, size=2, buckets=50)


def test_no_gram_crosses_two_texts():
    words, found = resample.Grams(2)([b"a b", b"", b"c", b"d e f"])
    assert words.tolist() == [2, 0, 1, 3]
    assert [zlib.crc32(g) for g in (b"a b", b"d e", b"e f")] == found[1][1].tolist() and found[1][0].tolist() == [0, 3, 3]


def test_joined_hashes():
    pick = random.Random(5)
    pairs = [(pick.randbytes(pick.randint(0, 50)), pick.randbytes(pick.randint(0, 3000))) for _ in range(200)]
    crc = [np.array([zlib.crc32(x) for x in side], np.int64) for side in zip(*pairs, strict=True)]
    got = resample.joined_hashes(*crc, np.array([len(b) for _, b in pairs], np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_one_hot_document_and_empty_tables(spark, documents):
    rows = [(5, "alpha beta " * 15)] * 200 + [(k, f"w{k} " * 21) for k in range(100)]
    target = spark.createDataFrame([("alpha",)], "text string")
    got = resample.resample(documents(rows), target)
    assert rows_of(got, *COLUMNS) == brute(rows, ["alpha"])
    none = spark.createDataFrame([], "text string")
    assert rows_of(resample.resample(documents(rows), none), *COLUMNS) == brute(rows, [])
    assert resample.resample(documents([]), target).count() == 0
