"""The Merkle manifest against a tree made by hand."""

from __future__ import annotations

import random

import pytest
from conftest_llm import rows_of, sha
from pyspark.sql import functions as F

from communitylens.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes, fanout):
    """(root, each node's [(left, right), ...])."""
    paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for first in range(0, len(nodes), fanout):
            run = nodes[first:first + fanout]
            for k, owned in enumerate(owners[first:first + fanout]):
                for o in owned:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            held.append([o for owned in owners[first:first + fanout] for o in owned])
        nodes, owners = up, held
    return nodes[0], paths


def brute(rows, fanout=8, change=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf(change(row)), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *climb([x[2] for x in sorted(groups[g])], fanout)) for g in names}
    root, upper = climb([trees[g][1] for g in names], fanout)
    out = []
    for at, g in enumerate(names):
        members, subroot, paths = trees[g]
        for (_, _, own, claimed, doc), path in zip(members, paths, strict=True):
            path = path + upper[at]
            folded = claimed
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((doc, own, subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def rows(n=400):
    pick = random.Random(2)
    langs = ["en"] * 6 + ["de", "fr", None, "é", "Z", "a", "", "-"]
    out = [(k if k % 17 else None, pick.choice(["s", None, "1:s"]), pick.choice(langs), pick.choice([None, k, -k]), pick.choice([None, "", f"Text {k}", "ÉTÉ ABC"])) for k in range(n)]
    return out + [out[3]] * 30 + [(9001, "s", "lonely", 1, "Alone"), (9002, None, "pair", None, None), (9003, "x", "pair", 5, "B" * 300_000)]


def report(df, **more):
    out = merkle.verify(df, **more)
    return rows_of(out.withColumn("proof_sha256", F.sha2(merkle.proof("path"), 256)), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def frame(spark, data, partitions=5):
    df = spark.createDataFrame(data, KIND).repartition(partitions)
    return df.select("*", *[F.lit("x").alias(c) for c in ("leaf", "root", "tree", "lo", "hi", "hash", "path", "kids", "place", "part", "total", "ident", "name")])


def changed(row):
    return (*row[:4], row[4].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if row[4] and row[0] is not None and row[0] % 3 == 0 else row[4])


@pytest.mark.parametrize("fanout", [8, 2, 3])
def test_equals_brute_force(spark, fanout):
    data = rows()
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(F.col("doc_id") % 3 == 0, lower).otherwise(F.col("text"))
    assert report(frame(spark, data), changed={"text": text}, fanout=fanout) == brute(data, fanout, changed)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 513])
def test_sizes_of_one_tree(spark, n):
    data = [(k, "s", "en", k, f"t{k}") for k in range(n)]
    got = report(frame(spark, data))
    assert got == brute(data) and all(r[-1] for r in got)


def test_many_groups(spark):
    data = [(k, "s", f"g{k % 90}", k, f"t{k}") for k in range(150)]
    assert report(frame(spark, data)) == brute(data)


def test_order_and_partitions_do_not_matter(spark):
    data = rows(100)
    assert report(frame(spark, data, 1)) == report(frame(spark, data[::-1], 9))


def test_any_change_is_seen(spark):
    data = [(k, "s", "en", k, f"t{k}") for k in range(80)]
    root = report(frame(spark, data))[0][3]
    for k, value in ((0, 999), (1, "other"), (3, None), (4, "t1 ")):
        other = [r if i != 40 else tuple(value if j == k else x for j, x in enumerate(r)) for i, r in enumerate(data)]
        assert report(frame(spark, other))[0][3] != root


def test_empty_table(spark):
    out = merkle.verify(frame(spark, []))
    assert out.count() == 0 and {"doc_id", "leaf", "subroot", "root", "path", "folded_root", "verified"} <= set(out.columns)


def test_no_python_workers(spark):
    out = merkle.verify(frame(spark, rows(50)))
    text = out._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
