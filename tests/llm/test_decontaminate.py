from __future__ import annotations

import re

from conftest_llm import rows_of, sha

from communitylens.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(documents, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            size = min(10, len(w))
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k:k + size]), set()).add(str(item))
    out = []
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[k:k + size]))):
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(2, LONG), (10, "w3, W4 w5  w6 w7 w8 w9 w10 w11 w12!"), (1, "Short   ÉTÉ item"), (1, "Short ÉTÉ item"), (3, None), (4, "..."), (None, "no id here"), (5, "x " * 12)]
DOCS = [
    (1, LONG), (2, LONG), (2, LONG), (3, "before " + LONG.upper().replace(" ", ", ") + " after"), (4, None), (5, ""), (6, "?! --"),
    (7, "a short ÉTÉ. item b short été item short ÉTÉ item"), (8, " ".join(f"w{i}" for i in range(9))), (9, "x " * 30), (None, "w1 " + LONG),
    (10, ("filler " * 40_000) + LONG + " no id here"), (11, "w5 w6 w7 w8 w9 w10 w11 w12 w13 other w14 w15"),
]


def test_equals_brute_force(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows_of(decontaminate.report(documents(DOCS), items), *COLUMNS) == brute(DOCS, ITEMS)


def test_common_passage_in_most_documents(spark, documents):
    rows = [(i, f"u{i} " * (i % 7) + LONG) for i in range(300)]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows_of(decontaminate.report(documents(rows), items), *COLUMNS) == brute(rows, ITEMS)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(decontaminate.report(documents(DOCS), none), *COLUMNS) == brute(DOCS, [])
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.report(documents([]), items).count() == 0


def test_clean_keeps_columns_and_clean_rows(spark, documents):
    df = documents(DOCS)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(DOCS, ITEMS) if not r[5]} | {None}
