from __future__ import annotations

import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from communitylens.functions import timeparts
from communitylens.operators.counting import relative_to_max
from communitylens.operators.inequality import gini, positions
from communitylens.operators.overlap import overlap, shared_audience
from communitylens.operators.retention import retention
from communitylens.plans import community, summary
from helpers import in_order, table

JUNE, AUGUST = date(2023, 6, 1), date(2023, 8, 1)


# ---------------------------------------------------------------------- activity
def test_activity(comments, posts):
    got = table(community.activity(comments, posts, ["A", "B"]), "subreddit", "month", "posts", "comments", "total_activity")
    assert got == [
        ("A", JUNE, 2, 5, 7), ("A", AUGUST, 1, 2, 3), ("B", date(2023, 9, 1), 1, 1, 2),
        ("B", date(2023, 10, 1), 0, 1, 1), ("B", date(2024, 7, 1), 0, 1, 1),
    ]


def test_community_statistics(comments, posts):
    got = {r["subreddit"]: r for r in summary.community_statistics(comments, posts).collect()}
    assert got["C"]["num_submissions"] == 0 and got["C"]["avg_submission_score"] == 0.0
    assert got["D"]["num_comments"] == 0 and got["D"]["avg_comment_score"] == 0.0
    assert sum(r["total_rows"] for r in got.values()) == comments.count() + posts.count()


# -------------------------------------------------------------------------- gini
def gini_by_hand(values) -> float:
    kept = sorted(v for v in values if v is not None and v >= 0)
    n, total = len(kept), sum(kept)
    if not n or not total:
        return 0.0
    differences = sum(abs(x - y) for x in kept for y in kept)
    return differences / (2 * n * total)


@pytest.mark.parametrize("partitions", [1, 7])
def test_gini_equals_mean_difference(spark, partitions):
    rng = random.Random(1)
    groups = {
        "spread": [rng.expovariate(1 / 1000) for _ in range(150)], "counts": [rng.randint(0, 5) for _ in range(200)],
        "heavy": [int(rng.paretovariate(0.7)) for _ in range(200)], "zero": [0, 0, 0], "one": [5],
        "mixed": [None, -4, 3, 3, 0, 9], "nothing": [None, -1], "close": [1e6 + i / 1000 for i in range(100)],
    }
    rows = [(g, float(v) if v is not None else None) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    got = {r["g"]: r["gini"] for r in gini(df, ["g"], "v").collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx(gini_by_hand(values), abs=1e-9), g


def test_positions_of_equal_values(spark):
    rng = random.Random(8)
    values = [rng.choice([0, 0.5, 1, 3, 1000, 1001, 1e9, None, -2]) for _ in range(300)]
    df = spark.createDataFrame([(g, v if v is None else float(v)) for v in values for g in ("g", None)] + [("h", None)], "g string, v double")
    order = sorted(v for v in values if v is not None and v >= 0)
    expected = {(v, order.count(v), order.index(v) + 1, order.index(v) + order.count(v)) for v in order}
    got = {tuple(r) for r in positions(df.repartition(5), ["g"], "v").collect()}
    assert got == {(g, *rest) for rest in expected for g in ("g", None)}


def test_relative_to_max(spark):
    df = spark.createDataFrame([("g", 2.0), ("g", 4.0), ("h", 3.0), (None, 5.0), (None, None)], "g string, v double")
    assert table(relative_to_max(df, "g", "v"), "g", "v", "relative") == in_order([
        ("g", 2.0, 0.5), ("g", 4.0, 1.0), ("h", 3.0, 1.0), (None, 5.0, 1.0), (None, None, None)])


def test_gini_ignores_nan(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", float("nan"))], "g string, v double")
    assert gini(df, ["g"], "v").first()["gini"] == pytest.approx(0.25)


def test_attention_leaves_missing_sides_null(comments, posts):
    got = {(r["subreddit"], r["month"]): r for r in community.attention(comments, posts, ["A", "B"]).collect()}
    assert got[("B", date(2023, 10, 1))]["gini_scores"] is None
    assert got[("A", JUNE)]["gini_comments"] == pytest.approx(gini_by_hand([2, 2, 1]))
    assert got[("A", JUNE)]["gini_scores"] == pytest.approx(gini_by_hand([10, 0]))


# --------------------------------------------------------------------- retention
def retention_by_hand(rows):
    users, periods = defaultdict(set), defaultdict(set)
    for c, p, a in rows:
        periods[c].add(p)
        if a is not None:
            users[c, p].add(a)
    result = set()
    for c, ps in periods.items():
        last = None
        for p in sorted(ps):
            back = len(users[c, p] & users[c, last]) if last is not None else 0
            active = len(users[c, p])
            result.add((c, p, active, back, round(back / active, 9) if active else 0.0))
            last = p
    return result


@pytest.mark.parametrize("periods", [None, range(1, 10), range(-60, 10)])
@pytest.mark.parametrize("partitions", [1, 5])
def test_retention_equals_sets(spark, partitions, periods):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), rng.randint(1, 9), rng.choice([None, "[deleted]", *"abcdefgh"])) for _ in range(150)]
    rows += [("x", 4, "hot")] * 300 + [("lonely", 3, None), ("gap", 1, "a"), ("gap", 8, "a")]
    df = spark.createDataFrame(rows, "c string, p int, a string").repartition(partitions)
    got = retention(df, "c", "p", "a", periods=periods).collect()
    assert {(*tuple(r)[:4], round(r["engagement_ratio"], 9)) for r in got} == retention_by_hand(rows)


def test_retention_can_skip_authors_and_use_the_calendar(spark):
    rows = [("x", date(2023, 6, 1), "a"), ("x", date(2023, 8, 1), "a"), ("x", date(2023, 9, 1), "a"), ("x", date(2023, 9, 1), "[deleted]")]
    df = spark.createDataFrame(rows, "subreddit string, month date, author string")
    def back(**options):
        return [r["returning_users"] for r in retention(df, **options).orderBy("month").collect()]
    months = timeparts.months_between("2023-06-01", "2023-09-30")
    for periods in (None, months):
        assert back(periods=periods) == [0, 1, 1]
        assert back(previous="calendar", periods=periods) == [0, 0, 1]
    last = retention(df, exclude_authors=("[deleted]",)).orderBy("month").collect()[-1]
    assert (last["active_users"], last["returning_users"]) == (1, 1)
    with pytest.raises(ValueError):
        retention(df, previous="ever")


def test_months_between():
    assert timeparts.months_between("2023-11-15", "2024-02-01") == [date(2023, 11, 1), date(2023, 12, 1), date(2024, 1, 1), date(2024, 2, 1)]
    assert len(timeparts.months_between("2023-06-01", "2024-07-31")) == 14


def test_retention_of_the_fixture(comments, posts):
    got = table(community.retention(comments, posts, ["A"]), "month", "active_users", "returning_users")
    assert got == [(JUNE, 3, 0), (AUGUST, 3, 1)]


# ----------------------------------------------------------------------- overlap
@pytest.mark.parametrize("n", [4, 70])
def test_overlap_equals_sets(spark, n):
    rng = random.Random(3)
    names = [f"s{i}" for i in range(n)]
    rows = [(rng.choice(names), f"u{rng.randint(1, 40)}") for _ in range(6 * n)]
    rows += [(s, "[deleted]") for s in names[: n // 2] for _ in range(20)] + [("empty", None), ("unlisted", "u1")]
    df = spark.createDataFrame(rows, "subreddit string, author string")
    listed = [*names, "empty", "absent"]
    users = defaultdict(set)
    for s, a in rows:
        if s in listed:
            users[s] |= {a} - {None}
    expected = {(a, b, len(users[a] & users[b]), len(users[a] | users[b])) for a in users for b in users}
    got = overlap(df, listed).collect()
    assert {(r["a"], r["b"], r["shared"], r["joint"]) for r in got} == expected
    assert len(got) == len(expected)
    for r in got:
        assert r["jaccard"] == pytest.approx(r["shared"] / r["joint"] if r["joint"] else 0.0)


def test_overlap_can_leave_out_authors(comments, posts):
    pairs = {(r["a"], r["b"]): r["shared"] for r in shared_audience(comments, ["A", "B"], exclude_authors=("[deleted]",)).collect()}
    assert pairs[("A", "B")] == 1
    assert {(r["a"], r["b"]): r["shared"] for r in shared_audience(comments, ["A", "B"]).collect()}[("A", "B")] == 2


def test_overlap_matrix_is_symmetric_with_ones(comments, posts):
    pairs = community.audience_overlap(comments, posts, ["A", "B"])
    rows = {r["subreddit"]: r for r in community.overlap_matrix(pairs, ["A", "B"]).collect()}
    assert rows["A"]["A"] == rows["B"]["B"] == 1.0 and rows["A"]["B"] == rows["B"]["A"]


# ---------------------------------------------------------------------- summaries
def test_dataset_summary_and_basics(comments, posts):
    dated_c, dated_p = (df.withColumn("date", F.to_date(F.timestamp_seconds("created_utc"))) for df in (comments, posts))
    got = {r["data_type"]: r for r in summary.dataset_summary(dated_c, dated_p).collect()}
    assert (got["comments"]["total_rows"], got["comments"]["date_range_start"], got["comments"]["date_range_end"]) == (14, "2023-06-01", "2024-07-31")
    assert got["submissions"]["size_gb"] == 0.0
    assert tuple(summary.unique_totals(comments).first()) == (13, 5)
    assert [tuple(r) for r in summary.top_communities(comments, 2).collect()] == [("A", 8), ("B", 4)]
    assert sum(r["num_comments"] for r in summary.peak_hours(comments).collect()) == 14
