from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from helpers import at  # noqa: E402

from communitylens.session import local_session  # noqa: E402

COMMENT = "id string, subreddit string, author string, body string, score bigint, created_utc bigint, link_id string"
POST = "id string, subreddit string, author string, title string, selftext string, score bigint, created_utc bigint"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(str(tmp_path_factory.mktemp("shared")), "tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def comments(spark):
    rows = [
        ("c1", "A", "ann", "The model is good", 25, at("2023-06-01", "00:00:00"), "t3_p1"),
        ("c1", "A", "ann", "The model is good", 25, at("2023-06-01", "00:00:00"), "t3_p1"),  # id repeated
        ("c2", "A", "bob", "[deleted]", 1, at("2023-06-20"), "t3_p1"),
        ("c3", "A", "bob", "", -3, at("2023-06-21"), "t3_p2"),
        ("c4", "A", None, "see http://x.org/a now", None, at("2023-06-22"), "t3_gone"),
        ("c5", "A", "[deleted]", "[removed]", 0, at("2023-06-23"), "t3_p2"),
        ("c6", "A", "ann", None, 7, at("2023-08-02"), "t3_p3"),  # no rows in July
        ("c7", "A", "cid", "bias in  policy", 20, at("2023-08-03"), "t3_p3"),
        ("c8", "B", "ann", "hello", 6, at("2023-10-05"), "t3_p4"),
        ("c9", "B", None, "hello", 6, at("2023-09-05"), "t3_p4"),
        ("c10", "B", "[deleted]", "bye", 5, at("2024-07-31", "00:00:00"), "t3_p4"),
        ("c11", "B", "dee", "late", 5, at("2024-07-31", "00:00:01"), "t3_p4"),
        ("c12", "a", "ann", "other case", 5, at("2023-06-05"), "t3_p1"),
        ("c13", "C", None, "nobody", 5, at("2023-06-05"), "t3_p9"),
    ]
    return spark.createDataFrame(rows, COMMENT).repartition(3)


@pytest.fixture(scope="session")
def posts(spark):
    rows = [
        ("p1", "A", "ann", "First", "about neural things", 10, at("2023-06-01")),
        ("p2", "A", "bob", "Second", None, 0, at("2023-06-10")),
        ("p3", "A", "eve", "", "no title", 30, at("2023-08-01")),
        ("p4", "B", "ann", "Fourth", "[removed]", -5, at("2023-09-01")),
        ("p5", "D", "fay", None, "x", 5, at("2023-09-02")),
    ]
    return spark.createDataFrame(rows, POST)
