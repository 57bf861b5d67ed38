"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from communitylens.operators import filters, ranking
from communitylens.plans import community

ROOT = "/root/testdata/sf0.001"
JOBS = sorted(n for n in __spark_entry__.queries() if n.startswith("job_") and n not in (
    "job_topics", "job_quality_classifier", "job_text_clusters", "job_filter_ingest"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOBS)
def test_jobs_stay_on_the_jvm_without_cross_joins(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, ROOT))
    for unwanted in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text


@pytest.mark.parametrize("name", ["job_retention", "job_overlap", "job_gini"])
def test_users_are_never_collected_into_sets(spark, name):
    assert "collect_set" not in plan(__spark_entry__.queries()[name](spark, ROOT))


def test_filters_reach_the_scan(spark, tmp_path, comments):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    comments.write.parquet(str(tmp_path / "c"))
    text = plan(filters.scoped(spark.read.parquet(str(tmp_path / "c")), ["A", "B"]).select("subreddit", "month"))
    pushed = text.split("PushedFilters: ")[1]
    assert "GreaterThanOrEqual(created_utc,1685577600)" in pushed and "LessThanOrEqual(created_utc,1722384000)" in pushed
    assert "In(subreddit, [A,B])" in pushed
    assert "ReadSchema: struct<subreddit:string,created_utc:bigint>" in text


def test_top_k_is_limited_before_the_exchange(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    text = plan(ranking.top_k_per_group(df, "g", 5, [F.desc("id")]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_distinct_counts_shuffle_by_value(spark, comments, posts):
    text = plan(community.activity(comments, posts, ["A"]))
    assert "subreddit" in text and text.count("Exchange hashpartitioning(subreddit") >= 2
    import re

    assert re.search(r"Exchange hashpartitioning\(subreddit#\d+, month#\d+, id#\d+", text)


def test_short_key_tables_are_broadcast(spark):
    df = spark.read.parquet(f"{ROOT}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    text = plan(ranking.keep_keys(df, ranking.most_frequent(df, "l_suppkey", 500), "l_suppkey"))
    assert "BroadcastHashJoin" in text


def test_reports_are_sums_over_stored_tables(spark):
    """Texts and tables are read while the stored table is made, not again by each report."""
    from communitylens.plans import clusters, discussion, quality, summary
    from workload import roles

    comments, posts, docs = roles.comments(spark, ROOT), roles.posts(spark, ROOT), roles.docs(spark, ROOT)
    made = list(summary.tables(comments, posts).values())
    contents = discussion.contents(roles.chat(spark, ROOT), docs, None, "2023-01-01", "2025-01-01")
    made += [df for name, df in discussion.tables(contents).items() if name != "discussion_terms"]
    made += quality.run(docs, threshold=1000, size=256, iterations=3)[2].values()
    made += clusters.run(clusters.documents(docs), k=2, size=64)[1].values()
    assert len(made) == 3 + 3 + 5 + 4
    for df in made:
        assert "FileScan" not in plan(df)


def test_no_job_runs_while_types_are_planned(spark):
    from communitylens.operators.discussion import discussion_type
    from workload import roles

    docs, lemmas = roles.docs(spark, ROOT), roles.lemmas(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning types", "")
    try:
        discussion_type(docs, "body", lemmas=lemmas)
        assert not tracker.getJobIdsForGroup("planning types")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_values_below_one_are_spread_over_ranges(spark):
    from communitylens.operators.inequality import _histogram

    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.col("id") / 40_000_000).alias("v"))
    sizes = _histogram(df, ["g"], "v").groupBy("_range").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 40_000 / 20 and sizes[1] >= 32
