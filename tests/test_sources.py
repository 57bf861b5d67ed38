from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.plans import ingest, trips
from communitylens.session import checkpoint_dir, cut_lineage, literal_table
from communitylens.sources import profile, sinks, tables
from helpers import table


def test_named_csv_is_one_sorted_file(spark, tmp_path):
    df = spark.range(50).repartition(7).withColumn("t", F.lit('quoted "x", y'))
    path = tmp_path / "out" / "table.csv"
    for _ in range(2):  # the second write replaces the first
        sinks.write_csv_named(df, str(path), [F.desc("id")])
    assert path.is_file() and not (tmp_path / "out" / "table.csv.parts").exists()
    back = tables.scan_csv(spark, str(path), "id bigint, t string")
    assert [r["id"] for r in back.collect()] == list(range(49, -1, -1))
    assert path.read_text().splitlines()[0] == "id,t"


def test_empty_table_still_has_a_header(spark, tmp_path):
    sinks.write_csv_named(spark.range(0), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text().strip() in ("id", "")


def test_partitioned_scan_reads_only_the_named_folder(spark, tmp_path):
    df = spark.range(40).withColumns({"yyyy": (F.col("id") % 2 + 2023).cast("int"), "mm": (F.col("id") % 5 + 1).cast("int")})
    sinks.write_parquet(df, str(tmp_path / "t"), ("yyyy", "mm"))
    part = tables.scan_partitions(spark, str(tmp_path / "t"), 2023, 3)
    assert {r["id"] for r in part.collect()} == {i for i in range(40) if i % 2 == 0 and i % 5 == 2}
    assert len(part.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(yyyy" in _plan(part)


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["line1\nline2", " pad ", "", None, 'a "quoted", b', '"', "\r\n", "tab\t", "#no comment", "\\N", "back\\", "a\\\"b", "é漢😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("n", F.when(F.col("id") % 2 == 0, F.col("id")))
    sinks.write_csv(df.repartition(4), str(tmp_path / "parts"))
    sinks.write_csv_named(df, str(tmp_path / "one.csv"))
    for path in ("parts", "one.csv"):
        back = tables.scan_csv(spark, str(tmp_path / path), "id int, t string, n int")
        assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_monthly_paths():
    assert tables.monthly_paths("s/{year}-{month:02d}.parquet", range(1, 3), year=2021) == ["s/2021-01.parquet", "s/2021-02.parquet"]


def test_range_rows_and_sql(spark):
    evens = tables.source_range(spark, 1000).where("id % 2 = 0").select((F.col("id") * 2).alias("d"))
    assert evens.count() == 500 and evens.agg(F.max("d")).first()[0] == 1996
    rows = tables.source_rows(spark, [("a", 1, 0.5), ("b", 2, None)], "k string, n bigint, x double")
    assert [tuple(r) for r in rows.collect()] == [("a", 1, 0.5), ("b", 2, None)]
    assert tables.run_sql(rows, "some_rows", "SELECT COUNT(*) AS total FROM some_rows").first()["total"] == 2


def test_profile(spark):
    df = spark.createDataFrame([(1, "x" * 150, [1]), (2, None, [2]), (None, "a", None)], "n int, t string, l array<int>")
    got = {r["column"]: r for r in profile.schema_profile(df).collect()}
    assert (got["n"]["rows"], got["n"]["nulls"], got["n"]["smallest"], got["n"]["type"]) == (3, 1, "1", "int")
    assert got["t"]["largest"] == "x" * 100 + "..." and got["t"]["approx_distinct"] == 2
    assert profile.available(df, ["z", "t", "n"]) == ["t", "n"]
    assert profile.show_sample(df.where("t is not null"), 1, ["t", "z"], 10, ["n"]).columns == ["t"]


def test_ingest_keeps_what_exists_and_replaces(spark, tmp_path, comments, posts):
    source, target = str(tmp_path / "raw"), str(tmp_path / "project")
    comments.write.parquet(f"{source}/comments")
    posts.write.parquet(f"{source}/submissions")
    for _ in range(2):
        ingest.run(spark, source, target, ["A"])
    kept = spark.read.parquet(f"{target}/comments")
    assert kept.columns == ["id", "subreddit", "author", "body", "score", "created_utc", "link_id", "date", "year_month"]
    assert kept.count() == 8 and {r["year_month"] for r in kept.collect()} == {"2023-06", "2023-08"}
    assert spark.read.parquet(f"{target}/submissions").columns == [
        "id", "subreddit", "author", "title", "selftext", "score", "created_utc", "date", "year_month"]
    assert len(set(K.INGEST_COMMUNITIES)) == 100


def test_cut_lineage_uses_the_named_folder(spark, tmp_path):
    where = checkpoint_dir(spark)
    kept = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert kept.count() == 10 and "Range" not in _plan(kept)
    assert checkpoint_dir(spark) == where


def test_literal_tables_have_a_known_size(spark):
    small = literal_table(spark, [("a", 1)], "k string, n int")
    assert "LocalTableScan" in _plan(small)
    big = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    assert "BroadcastHashJoin" in _plan(big.join(small, "k"))


def test_trips_of_one_year(spark):
    rows = [("2020-12-31 23:59:59", 9.0), ("2021-01-01 00:00:00", 1.0), ("2021-01-01 10:00:00", 4.0), ("2021-12-31 23:59:59", 2.0), ("2022-01-01 00:00:00", 9.0)]
    df = spark.createDataFrame(rows, "t string, fare_amount double").select(
        F.col("t").cast("timestamp").alias("tpep_pickup_datetime"), "fare_amount", F.lit(1.0).alias("trip_distance"),
        F.lit(0.5).alias("mta_tax"), F.col("fare_amount").alias("tip_amount"), F.col("fare_amount").alias("passenger_count"))
    got = trips.daily(df)
    assert [tuple(r) for r in got.select("dt_month", "dt_day", "num_trips", "q95_fare_amount", "min_tip_amount", "mean_passenger_count").collect()] == [
        (12, 31, 1, 2.0, 2.0, 2), (1, 1, 2, 4.0, 1.0, 3)]
    assert tuple(trips.run_summary(got).first()) == (2, 1, 1, 12, 31, 3, 1.5)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
