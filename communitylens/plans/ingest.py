"""From the raw tables to the project's own, smaller copy."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens import constants as K
from communitylens.functions import timeparts
from communitylens.operators import filters
from communitylens.session import cut_lineage
from communitylens.sources import sinks, tables


def filtered(df: DataFrame, communities: Sequence[str] = K.INGEST_COMMUNITIES,
             columns: Sequence[str] = K.COMMENT_COLUMNS, ignore_case: bool = False) -> DataFrame:
    """Rows of the communities, the wanted columns that exist, and date and year_month.

    One narrow stage: the community list reaches the parquet scan and nothing is shuffled.
    """
    kept = filters.select_available(filters.in_communities(df, communities, ignore_case=ignore_case), columns)
    return kept.withColumn("date", timeparts.utc_date("created_utc")).withColumn(
        "year_month", timeparts.year_month_padded("date")
    )


def run(spark: SparkSession, source: str, target: str, communities: Sequence[str] = K.INGEST_COMMUNITIES,
        partition_by: tuple[str, ...] = ()) -> None:
    """Filter ``source``/comments and ``source``/submissions into ``target``."""
    for name, columns in (("comments", K.COMMENT_COLUMNS), ("submissions", K.SUBMISSION_COLUMNS)):
        raw = tables.scan_parquet(spark, f"{source}/{name}/")
        sinks.write_parquet(filtered(raw, communities, columns), f"{target}/{name}/", partition_by)


def _new_files(spark: SparkSession, source: str, manifest: str) -> DataFrame:
    """(path, size, modified) of the files under ``source`` that the manifest does not hold in that state."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    if not exists(spark, manifest):
        return listed
    return listed.join(tables.scan_parquet(spark, manifest), ["path", "size", "modified"], "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at a path of any file system that Spark can reach?"""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def run_new(spark: SparkSession, source: str, target: str, communities: Sequence[str] = K.INGEST_COMMUNITIES,
            columns: Sequence[str] = K.COMMENT_COLUMNS, key: str = "id") -> dict[str, int]:
    """Ingest the files that earlier runs have not seen; {"files": n, "months": n} of this run.

    ``target``/data is laid out as ``yyyy=/mm=`` and ``target``/manifest names the files that are in it. New files are
    read alone; only the months that their rows fall into are written again (dynamic partition overwrite), together
    with the rows these months have. Rows that have the same ``key`` as a new one are replaced, so a run that broke off
    between the data and the manifest is repeated without doubles. A file counts as new again when its size or time changes.
    """
    data, manifest = f"{target}/data", f"{target}/manifest"
    new = _new_files(spark, source, manifest).collect()  # one row a new file
    if not new:
        return {"files": 0, "months": 0}
    raw = tables.scan_parquet(spark, *[row["path"] for row in new])
    rows = filtered(raw, communities, columns).withColumns({"yyyy": F.year("date"), "mm": F.month("date")})
    months = [(r["yyyy"], r["mm"]) for r in rows.select("yyyy", "mm").distinct().collect()]
    if months:
        if exists(spark, data):
            touched = functools.reduce(
                lambda a, b: a | b, [F.col("yyyy").eqNullSafe(F.lit(y)) & F.col("mm").eqNullSafe(F.lit(m)) for y, m in months])
            old = tables.scan_parquet(spark, data).where(touched)
            old = old.join(rows.select(key).distinct(), key, "left_anti")
            rows = rows.unionByName(old, allowMissingColumns=True)
        rows = cut_lineage(rows)  # a month is read and written in one run
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyy", "mm").parquet(data)
    spark.createDataFrame(new).write.mode("append").parquet(manifest)
    return {"files": len(new), "months": len(months)}
