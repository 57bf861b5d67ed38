"""Writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


#: Quotes are doubled, blanks and line ends are kept, a null is nothing between commas and '' is a pair of quotes.
CSV = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "nullValue": "", "emptyValue": '""',
}


def write_csv(df: DataFrame, folder: str) -> None:
    """As many CSV part files with headers as the table has partitions."""
    df.write.mode("overwrite").options(**CSV).csv(folder)


def write_csv_single(df: DataFrame, folder: str, sort_by: Sequence[Column | str] = ()) -> None:
    """One part file with a header, its rows in the given order.

    For finished report tables only. ``repartition(1)`` rather than ``coalesce(1)``:
    the work behind the table keeps its parallelism and only its few result rows
    go to one task, which sorts them.
    """
    single = df.repartition(1)
    if sort_by:
        single = single.sortWithinPartitions(*sort_by)
    write_csv(single, folder)


def write_csv_named(df: DataFrame, path: str, sort_by: Sequence[Column | str] = ()) -> None:
    """One CSV file called exactly ``path``, on any file system Spark can reach."""
    folder = path + ".parts"
    write_csv_single(df, folder, sort_by)
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = system.globStatus(hadoop.Path(folder + "/part-*.csv"))
    if len(parts) != 1:
        raise IOError(f"expected one part file in {folder}, found {len(parts)}")
    system.delete(target, False)
    if not system.rename(parts[0].getPath(), target):
        raise IOError(f"could not move the part file to {path}")
    system.delete(hadoop.Path(folder), True)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_tables(tables: Mapping[str, DataFrame], folder: str,
                 sort_by: Mapping[str, Sequence[Column | str]] | None = None) -> None:
    """Every report table as ``folder/<name>.csv``."""
    for name, table in tables.items():
        write_csv_named(table, f"{folder}/{name}.csv", (sort_by or {}).get(name, ()))


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)
