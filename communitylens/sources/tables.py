"""Scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens.session import literal_table

#: Stands for '' while a CSV is read, where it could not be told from null.
_EMPTY = "\u0001empty\u0001"


#: Parts that rows are dealt into for every split of the files: texts cost more than reading them.
PARTS_PER_SPLIT = 4


def scan_parquet(spark: SparkSession, *paths: str, requester_pays: bool = False, partitions: int | None = None) -> DataFrame:
    """One or several parquet files, folders or wildcard paths as one table.

    How finely it is split follows ``spark.sql.files.maxPartitionBytes`` and the files' row groups. ``partitions`` deals
    the rows anew, for files of few row groups whose rows cost much work each (texts): into that many parts, and into
    more where the files are so large that the scan itself makes several, so that no task's share grows with the table.
    """
    reader = spark.read
    if requester_pays:
        reader = reader.option("request-payer", "requester")
    df = reader.parquet(*paths)
    if partitions is None:
        return df
    scanned = df.rdd.getNumPartitions()  # by size; files of one row group leave most of these empty
    return df.repartition(max(partitions, PARTS_PER_SPLIT * scanned) if scanned > 1 else partitions)


def monthly_paths(template: str, months: Iterable[int], **fields: object) -> list[str]:
    """``monthly_paths(".../yyyy={year}/trips_{year}-{month:02d}.parquet", range(1, 13), year=2021)``."""
    return [template.format(month=month, **fields) for month in months]


def scan_partitions(spark: SparkSession, root: str, year: int | None = None, month: int | None = None,
                    year_column: str = "yyyy", month_column: str = "mm") -> DataFrame:
    """A folder laid out as ``yyyy=/mm=``, reduced to one year or month.

    Written as a filter so that only matching folders are listed and read while
    the partition columns stay available.
    """
    df = spark.read.parquet(root)
    if year is not None:
        df = df.where(df[year_column] == year)
    if month is not None:
        df = df.where(df[month_column] == month)
    return df


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header, as the writers of this library make it; without a schema every column is text.

    Values may hold quotes, line ends and outer blanks; nothing is null, a pair of quotes is ''.
    """
    reader = spark.read.options(
        header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        nullValue="", emptyValue=_EMPTY,
    )
    df = (reader.schema(schema) if schema else reader).csv(path)
    texts = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({name: F.when(F.col(f"`{name}`") != _EMPTY, F.col(f"`{name}`")).when(F.col(f"`{name}`") == _EMPTY, "") for name in texts})


def source_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def source_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    return literal_table(spark, rows, schema)


def run_sql(df: DataFrame, view: str, statement: str) -> DataFrame:
    """Run SQL text over ``df`` registered as ``view``."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(statement)
