"""Session helpers: small literal tables and durable intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW_TYPES = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32()}


def local_session(folder: str, app: str = "communitylens", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; ``folder`` keeps its intermediate results."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", folder)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A table of constants, e.g. ``literal_table(spark, [("a", 1)], "name string, n int")``.

    Built from Arrow so that Spark knows its exact size: whether a join broadcasts
    it is then decided by ``spark.sql.autoBroadcastJoinThreshold``, never by a hint.
    """
    fields = [field.strip().rsplit(" ", 1) for field in schema.split(",")]
    rows = list(rows)
    columns = {
        name: pa.array([row[i] for row in rows], type=_ARROW_TYPES[kind])
        for i, (name, kind) in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(columns))


def in_parts(df: DataFrame, parts: int | None) -> DataFrame:
    """``df`` read in at most so many parts. For iterative fits over small stored tables, where every part costs a sum of the
    model's size in each iteration; leave ``parts`` out for large tables."""
    return df if parts is None else df.coalesce(parts)


def parts_for(df: DataFrame, rows: int) -> int:
    """How many parts of about ``rows`` rows a stored table fills: the ``parts`` of a fit whose tasks must not grow with it."""
    return max(1, -(-df.count() // rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or set before by ``setCheckpointDir``.

    There is no fallback: where neither is set, the caller hears of it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    folder = named or context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the action that wrote them ends, not when the driver happens to collect its garbage.

    For work in several passes, each of which leaves a stored table or a small result and needs nothing of the last one's files.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably so that reusing it never repeats the work behind it.

    Meant for results that are small but expensive (a cube, fitted features): a
    lost executor then costs a re-read of the checkpoint, not a re-run.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it again: for tables too large for an uncompressed checkpoint.

    The files stay until the folder is cleaned.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
