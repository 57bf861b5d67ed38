"""Collects queries and the SQL that checks them."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked."""
    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark: SparkSession, root: str) -> DataFrame:
            _local_folder(spark)
            return function(spark, root)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def _local_folder(spark: SparkSession) -> None:
    """One machine without ``spark.checkpoint.dir`` gets a folder for its intermediate results; a cluster must name one."""
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) and re.fullmatch(r"local(\[.*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="communitylens-"))


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Float sums depend on order in their last bits; both sides round them alike."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
