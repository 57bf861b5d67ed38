from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Names that operators use inside; tables may have columns of these names too.
CLASHING = ("row", "doc", "ident", "batch", "held", "node", "n", "blob", "path", "spans", "stats", "score", "gone", "bad_id", "words", "key", "size")


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of (doc_id, text) rows with further columns, in several partitions."""
    def make(rows, partitions=3, **more):
        df = spark.createDataFrame([(a, b) for a, b in rows], "doc_id bigint, text string")
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING], *[F.lit(v).alias(k) for k, v in more.items()]).repartition(partitions)
    return make
