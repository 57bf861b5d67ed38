"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; a component is named by its smallest node.

    Each round ties a node's larger neighbours to its smallest one, then its smaller neighbours; only
    minima are gathered per node, so a node with very many links needs no task that holds them.
    Links of a node with itself, repeated and null links do not matter.
    """
    links = cut_lineage(
        edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("high") != F.col("low"))).distinct()
    )
    seen = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if state == seen:
            break
        seen = state
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        large = (
            both.filter("low > high").join(least, F.col("high") == F.col("node"))
            .select(F.col("low").alias("high"), F.least("least", "high").alias("low")).distinct()
        )
        least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        small = large.join(least, F.col("high") == F.col("node")).select(
            F.explode(F.array(F.col("high"), F.col("low"))).alias("high"), F.col("least").alias("low"))
        links = cut_lineage(small.filter("high != low").distinct())
    return links.select(F.explode(F.array("high", "low")).alias("node"), F.col("low").alias("component")).distinct()
