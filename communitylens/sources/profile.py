"""What a table contains, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens import constants as K

_CUT = 100


def _cut(text, width: int):
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def schema_profile(df: DataFrame, approx_distinct: bool = True) -> DataFrame:
    """One row per column: position, name, type, rows, nulls, smallest and largest value (cut at 100)."""
    ordered = [f for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(ordered):
        c = F.col(f"`{field.name}`")
        measures.append(F.count(c).alias(f"n{i}"))
        measures.append(F.min(c).cast("string").alias(f"lo{i}"))
        measures.append(F.max(c).cast("string").alias(f"hi{i}"))
        if approx_distinct:
            measures.append(F.approx_count_distinct(c).alias(f"d{i}"))
    entries = []
    for i, field in enumerate(ordered):
        parts = [
            F.lit(i + 1).alias("position"), F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"), F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            _cut(F.col(f"lo{i}"), _CUT).alias("smallest"), _cut(F.col(f"hi{i}"), _CUT).alias("largest"),
        ]
        if approx_distinct:
            parts.append(F.col(f"d{i}").alias("approx_distinct"))
        entries.append(F.struct(*parts))
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in wanted order."""
    return [c for c in wanted if c in df.columns]


def of_interest(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a comment or submission table that its profile shows, those that exist."""
    return df.select(available(df, {"comments": K.PROFILE_COMMENT_COLUMNS, "submissions": K.PROFILE_SUBMISSION_COLUMNS}[kind]))


def show_sample(df: DataFrame, n: int = 3, columns: Sequence[str] | None = None, width: int = _CUT,
                order_by: Sequence[str] = ()) -> DataFrame:
    """n rows of the named columns that exist, long text cut."""
    names = available(df, columns) if columns else df.columns
    kinds = dict(df.dtypes)
    shown = df.orderBy(*order_by) if order_by else df
    return shown.limit(n).select(
        *[_cut(F.col(c), width).alias(c) if kinds[c] == "string" else F.col(c) for c in names]
    )
