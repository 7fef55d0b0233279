"""Aggregate building blocks.

All are ordinary declarative aggregates, so Spark splits them into a
partial (map-side) and a final step: a hot key is folded to one row per
task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cond_sum(cond: Column, value: Column) -> Column:
    """``SUM(CASE WHEN cond THEN value ELSE 0 END)``: 0, not NULL, for a group
    with no matching row (NULL values are skipped as in SQL)."""
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def any_flag(cond: Column) -> Column:
    """``MAX(CASE WHEN cond THEN 1 ELSE 0 END)``: 1 when any row matches."""
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def pick_value(c: Column) -> Column:
    """A deterministic stand-in for ``ANY_VALUE``: the smallest non-NULL value."""
    return F.min(c)


def distinct_counts(df: DataFrame, key: str, flags: dict[str, Column], keep_nulls: bool = False) -> DataFrame:
    """Several ``COUNT(DISTINCT key) FILTER (flag)`` in two steps.

    Spark expands every row once per distinct aggregate; grouping by the key
    first (one shuffle, partial aggregation absorbs hot keys) and then
    summing the per-key flags needs no expansion.  NULL keys are not
    counted, as in ``COUNT(DISTINCT)``.
    """
    per_key = df.groupBy(key).agg(*[F.max(F.when(c, F.lit(1)).otherwise(F.lit(0))).alias(n) for n, c in flags.items()])
    if not keep_nulls:
        per_key = per_key.where(F.col(key).isNotNull())
    return per_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in flags])
