"""Counts and means that skip missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_float, present, require


def value_counts(df: DataFrame, column: str, normalize: bool = False, key: str = "value", count: str = "count") -> DataFrame:
    """One row per non-missing value with its count or, normalised, its share of all non-missing rows.

    The total is a scalar subquery, so no window gathers the groups in one task.
    """
    require(df, column)
    rows = df.select(present(df, column).alias(key)).where(F.col(key).isNotNull())
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    if not normalize:
        return groups
    total = rows.agg(F.count(F.lit(1)).cast("double")).scalar()
    return groups.select(key, (F.col(count) / total).alias(count))


def distinct_count(df: DataFrame, column: str, name: str = "n_distinct") -> DataFrame:
    """Exact number of distinct non-missing values, one row."""
    return df.agg(F.count_distinct(present(df, column)).alias(name))


def global_mean(df: DataFrame, column: str, name: str = "mean") -> DataFrame:
    """Mean of the non-missing values over all rows, one row."""
    return df.agg(F.avg(as_float(df, column)).alias(name))
