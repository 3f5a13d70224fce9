"""Scalar expressions with one notion of a missing value.

A value is missing if it is NULL or, in a floating column, NaN. Whether a column is floating is
read from the frame's schema, so every helper takes the frame and a column name and returns a
built-in expression that stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def require(df: DataFrame, *names: str) -> None:
    """KeyError for columns the frame lacks, before any job."""
    for name in names:
        if name not in df.columns:
            raise KeyError(f"column {name!r} is not in {df.columns}")


def field_type(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN made NULL."""
    c = F.col(quoted(name))
    return F.nanvl(c, F.lit(None)) if isinstance(field_type(df, name), FLOATING) else c


def as_float(df: DataFrame, name: str) -> Column:
    """The column as double, NaN made NULL."""
    require(df, name)
    return F.nanvl(F.col(quoted(name)).cast("double"), F.lit(None))


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def fill_missing(df: DataFrame, name: str, value) -> Column:
    return F.coalesce(present(df, name), F.lit(value))


def replace_value(df: DataFrame, name: str, value) -> Column:
    """NULL where the column equals ``value``."""
    require(df, name)
    return F.nullif(F.col(quoted(name)), F.lit(value))


def safe_ratio(df: DataFrame, numerator: str, denominator: str) -> Column:
    """numerator / denominator; 0.0 if either is missing, the denominator is 0, or the result is NaN."""
    require(df, numerator, denominator)
    over = F.nullif(F.col(quoted(denominator)).cast("double"), F.lit(0.0))
    return F.coalesce(F.nanvl(F.col(quoted(numerator)).cast("double") / over, F.lit(None)), F.lit(0.0))


def ratio(df: DataFrame, numerator: str, denominator: str, on_zero: str = "null") -> Column:
    """Plain division; a zero denominator gives NULL, 0.0 or, as IEEE has it, +-inf and NaN."""
    require(df, numerator, denominator)
    top, below = F.col(quoted(numerator)).cast("double"), F.col(quoted(denominator)).cast("double")
    plain = top / F.nullif(below, F.lit(0.0))
    if on_zero == "null":
        return plain
    if on_zero == "zero":
        return F.when(below == 0, F.when(top.isNotNull(), F.lit(0.0))).otherwise(plain)
    if on_zero == "ieee":
        negative = F.col(quoted(denominator)).cast("double").cast("string").startswith("-")
        sign = F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.signum(top)
        zero = F.when(top.isNull(), F.lit(None)).when(F.isnan(top) | (top == 0), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
        return F.when(below == 0, zero).otherwise(plain)
    raise ValueError(f"on_zero must be 'null', 'zero' or 'ieee', not {on_zero!r}")


def indicator(df: DataFrame, name: str, value) -> Column:
    """1 where the column equals ``value``, else 0 (missing: 0), as a byte."""
    return F.coalesce(present(df, name) == F.lit(value), F.lit(False)).cast("byte")
