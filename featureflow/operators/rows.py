"""Positional rows by an explicit order key, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import quoted, require


def _key(df: DataFrame, by: str | list[str]):
    names = [by] if isinstance(by, str) else list(by)
    require(df, *names)
    return F.struct(*[F.col(quoted(n)) for n in names])


def drop_last_row(df: DataFrame, by: str | list[str]) -> DataFrame:
    """All rows but the last by a unique key; NULL keys come first; empty stays empty.

    The largest key is one aggregate, compared as a scalar, and so is the number of rows that
    have it; nothing is shuffled by key. A key shared by several last rows is an error when the
    plan runs, as it would name no single row.
    """
    key = _key(df, by)
    last = df.agg(F.max(key)).scalar()
    many = df.where(key.eqNullSafe(last)).agg(F.count(F.lit(1))).scalar() > 1
    unique = F.when(many, F.raise_error(F.lit(f"the order key {by!r} is not unique at its end")).cast("boolean")).otherwise(F.lit(True))
    return df.where(~key.eqNullSafe(last) & unique)


def first_row(df: DataFrame, by: str | list[str]) -> DataFrame:
    """The row with the smallest key (NULL first), an arbitrary one of several; empty stays empty."""
    names = [by] if isinstance(by, str) else list(by)
    require(df, *names)
    return df.orderBy(*[F.col(quoted(n)) for n in names]).limit(1)
