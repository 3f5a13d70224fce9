"""Temporary casts. Frames are immutable, so the original handle never changes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import quoted, require

# Array type names and the column types they stand for.
ALIASES = {
    "float64": "double",
    "float32": "float",
    "int64": "bigint",
    "int32": "int",
    "int16": "smallint",
    "int8": "tinyint",
    "object": "string",
    "str": "string",
    "bool": "boolean",
    "datetime64[ns]": "timestamp_ntz",
}


def cast_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Casts columns in place of themselves; all names are checked first."""
    require(df, *mapping)
    return df.select(*[F.col(quoted(c)).cast(ALIASES.get(mapping[c], mapping[c])).alias(c) if c in mapping else F.col(quoted(c)) for c in df.columns])


@contextmanager
def temp_dtypes(df: DataFrame, mapping: dict[str, str]) -> Iterator[DataFrame]:
    """Yields the frame with the casts; outside the block the caller still has the original."""
    yield cast_columns(df, mapping)


def cast_roundtrip(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """There and back: what a lossy cast takes stays lost, the types are the original ones."""
    back = {c: df.schema[c].dataType.simpleString() for c in mapping if c in df.columns}
    return cast_columns(cast_columns(df, mapping), back)
