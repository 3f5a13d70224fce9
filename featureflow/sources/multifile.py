"""One scan over the files of a directory."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .factory import path_exists


def scan_parquet_files(directory, pattern: str = "*.parquet", schema: str | None = None, path_column: str | None = None) -> DataFrame:
    """All matching files, not those of subfolders; ``path_column`` adds each row's file.

    Without a match the result is empty, with the columns of ``schema``.
    """
    spark = SparkSession.active()
    if not path_exists(f"{str(directory).rstrip('/')}/{pattern}"):
        return spark.createDataFrame([], schema or "")
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "false")
    frame = (reader.schema(schema) if schema else reader).parquet(str(directory))
    return frame.select("*", F.col("_metadata.file_path").alias(path_column)) if path_column else frame


@contextmanager
def open_parquet_files(directory, pattern: str = "*.parquet", schema: str | None = None) -> Iterator[DataFrame]:
    """The scan as a context; executors own the file handles and close them."""
    yield scan_parquet_files(directory, pattern, schema)
