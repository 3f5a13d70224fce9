"""Sinks: directories of part files, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.step import BasePipelineStep


def write_parquet(df: DataFrame, path, mode: str = "overwrite", partition_by: list[str] | None = None, files: int | None = None) -> str:
    """``files`` coalesces a small result; leave it None for a large one."""
    writer = (df.coalesce(files) if files else df).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(str(path))
    return str(path)


def write_csv(df: DataFrame, path, sep: str = ",", mode: str = "overwrite") -> str:
    df.write.mode(mode).csv(str(path), header=True, sep=sep)
    return str(path)


def write_json(df: DataFrame, path, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(str(path))
    return str(path)


class ParquetSink(BasePipelineStep):
    """Writes what it gets and hands on the written table."""

    name = "parquet_sink"

    def __init__(self, path, mode: str = "overwrite"):
        self.path, self.mode = str(path), mode

    def _run(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.read.schema(df.schema).parquet(write_parquet(df, self.path, self.mode))


class CSVSink(BasePipelineStep):
    name = "csv_sink"

    def __init__(self, path, sep: str = ",", mode: str = "overwrite"):
        self.path, self.sep, self.mode = str(path), sep, mode

    def _run(self, df: DataFrame) -> DataFrame:
        write_csv(df, self.path, self.sep, self.mode)
        return df


class JSONSink(BasePipelineStep):
    name = "json_sink"

    def __init__(self, path, mode: str = "overwrite"):
        self.path, self.mode = str(path), mode

    def _run(self, df: DataFrame) -> DataFrame:
        write_json(df, self.path, self.mode)
        return df
