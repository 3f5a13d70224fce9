"""Ready-made steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import safe_ratio
from ..operators.encoders import EncodingStrategy, FeatureEngineer
from ..operators.rows import drop_last_row, first_row
from .step import BasePipelineStep


class RatioStep(BasePipelineStep):
    """Adds ``output`` = numerator / denominator with 0.0 for everything undefined."""

    name = "ratio"

    def __init__(self, numerator: str, denominator: str, output: str):
        self.numerator, self.denominator, self.output = numerator, denominator, output

    def _run(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output, safe_ratio(df, self.numerator, self.denominator))


class TipPctStep(RatioStep):
    """The flagship column tip_pct = tip_amount / fare_amount."""

    name = "tip_pct"

    def __init__(self, numerator: str = "tip_amount", denominator: str = "fare_amount", output: str = "tip_pct"):
        super().__init__(numerator, denominator, output)


class EncodeStep(BasePipelineStep):
    """Fits a strategy on the frame it gets and encodes a column of it."""

    name = "encode"

    def __init__(self, strategy: EncodingStrategy, column: str, target: str | None = None):
        self.strategy, self.column, self.target = strategy, column, target

    def _run(self, df: DataFrame) -> DataFrame:
        return FeatureEngineer(self.strategy).fit_transform(df, self.column, self.target)


class SelectStep(BasePipelineStep):
    name = "select"

    def __init__(self, columns: list[str]):
        self.columns = columns

    def _run(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)


class DropColumnsStep(BasePipelineStep):
    name = "drop_columns"

    def __init__(self, columns: list[str]):
        self.columns = columns

    def _run(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns)


class DropLastRowStep(BasePipelineStep):
    name = "drop_last_row"

    def __init__(self, by: str):
        self.by = by

    def _run(self, df: DataFrame) -> DataFrame:
        return drop_last_row(df, self.by)


class FirstRowStep(BasePipelineStep):
    name = "first_row"

    def __init__(self, by: str):
        self.by = by

    def _run(self, df: DataFrame) -> DataFrame:
        return first_row(df, self.by)


class IdentityStep(BasePipelineStep):
    name = "identity"

    def _run(self, df: DataFrame) -> DataFrame:
        return df


class FunctionStep(BasePipelineStep):
    """Wraps any frame-to-frame function."""

    name = "function"

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        self.function = function

    def _run(self, df: DataFrame) -> DataFrame:
        return self.function(df)


class RowsSource(BasePipelineStep):
    """A source of rows held on the driver."""

    name = "rows"

    def __init__(self, rows: list, schema: str):
        self.rows, self.schema = rows, schema

    def _run(self, df: DataFrame) -> DataFrame:
        return SparkSession.active().createDataFrame(self.rows, self.schema)
