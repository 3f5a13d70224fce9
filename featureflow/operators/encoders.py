"""Categorical encoders as fit / encode strategies.

A fitted mapping is a snapshot, computed once: up to ``LOCAL_ROWS`` categories of ``LOCAL_BYTES``
together become a local table, whose size is thereby proven and which is broadcast to the rows; a
larger mapping is written to the session's shared folder until the session ends and joined
without a hint, so that AQE picks the join and splits hot keys. State is kept per column.
"""

from __future__ import annotations

import logging
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_float, indicator, present, quoted, require
from ..session import scratch_table
from .aggregates import value_counts

logger = logging.getLogger(__name__)

#: Categories, and their bytes, of a mapping that is held as a local table and broadcast.
LOCAL_ROWS = 50_000
LOCAL_BYTES = 8 << 20
#: Dummy columns that one frame may get.
MOST_CATEGORIES = 5_000


class EncodingStrategy(ABC):
    """``encode`` returns a new frame; ``fit`` learns what it needs and returns the strategy."""

    @abstractmethod
    def encode(self, df: DataFrame, column: str) -> DataFrame: ...

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> EncodingStrategy:
        return self

    def __repr__(self) -> str:
        return f"{type(self).__name__}()"


def _snapshot(mapping: DataFrame) -> tuple[DataFrame, bool]:
    """(frozen mapping, whether its size is proven small)."""
    held = mapping.persist()
    try:
        head = held.limit(LOCAL_ROWS + 1).toArrow()
        if head.num_rows <= LOCAL_ROWS and head.nbytes <= LOCAL_BYTES:
            return mapping.sparkSession.createDataFrame(head, schema=mapping.schema), True
        return scratch_table(held, "mapping"), False
    finally:
        held.unpersist()


def _look_up(df: DataFrame, column: str, mapping: DataFrame, small: bool, output: str, default: Column) -> DataFrame:
    """Left lookup of ``column``; misses take ``default``; the column is dropped.

    The output replaces a column of its name in place, else it comes last.
    """
    key, code = (f"__{n}_{uuid.uuid4().hex[:8]}" for n in ("key", "code"))
    mapping = mapping.toDF(key, code)
    joined = df.join(F.broadcast(mapping) if small else mapping, present(df, column) == F.col(key), "left")
    value = F.coalesce(F.col(code), default).alias(output)
    kept = [c for c in df.columns if c != column]
    if output in kept:
        return joined.select(*[value if c == output else F.col(quoted(c)) for c in kept])
    return joined.select(*[F.col(quoted(c)) for c in kept], value)


class OneHotStrategy(EncodingStrategy):
    """0/1 byte columns ``<prefix>_<value>``, sorted by value, after the other columns.

    Missing values are 0 everywhere. The columns follow the frame given, or ``categories``
    where a fixed vocabulary is wanted, in which case no job runs.
    """

    def __init__(self, drop_first: bool = False, prefix: str | None = None, categories: list | None = None):
        self.drop_first, self.prefix, self.categories = drop_first, prefix, categories

    def encode(self, df: DataFrame, column: str) -> DataFrame:
        require(df, column)
        values = self.categories if self.categories is not None else self._vocabulary(df, column)
        values = list(values)[1:] if self.drop_first else list(values)
        names = [f"{self.prefix or column}_{v}" for v in values]
        kept = [c for c in df.columns if c != column]
        self._check_names(df, kept + names)
        dummies = [indicator(df, column, v).alias(n) for v, n in zip(values, names)]
        return df.select(*[F.col(quoted(c)) for c in kept], *dummies)

    @staticmethod
    def _vocabulary(df: DataFrame, column: str) -> list:
        found = df.select(present(df, column).alias("v")).where("v is not null").distinct().limit(MOST_CATEGORIES + 1).collect()
        if len(found) > MOST_CATEGORIES:
            raise ValueError(f"column {column!r} has more than {MOST_CATEGORIES} categories; use a frequency or target encoding")
        return sorted(r["v"] for r in found)

    @staticmethod
    def _check_names(df: DataFrame, names: list[str]) -> None:
        sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
        seen: dict[str, str] = {}
        for n in names:
            other = seen.setdefault(n if sensitive else n.lower(), n)
            if other is not n:
                raise ValueError(f"columns {other!r} and {n!r} differ by case only or clash; set spark.sql.caseSensitive or another prefix")

    def __repr__(self) -> str:
        return f"OneHotStrategy(drop_first={self.drop_first}, prefix={self.prefix!r})"


class FrequencyEncodingStrategy(EncodingStrategy):
    """``<column>_freq``: share (or count) of the value among the rows fitted; unseen 0.0.

    An unfitted column is fitted on the first frame it is encoded on.
    """

    def __init__(self, normalize: bool = True):
        self.normalize = normalize
        self._fitted: dict[str, tuple[DataFrame, bool]] = {}

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> FrequencyEncodingStrategy:
        require(df, column)
        self._fitted[column] = _snapshot(self.mapping(df, column))
        return self

    def mapping(self, df: DataFrame, column: str) -> DataFrame:
        counts = value_counts(df, column, self.normalize, "category", "encoding")
        return counts.select("category", F.col("encoding").cast("double").alias("encoding"))

    def encode(self, df: DataFrame, column: str) -> DataFrame:
        require(df, column)
        if column not in self._fitted:
            self.fit(df, column)
        mapping, small = self._fitted[column]
        return _look_up(df, column, mapping, small, f"{column}_freq", F.lit(0.0))

    def __repr__(self) -> str:
        return f"FrequencyEncodingStrategy(normalize={self.normalize}, fitted={bool(self._fitted)})"


class TargetEncodingStrategy(EncodingStrategy):
    """``<column>_target_enc``: (n * mean + m * global mean) / (n + m); unseen: global mean.

    Rows with a missing category count in the global mean only; missing targets count nowhere.
    """

    def __init__(self, smoothing: float = 10.0, target_col: str | None = None):
        self.smoothing, self.target_col = smoothing, target_col
        self._fitted: dict[str, tuple[DataFrame, bool, float | None]] = {}

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> TargetEncodingStrategy:
        target = target or self.target_col
        if not target:
            raise ValueError("a target column is needed: fit(..., target=) or target_col=")
        require(df, column, target)
        sums, small = _snapshot(self.sums(df, column, target))
        mean = self.mean(sums)
        self._fitted[column] = (self.mapping(sums, mean), small, mean)
        return self

    @staticmethod
    def sums(df: DataFrame, column: str, target: str) -> DataFrame:
        """category (NULL for the rows without one), total and number of its targets; one scan."""
        rows = df.select(present(df, column).alias("category"), as_float(df, target).alias("t"))
        return rows.groupBy("category").agg(F.sum("t").alias("total"), F.count("t").alias("n"))

    @staticmethod
    def mean(sums: DataFrame) -> float | None:
        return sums.agg(F.try_divide(F.sum("total"), F.sum("n"))).first()[0]

    def mapping(self, sums: DataFrame, mean: float | None) -> DataFrame:
        prior, weight = F.lit(mean).cast("double"), F.lit(float(self.smoothing))
        smooth = F.when(F.col("n") > 0, (F.col("total") + weight * prior) / (F.col("n") + weight))
        return sums.where("category is not null").select("category", F.coalesce(smooth, prior).alias("encoding"))

    def encode(self, df: DataFrame, column: str) -> DataFrame:
        require(df, column)
        if column not in self._fitted:
            raise RuntimeError(f"call fit() for column {column!r} before encode()")
        mapping, small, mean = self._fitted[column]
        return _look_up(df, column, mapping, small, f"{column}_target_enc", F.lit(mean).cast("double"))

    def __repr__(self) -> str:
        return f"TargetEncodingStrategy(smoothing={self.smoothing}, target_col={self.target_col!r}, fitted={bool(self._fitted)})"


class FeatureEngineer:
    """Applies a strategy that can be swapped at any time; no state is carried over."""

    def __init__(self, strategy: EncodingStrategy):
        self._strategy = strategy

    @property
    def strategy(self) -> EncodingStrategy:
        return self._strategy

    def set_strategy(self, strategy: EncodingStrategy) -> None:
        logger.info("strategy %r replaced by %r", self._strategy, strategy)
        self._strategy = strategy

    def fit(self, df: DataFrame, column: str, target: str | None = None) -> FeatureEngineer:
        self._strategy.fit(df, column, target)
        return self

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        return self._strategy.encode(df, column)

    def fit_transform(self, df: DataFrame, column: str, target: str | None = None) -> DataFrame:
        return self.fit(df, column, target).transform(df, column)

    def __repr__(self) -> str:
        return f"FeatureEngineer(strategy={self._strategy!r})"
