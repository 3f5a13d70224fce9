"""featureflow: a PySpark-native engine for tabular feature pipelines."""

from .config import Config, ConfigNew, SingletonMeta
from .operators import EncodingStrategy, FeatureEngineer, FrequencyEncodingStrategy, OneHotStrategy, TargetEncodingStrategy, cast_roundtrip, temp_dtypes
from .plans.cache import content_fingerprint, memoize_dataframe
from .plans.events import AlertObserver, LoggingObserver, MetricsObserver, PipelineSubject
from .plans.instrument import MemoryGuard, Timer, log_calls, retry, timeit
from .plans.pipeline import LoggableMixin, Pipeline, SerializableMixin, ValidatableMixin
from .plans.step import BasePipelineStep
from .sources import CSVLoader, JSONLoader, LoaderFactory, ORCLoader, ParquetLoader, open_parquet_files, register_loader
from .validation import BoundedFloat, ModelConfig, OneOf, Positive, TypedAttr

__version__ = "0.1.0"

__all__ = [
    "AlertObserver", "BasePipelineStep", "BoundedFloat", "CSVLoader", "Config", "ConfigNew", "EncodingStrategy", "FeatureEngineer",
    "FrequencyEncodingStrategy", "JSONLoader", "LoaderFactory", "LoggableMixin", "LoggingObserver", "MemoryGuard", "MetricsObserver",
    "ModelConfig", "ORCLoader", "OneHotStrategy", "OneOf", "ParquetLoader", "Pipeline", "PipelineSubject", "Positive", "SerializableMixin",
    "SingletonMeta", "TargetEncodingStrategy", "Timer", "TypedAttr", "ValidatableMixin", "cast_roundtrip", "content_fingerprint", "log_calls",
    "memoize_dataframe", "open_parquet_files", "register_loader", "retry", "temp_dtypes", "timeit",
]
