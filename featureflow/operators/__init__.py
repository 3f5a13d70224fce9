"""Table operators: encoders, ordered rows, casts, counts."""

from .aggregates import distinct_count, global_mean, value_counts
from .casts import cast_roundtrip, temp_dtypes
from .encoders import EncodingStrategy, FeatureEngineer, FrequencyEncodingStrategy, OneHotStrategy, TargetEncodingStrategy
from .rows import drop_last_row, first_row

__all__ = [
    "EncodingStrategy", "FeatureEngineer", "FrequencyEncodingStrategy", "OneHotStrategy", "TargetEncodingStrategy",
    "cast_roundtrip", "distinct_count", "drop_last_row", "first_row", "global_mean", "temp_dtypes", "value_counts",
]
