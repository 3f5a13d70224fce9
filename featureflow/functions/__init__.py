"""Column expressions."""

from .exprs import as_float, fill_missing, indicator, is_missing, present, ratio, replace_value, safe_ratio

__all__ = ["as_float", "fill_missing", "indicator", "is_missing", "present", "ratio", "replace_value", "safe_ratio"]
