"""Attributes that check what they are given."""

from __future__ import annotations

from numbers import Real


class Checked:
    """A data descriptor; unset reads as None, class access gives the descriptor."""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name
        self.key = f"_{owner.__name__}__{name}"

    def __get__(self, instance, owner=None):
        return self if instance is None else instance.__dict__.get(self.key)

    def __set__(self, instance, value) -> None:
        self.check(value)
        instance.__dict__[self.key] = value

    def check(self, value) -> None:
        raise NotImplementedError


class Positive(Checked):
    """An int or float, no bool, strictly above ``min_value``."""

    def __init__(self, min_value: float = 0):
        self.min_value = min_value

    def check(self, value) -> None:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{self.name} must be a number, not {type(value).__name__}")
        if not value > self.min_value:
            raise ValueError(f"{self.name} must be greater than {self.min_value}, not {value}")


class OneOf(Checked):
    def __init__(self, *choices):
        if not choices:
            raise ValueError("OneOf needs at least one choice")
        self.choices = choices

    def check(self, value) -> None:
        if value not in self.choices:
            raise ValueError(f"{self.name} must be one of {self.choices}, not {value!r}")


class TypedAttr(Checked):
    """Exactly the type: a bool is no int."""

    def __init__(self, expected: type):
        self.expected = expected

    def check(self, value) -> None:
        if type(value) is not self.expected:
            raise TypeError(f"{self.name} must be {self.expected.__name__}, not {type(value).__name__}")


class BoundedFloat(Checked):
    """A float in the closed interval; NaN lies in none."""

    def __init__(self, low: Real, high: Real):
        if low > high:
            raise ValueError(f"the bounds are the wrong way round: {low} > {high}")
        self.low, self.high = low, high

    def check(self, value) -> None:
        if not isinstance(value, float):
            raise TypeError(f"{self.name} must be a float, not {type(value).__name__}")
        if not self.low <= value <= self.high:
            raise ValueError(f"{self.name} must lie in [{self.low}, {self.high}], not {value}")


class ModelConfig:
    learning_rate = BoundedFloat(0.0, 1.0)
    n_estimators = Positive(min_value=10)
    objective = OneOf("regression", "binary", "multiclass")
    max_depth = TypedAttr(int)

    def __init__(self, learning_rate: float, n_estimators: int, objective: str, max_depth: int):
        self.learning_rate, self.n_estimators = learning_rate, n_estimators
        self.objective, self.max_depth = objective, max_depth

    def __repr__(self) -> str:
        fields = ("learning_rate", "n_estimators", "objective", "max_depth")
        return f"ModelConfig({', '.join(f'{f}={getattr(self, f)!r}' for f in fields)})"
