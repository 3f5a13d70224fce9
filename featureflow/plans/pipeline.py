"""Ordered steps composed into one lazy plan."""

from __future__ import annotations

import functools
import importlib
import inspect
import json
import logging
from abc import ABC, abstractmethod
from pathlib import Path

from pyspark.sql import DataFrame

from .events import PipelineSubject, RowCounter, row_counter
from .step import BasePipelineStep, check_step_class


class LoggableMixin:
    """A logger named after module and class."""

    @property
    def logger(self) -> logging.Logger:
        return logging.getLogger(f"{type(self).__module__}.{type(self).__name__}")

    def log_info(self, message: str) -> None:
        self.logger.info(message)

    def log_warning(self, message: str) -> None:
        self.logger.warning(message)


class ValidatableMixin(ABC):
    @abstractmethod
    def validate(self, df) -> bool: ...


def _params(obj) -> dict:
    """Constructor arguments of an object that keeps each as an attribute of the same name."""
    found = {}
    for name, p in inspect.signature(type(obj).__init__).parameters.items():
        if name == "self":
            continue
        if p.kind is p.VAR_KEYWORD:
            found.update(getattr(obj, name, None) or {})
        elif p.kind is not p.VAR_POSITIONAL:
            if not hasattr(obj, name):
                raise TypeError(f"{type(obj).__name__} does not keep its parameter {name!r}, so it cannot be saved")
            found[name] = getattr(obj, name)
    return found


#: Packages whose classes a manifest may name.
TRUSTED = ("featureflow",)


class SerializableMixin:
    """Saves a JSON manifest of classes and parameters.

    Loading looks classes up in the packages named by ``trusted`` and imports no other module.
    """

    def to_manifest(self) -> dict:
        return _described(self)

    def save(self, path: str | Path) -> None:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(self.to_manifest(), indent=2, default=str), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path, trusted: tuple[str, ...] = TRUSTED):
        found = from_manifest(json.loads(Path(path).read_text(encoding="utf-8")), trusted)
        if not isinstance(found, cls):
            raise TypeError(f"{path} holds a {type(found).__name__}, not a {cls.__name__}")
        return found


def _described(obj) -> dict:
    return {"class": f"{type(obj).__module__}:{type(obj).__qualname__}", "params": _params(obj)}


def from_manifest(manifest: dict, trusted: tuple[str, ...] = TRUSTED):
    module, _, name = manifest["class"].partition(":")
    if not any(module == t or module.startswith(f"{t}.") for t in trusted):
        raise TypeError(f"{manifest['class']} is in none of the packages {', '.join(trusted)}; name its package in trusted= to load it")
    kind = functools.reduce(getattr, name.split("."), importlib.import_module(module))
    if not (isinstance(kind, type) and issubclass(kind, (BasePipelineStep, SerializableMixin))):
        raise TypeError(f"{manifest['class']} is neither a step nor a pipeline")
    if issubclass(kind, Pipeline):
        return kind([from_manifest(s, trusted) for s in manifest["steps"]], metrics=manifest.get("metrics", "off"))
    return kind(**manifest["params"])


class Pipeline(LoggableMixin, SerializableMixin, ValidatableMixin, PipelineSubject):
    """Steps run in order. ``metrics`` is "off", "eager" or "observe"; see events."""

    def __init__(self, steps: list[BasePipelineStep] | None = None, metrics: str = "off"):
        self.steps: list[BasePipelineStep] = []
        self.metrics = metrics
        self.counter: RowCounter = row_counter(metrics)
        for step in steps or []:
            self.add_step(step)

    def add_step(self, step: BasePipelineStep) -> None:
        self._check(step)
        self.steps.append(step)
        for observer in self.observers:
            step.attach(observer)

    @staticmethod
    def _check(step) -> None:
        if not isinstance(step, BasePipelineStep):
            raise TypeError(f"a step must be a BasePipelineStep, not {type(step).__name__}")
        check_step_class(type(step))

    def _subjects(self) -> list[PipelineSubject]:
        """The pipeline's own observers and those of its steps."""
        return [self, *self.steps]

    def attach_observer(self, observer) -> None:
        for subject in self._subjects():
            subject.attach(observer)

    def detach_observer(self, observer) -> None:
        for subject in self._subjects():
            subject.detach(observer)

    def validate(self, df: DataFrame | None) -> bool:
        """True, or a TypeError that names the input or the step that breaks the contract."""
        if not isinstance(df, (DataFrame, type(None))):
            raise TypeError(f"a pipeline takes a DataFrame or None, not {type(df).__name__}")
        for step in self.steps:  # the list is open to all, so steps are looked at again
            self._check(step)
        return True

    def run(self, df: DataFrame | None = None) -> DataFrame | None:
        self.validate(df)
        for step in self.steps:
            self.log_info(f"Pipeline step={step.name}")
            df = step.run(df, self.counter)
        if self.steps and not isinstance(df, DataFrame):
            raise TypeError(f"the pipeline ended with a {type(df).__name__}, not a DataFrame")
        return df

    def flush(self, timeout: float = 5.0, failed: bool = False) -> None:
        """After the action, with metrics="observe": send the after_run events."""
        if hasattr(self.counter, "flush"):
            self.counter.flush(timeout, failed)

    def release(self) -> None:
        """With metrics="eager": give the persisted results back."""
        self.counter.release()

    def to_manifest(self) -> dict:
        own = f"{type(self).__module__}:{type(self).__qualname__}"
        return {"class": own, "metrics": self.metrics, "steps": [_described(s) for s in self.steps]}

    def __repr__(self) -> str:
        return f"Pipeline(steps={[s.name for s in self.steps]})"
