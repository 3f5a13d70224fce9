"""The step contract: a validated class whose hook maps a frame to a frame."""

from __future__ import annotations

import inspect
import time
import typing

from pyspark.sql import DataFrame

from .events import PipelineSubject, RowCounter


def check_step_class(cls: type) -> None:
    """Raises TypeError for a step class that breaks the contract."""
    if "run" in vars(cls):
        raise TypeError(f"{cls.__name__} may not override run(); implement _run(self, df)")
    if not isinstance(getattr(cls, "name", None), str):
        raise TypeError(f"{cls.__name__} needs a class attribute `name` of type str")
    hook = getattr(cls, "_run", None)
    if not callable(hook):
        raise TypeError(f"{cls.__name__} needs a callable _run(self, df)")
    signature = inspect.signature(hook)
    if list(signature.parameters) != ["self", "df"]:
        raise TypeError(f"{cls.__name__}._run must take exactly (self, df), not {signature}")
    try:
        hints = typing.get_type_hints(hook)
    except NameError as unknown:
        raise TypeError(f"{cls.__name__}._run has an annotation that cannot be resolved: {unknown}") from unknown
    for what, key in (("parameter df", "df"), ("return value", "return")):
        if hints.get(key) is not DataFrame:
            raise TypeError(f"{cls.__name__}._run: the {what} must be annotated pyspark.sql.DataFrame")


class BasePipelineStep(PipelineSubject):
    """Subclasses set ``name`` and implement ``_run``; ``run`` adds events and checks."""

    name: str

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        check_step_class(cls)

    def run(self, df: DataFrame | None = None, counter: RowCounter | None = None) -> DataFrame:
        """before_run, the hook, after_run; run_error and the exception itself on failure.

        Without a counter no job is run and the row counts are None.
        """
        counter = counter or RowCounter()
        base = {"step": self.name, "step_class": type(self).__name__}
        rows_in = counter.incoming(df)
        self.notify({"event": "before_run", **base, "rows_in": rows_in})
        began = time.perf_counter()
        try:
            result = self._run(df)
            if not isinstance(result, DataFrame):
                raise TypeError(f"step {self.name!r} must return a DataFrame, not {type(result).__name__}")
            result, rows_out = counter.outgoing(result)
        except Exception as error:
            self.notify({"event": "run_error", **base, "rows_in": rows_in, "duration_ms": (time.perf_counter() - began) * 1000, "error": repr(error)})
            raise
        done = {"event": "after_run", **base, "rows_in": rows_in, "rows_out": rows_out, "duration_ms": (time.perf_counter() - began) * 1000}
        if not counter.deferred(self, done):
            self.notify(done)
        return result

    def _run(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} does not implement _run")

    def __repr__(self) -> str:
        return f"{type(self).__name__}(name={getattr(self, 'name', None)!r})"
