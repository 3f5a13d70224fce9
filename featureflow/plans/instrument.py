"""Timing, call logs, retries and a memory guard around driver-side code."""

from __future__ import annotations

import functools
import inspect
import logging
import threading
import time

from pyspark.sql import SparkSession

logger = logging.getLogger(__name__)

SECONDS = {"s": 1.0, "ms": 1e3, "us": 1e6}


def _check_unit(unit: str) -> None:
    if unit not in SECONDS:
        raise ValueError(f"unit must be one of {sorted(SECONDS)}, not {unit!r}")


def timeit(function=None, *, unit: str = "ms"):
    """Logs how long a call took. On a lazy frame that is plan building, unless an action runs."""
    _check_unit(unit)

    def wrap(f):
        @functools.wraps(f)
        def timed(*args, **kwargs):
            began = time.perf_counter()
            result = f(*args, **kwargs)
            logger.info("[timeit] %s took %.3f %s", f.__name__, (time.perf_counter() - began) * SECONDS[unit], unit)
            return result

        return timed

    return wrap(function) if function is not None else wrap


def log_calls(function=None, *, level: str = "INFO", log_args: bool = True):
    """Logs each call before it happens; a frame shows as its schema, without a job."""
    number = logging.getLevelNamesMapping().get(level.upper())
    if number is None:
        raise ValueError(f"unknown log level {level!r}")

    def wrap(f):
        signature = inspect.signature(f)

        @functools.wraps(f)
        def logged(*args, **kwargs):
            shown = ""
            if log_args:
                bound = signature.bind(*args, **kwargs)
                bound.apply_defaults()
                shown = ", ".join(f"{k}={v!r}" for k, v in bound.arguments.items())
            logger.log(number, "[log_calls] %s(%s)", f.__name__, shown)
            return f(*args, **kwargs)

        return logged

    return wrap(function) if function is not None else wrap


def retry(max_attempts: int = 3, backoff: float = 2.0, exceptions: tuple[type[BaseException], ...] = (IOError,)):
    """Repeats a driver-side action; waits backoff^0, backoff^1 ... seconds between attempts."""
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    if backoff <= 0:
        raise ValueError("backoff must be positive")

    def wrap(f):
        @functools.wraps(f)
        def tried(*args, **kwargs):
            for attempt in range(max_attempts):
                try:
                    return f(*args, **kwargs)
                except exceptions as error:
                    if attempt == max_attempts - 1:
                        raise
                    pause = backoff**attempt
                    logger.warning("[retry] %s failed (%r), attempt %d of %d, next in %.1f s", f.__name__, error, attempt + 1, max_attempts, pause)
                    time.sleep(pause)

        return tried

    return wrap


class Timer:
    """Logs the time of a block, also when it raises."""

    def __init__(self, label: str = "block", unit: str = "ms"):
        _check_unit(unit)
        self.label, self.unit, self.elapsed = label, unit, None

    def __enter__(self):
        self._began = time.perf_counter()
        return self

    def __exit__(self, *exc_info):
        self.elapsed = (time.perf_counter() - self._began) * SECONDS[self.unit]
        logger.info("[Timer] %s %.3f %s", self.label, self.elapsed, self.unit)
        return False


class MemoryGuard:
    """MemoryError if the driver JVM's used heap rises by more than ``threshold_mb`` in the block.

    Python's own heap says nothing about Spark, so the guard samples the JVM in a thread and
    keeps the peak; it ends with the block and other guards do not disturb it. Executors are
    bounded by spark.executor.memory and spark.memory.*.
    """

    def __init__(self, threshold_mb: float = 2000.0, interval: float = 0.05):
        self.threshold_mb, self.interval, self.peak_mb = threshold_mb, interval, 0.0

    @staticmethod
    def used_mb() -> float:
        runtime = SparkSession.active().sparkContext._jvm.java.lang.Runtime.getRuntime()
        return (runtime.totalMemory() - runtime.freeMemory()) / 2**20

    def _sample(self) -> None:
        self.peak_mb = max(self.peak_mb, self.used_mb() - self._start)

    def _watch(self) -> None:
        while not self._stop.wait(self.interval):
            self._sample()

    def __enter__(self):
        self.peak_mb, self._start, self._stop = 0.0, self.used_mb(), threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, *rest):
        self._stop.set()
        self._thread.join()
        self._sample()
        if kind is None and self.peak_mb > self.threshold_mb:
            raise MemoryError(f"the block took {self.peak_mb:.1f} MB of driver heap, more than {self.threshold_mb:.1f} MB")
        return False
