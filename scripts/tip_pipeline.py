"""Flagship job: read a table of trips, add tip_pct, write Parquet.

python scripts/tip_pipeline.py INPUT OUTPUT [--config FILE] [--log FILE] [--metrics off|eager|observe]
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from featureflow import Config, LoaderFactory, LoggingObserver, MetricsObserver, Pipeline, Timer  # noqa: E402
from featureflow.plans.steps import TipPctStep  # noqa: E402
from featureflow.session import build_session  # noqa: E402
from featureflow.sources import write_parquet  # noqa: E402


def main(args: list[str] | None = None) -> list[dict]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--config")
    parser.add_argument("--log", default="pipeline.log")
    parser.add_argument("--metrics", default="observe")
    given = parser.parse_args(args)
    build_session(Config(given.config))
    pipeline = Pipeline([LoaderFactory.create(given.input), TipPctStep()], metrics=given.metrics)
    metrics = MetricsObserver()
    pipeline.attach_observer(LoggingObserver(given.log))
    pipeline.attach_observer(metrics)
    with Timer("pipeline"):
        try:
            write_parquet(pipeline.run(None), given.output)
        except Exception:
            pipeline.flush(failed=True)
            raise
        pipeline.flush()
    pipeline.release()
    return metrics.records


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    for record in main():
        print(record)
