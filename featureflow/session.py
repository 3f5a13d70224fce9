"""Session settings from the configuration."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="featureflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session is already gone; nothing is left to tell
            return


def session_conf(config) -> dict[str, str]:
    """Spark settings of a configuration: n_jobs, chunk_size, UTC, adaptive execution."""
    pipeline = config.pipeline
    jobs = pipeline.get("n_jobs", -1)
    return {
        "spark.master": "local[*]" if jobs in (None, -1) else f"local[{int(jobs)}]",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(int(pipeline.get("chunk_size", 100_000))),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def build_session(config, app_name: str = "featureflow", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for k, v in {**session_conf(config), **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
