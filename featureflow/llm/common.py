"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import logging
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

#: ASCII white space of the contracts: blank and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and executors are threads of the driver (a local master, as in
    tests) a temporary folder is chosen and set; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="featureflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage: later stages reread the table, whichever executor is lost. The
    table is removed by :func:`discard`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _LEFT:
        atexit.register(_clean)
    _LEFT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove stored tables that nothing still to be computed reads."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path:
            _remove(table.sparkSession, path)
            _LEFT[:] = [x for x in _LEFT if x[1] != path]


#: Rows and bytes of one Arrow batch: texts are long, and a Python worker holds a batch or two.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),  # Spark's default, and what is set in its place
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b"),
}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, and bound Arrow batches.

    The session's batch settings are changed, and the change logged, only where they are Spark's defaults.
    """
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
            logger.info("%s set to %s for this session", key, ours)
    context = spark.sparkContext
    if getattr(context, "_featureflow_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    context._featureflow_shipped = True


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _LEFT:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session is already gone; nothing is left to tell
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def located(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs``, as a plain scan, and two columns that name each of its rows: file and position.

    The names hold however often the scan is read again and whatever columns it reads. A frame
    that is no plain scan is stored first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = stored(docs, "located")
    where = docs.metadataColumn("_metadata")
    return docs, [F.xxhash64(where["file_path"]), where["row_index"]]


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, told from others of their names."""
    return [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]


def crc_mod4(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 4; rows with 2 are held out of all training (null id: 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(4)), F.lit(0))


def lowest_hashes(rows: DataFrame, kind: str, most: int, tie: str) -> DataFrame:
    """The ``most`` rows of each ``kind`` with the smallest 64-bit hash ``h`` (ties: by ``tie``).

    Rows are counted per kind first (one row per kind on the driver). Of n rows, all but those
    below the hash that about ``most`` + 8 sqrt(``most``) + 32 of n are below are left out where
    they are read, so that what is ranked together does not grow with the input.
    """
    sizes = {r[kind]: r["n"] for r in rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.lit(False)
    for value, n in sizes.items():
        share = min(1.0, (most + 8 * most**0.5 + 32) / n)
        below = below | ((F.col(kind) == F.lit(value)) & (F.col("h") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))))
    rank = F.row_number().over(W.partitionBy(kind).orderBy("h", tie))
    return rows.where(below).withColumn("n", rank).where(F.col("n") <= most).drop("n")


def word_count(text: Column | str) -> Column:
    """Number of runs of non-space characters, 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def by_bytes(texts: list, most: int):
    """Cut a list of texts into runs (start, stop) of about ``most`` characters each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
