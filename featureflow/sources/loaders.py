"""Parquet, CSV, JSON and ORC sources as pipeline steps."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import quoted
from ..plans.step import BasePipelineStep
from .factory import register_loader
from .predicates import dnf_predicate

logger = logging.getLogger(__name__)

# Field texts that stand for a missing value in CSV.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# The types of orient="table" and what they are here; others are read as text.
TABLE_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "datetime": "timestamp", "string": "string"}


class _FileSource(BasePipelineStep):
    name = "file_source"

    def _run(self, df: DataFrame) -> DataFrame:
        result = self._read(SparkSession.active())
        logger.info("[%s] %s: %d columns", self.name, self.path, len(result.columns))
        return result


def _columnar(frame: DataFrame, columns: list[str] | None, filters) -> DataFrame:
    """The filter stands before the projection, so it may use columns that are not returned."""
    predicate = dnf_predicate(filters)
    if predicate is not None:
        frame = frame.where(predicate)
    return frame.select(*[F.col(quoted(c)) for c in columns]) if columns is not None else frame


@register_loader(".parquet")
class ParquetLoader(_FileSource):
    """``columns`` in the order asked for; ``filters`` as in :func:`dnf_predicate`.

    ``nanos_as_micros`` names TIMESTAMP(NANOS) columns, which Spark reads as bigint under
    spark.sql.legacy.parquet.nanosAsLong, to be made timestamps.
    """

    name = "parquet_loader"

    def __init__(self, path, columns: list[str] | None = None, filters=None, nanos_as_micros: list[str] | None = None):
        self.path, self.columns, self.filters, self.nanos_as_micros = str(path), columns, filters, nanos_as_micros

    def _read(self, spark: SparkSession) -> DataFrame:
        if self.nanos_as_micros:
            spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        frame = spark.read.parquet(self.path)
        for c in self.nanos_as_micros or ():
            frame = frame.withColumn(c, F.timestamp_micros(F.floor(F.col(quoted(c)) / 1000).cast("long")).cast("timestamp_ntz"))
        return _columnar(frame, self.columns, self.filters)


@register_loader(".orc")
class ORCLoader(_FileSource):
    name = "orc_loader"

    def __init__(self, path, columns: list[str] | None = None, filters=None):
        self.path, self.columns, self.filters = str(path), columns, filters

    def _read(self, spark: SparkSession) -> DataFrame:
        return _columnar(spark.read.orc(self.path), self.columns, self.filters)


@register_loader(".csv")
class CSVLoader(_FileSource):
    """Header, ``sep``, ``encoding``; missing tokens become NULL, then types are inferred.

    Inference is one aggregate over the text columns: bigint, else double, else boolean, else
    string. ``schema`` (DDL) skips it. Options are those of Spark's CSV reader; one that only a
    row-at-a-time reader has is an error.
    """

    name = "csv_loader"
    OPTIONS = frozenset("quote escape comment multiLine mode header nullValue ignoreLeadingWhiteSpace ignoreTrailingWhiteSpace lineSep maxColumns samplingRatio".split())

    def __init__(self, path, sep: str = ",", encoding: str = "utf-8", schema: str | None = None, **options):
        unknown = sorted(set(options) - self.OPTIONS)
        if unknown:
            raise ValueError(f"options without an equivalent here: {', '.join(unknown)}")
        self.path, self.sep, self.encoding, self.schema, self.options = str(path), sep, encoding, schema, options

    def _read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.options(header=True, inferSchema=False, sep=self.sep, encoding=self.encoding, **self.options)
        if self.schema:
            text = T.StructType([T.StructField(f.name, T.StringType()) for f in T.StructType.fromDDL(self.schema)])
            frame = _without_na(reader.schema(text).csv(self.path))
            return frame.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.schema)])
        frame = _without_na(reader.csv(self.path))
        return frame.select(*[F.col(quoted(c)).cast(t).alias(c) for c, t in _inferred(frame).items()])


def _without_na(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.when(~F.col(quoted(c)).isin(*NA_TOKENS), F.col(quoted(c))).alias(c) for c in frame.columns])


def _inferred(frame: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double and boolean that all values of a column fit, else string."""
    kinds = ("bigint", "double", "boolean")
    # A value fits if it survives the cast; booleans are spelt out, as 0/1 are numbers here.
    fits = {
        "bigint": lambda c: c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("bigint").isNotNull(),
        "double": lambda c: c.rlike(r"^\s*[+-]?(\d|\.\d|inf)") & c.try_cast("double").isNotNull(),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
    }
    checks = [F.bool_and(F.when(F.col(quoted(c)).isNotNull(), fits[k](F.col(quoted(c))))).alias(f"{i}_{k}") for i, c in enumerate(frame.columns) for k in kinds]
    row = frame.agg(*checks).first() if checks else {}
    return {c: next((k for k in kinds if row[f"{i}_{k}"]), "string") for i, c in enumerate(frame.columns)}


@register_loader(".json")
class JSONLoader(_FileSource):
    """``lines=True``: one object per line, else a document by ``orient``.

    Orients: records (default) is read natively. columns, index, split, values and table describe
    one document as a whole; it is parsed by Spark's JSON functions and exploded, so each file is
    one value in one task and must be smaller than 2 GB and than a task's memory. ``schema`` (DDL)
    keeps the column order, which inference sorts by name. table brings its own types and column
    order; there are no row labels here, so an index that has no name of its own is dropped.
    """

    name = "json_loader"

    def __init__(self, path, orient: str | None = None, lines: bool = False, schema: str | None = None, **options):
        known = {"records", "columns", "index", "split", "values", "table"}
        if orient is not None and orient not in known:
            raise ValueError(f"orient must be one of {sorted(known)}, not {orient!r}")
        if lines and orient not in (None, "records"):
            raise ValueError("lines=True goes with orient='records' only")
        self.path, self.orient, self.lines, self.schema = str(path), orient, lines, schema
        self.options = {k: v for k, v in options.items() if v is not None}

    def _read(self, spark: SparkSession) -> DataFrame:
        if self.lines or self.orient in (None, "records"):
            reader = spark.read.options(**self.options)
            reader = reader.schema(self.schema) if self.schema else reader
            return reader.json(self.path, multiLine=not self.lines)
        return self._document(spark)

    def _document(self, spark: SparkSession) -> DataFrame:
        whole = spark.read.text(self.path, wholetext=True).select("value")
        if self.orient == "table":
            return self._table(whole)
        cells = "map<string,string>"
        if self.orient == "columns":
            # {column: {row: value}} -> one row per row label
            by_column = whole.select(F.explode(F.from_json("value", f"map<string,{cells}>")).alias("c", "cells"))
            by_cell = by_column.select("c", F.explode("cells").alias("r", "v"))
            rows = by_cell.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("row"))
        elif self.orient == "index":
            rows = whole.select(F.explode(F.from_json("value", f"map<string,{cells}>")).alias("r", "row"))
        elif self.orient == "split":
            parsed = whole.select(F.from_json("value", "columns array<string>, data array<array<string>>").alias("d"))
            rows = parsed.select(F.col("d.columns").alias("names"), F.explode("d.data").alias("v"))
            rows = rows.select(F.map_from_arrays("names", "v").alias("row"))
        else:
            rows = whole.select(F.explode(F.from_json("value", "array<array<string>>")).alias("v"))
            numbered = F.transform("v", lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
            rows = rows.select(F.map_from_entries(numbered).alias("row"))
        if self.schema:
            fields = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(self.schema)]
        else:
            names = [r[0] for r in rows.select(F.explode(F.map_keys("row"))).distinct().collect()]  # column names only
            text = rows.select(*[F.col("row")[n].alias(n) for n in sorted(names)])
            fields = list(_inferred(text).items())
        return rows.select(*[F.col("row")[n].cast(t).alias(n) for n, t in fields])


    def _table(self, whole: DataFrame) -> DataFrame:
        shape = "schema struct<fields: array<struct<name: string, type: string>>>, data array<map<string, string>>"
        parsed = whole.select(F.from_json("value", shape).alias("d"))
        first = parsed.select("d.schema.fields").first()  # names and types of the columns
        told = [(f["name"], TABLE_TYPES.get(f["type"], "string")) for f in (first["fields"] if first else None) or () if f["name"] != "index"]
        if self.schema:
            told = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(self.schema)]
        rows = parsed.select(F.explode("d.data").alias("row"))
        return rows.select(*[F.col("row")[n].cast(t).alias(n) for n, t in told])


def json_document(rows: list[dict], orient: str = "records") -> str:
    """The text of a document in an orient; for tests and small fixtures."""
    names = list(rows[0]) if rows else []
    kinds = {bool: "boolean", int: "integer", float: "number"}
    body = {
        "records": rows,
        "columns": {n: {str(i): r[n] for i, r in enumerate(rows)} for n in names},
        "index": {str(i): r for i, r in enumerate(rows)},
        "split": {"columns": names, "index": list(range(len(rows))), "data": [[r[n] for n in names] for r in rows]},
        "values": [[r[n] for n in names] for r in rows],
        "table": {
            "schema": {"fields": [{"name": "index", "type": "integer"}, *({"name": n, "type": kinds.get(type(rows[0][n]), "string")} for n in names)], "primaryKey": ["index"]},
            "data": [{"index": i, **r} for i, r in enumerate(rows)],
        },
    }
    return json.dumps(body[orient])
