"""Query catalogue of the tabular operators: Spark plans and the SQL that must agree."""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config

from ..functions.exprs import fill_missing, ratio, replace_value
from ..operators import aggregates, casts, rows
from ..operators.encoders import FeatureEngineer, FrequencyEncodingStrategy, OneHotStrategy, TargetEncodingStrategy
from ..session import scratch_path, session_conf
from ..sources import CSVLoader, JSONLoader, LoaderFactory, ParquetLoader, register_loader, scan_parquet_files, write_csv, write_json, write_parquet
from ..sources.loaders import json_document
from ..streaming import run_stream
from ..validation import ModelConfig
from .cache import content_fingerprint, memoize_dataframe
from .events import AlertObserver, LoggingObserver, MetricsObserver
from .instrument import retry
from .pipeline import Pipeline
from .step import BasePipelineStep
from .steps import DropColumnsStep, DropLastRowStep, EncodeStep, FirstRowStep, FunctionStep, IdentityStep, RatioStep, RowsSource, SelectStep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, filters=None) -> DataFrame:
    return ParquetLoader(f"{sf_dir}/{name}.parquet", columns, filters).run(None)


# Scans, sources, sinks -----------------------------------------------------------------------


@query("SELECT o_totalprice, o_orderkey FROM orders")
def scan_projection(spark, sf_dir):
    return load(spark, sf_dir, "orders", ["o_totalprice", "o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus IN ('F', 'O') AND o_totalprice > 1000) OR o_orderkey = 5")
def scan_filter_dnf(spark, sf_dir):
    filters = [[("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", ">", 1000)], [("o_orderkey", "==", 5)]]
    return load(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], filters)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'P') AND o_totalprice <= 200000 AND o_orderkey <> 7")
def scan_filter_conjunction(spark, sf_dir):
    return load(spark, sf_dir, "orders", ["o_orderkey"], [("o_orderstatus", "not in", ["O", "P"]), ("o_totalprice", "<=", 200000), ("o_orderkey", "!=", 7)])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def scan_filter_unprojected(spark, sf_dir):
    return load(spark, sf_dir, "orders", ["o_orderkey"], [("o_orderstatus", "=", "F")])


@query("SELECT * FROM region")
def factory_parquet(spark, sf_dir):
    return LoaderFactory.create(f"{sf_dir}/region.parquet").run(None)


_NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("SELECT * FROM nation")
def csv_roundtrip(spark, sf_dir):
    return CSVLoader(write_csv(load(spark, sf_dir, "nation"), scratch_path(spark, "csv")), schema=_NATION).run(None)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def csv_inferred(spark, sf_dir):
    return CSVLoader(write_csv(load(spark, sf_dir, "nation"), scratch_path(spark, "csv"))).run(None)


@query("SELECT * FROM nation")
def csv_custom_sep(spark, sf_dir):
    return CSVLoader(write_csv(load(spark, sf_dir, "nation"), scratch_path(spark, "csv"), sep=";"), sep=";", schema=_NATION).run(None)


@query("SELECT * FROM nation")
def json_lines(spark, sf_dir):
    return JSONLoader(write_json(load(spark, sf_dir, "nation"), scratch_path(spark, "json")), lines=True, schema=_NATION).run(None)


@query("SELECT * FROM nation")
def json_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    table = load(spark, sf_dir, "nation")
    # One document: the 25 rows of nation as an array of records.
    table.agg(F.to_json(F.collect_list(F.struct(*table.columns)))).coalesce(1).write.text(path)
    return JSONLoader(path, orient="records", schema=_NATION).run(None)


def _json_orient(spark, sf_dir, orient: str, schema: str | None = _NATION) -> DataFrame:
    """The 25 nations as one document of an orient, written by a task and read back."""
    rows = [r.asDict() for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    path = scratch_path(spark, f"json-{orient}")
    spark.createDataFrame([(json_document(rows, orient),)], "value string").coalesce(1).write.text(path)
    return JSONLoader(path, orient=orient, schema=schema).run(None)


@query("SELECT * FROM nation")
def json_columns(spark, sf_dir):
    return _json_orient(spark, sf_dir, "columns")


@query("SELECT * FROM nation")
def json_index(spark, sf_dir):
    return _json_orient(spark, sf_dir, "index")


@query("SELECT * FROM nation")
def json_split(spark, sf_dir):
    return _json_orient(spark, sf_dir, "split")


@query('SELECT CAST(n_nationkey AS BIGINT) AS "0", n_name AS "1", CAST(n_regionkey AS BIGINT) AS "2" FROM nation')
def json_values(spark, sf_dir):
    return _json_orient(spark, sf_dir, "values", None)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def json_table(spark, sf_dir):
    return _json_orient(spark, sf_dir, "table", None)


@query("SELECT * FROM customer")
def orc_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orc") + ".orc"
    load(spark, sf_dir, "customer").write.orc(path)
    return LoaderFactory.create(path).run(None)


class BinaryRowsLoader(BasePipelineStep):
    """A source registered by a user: files of one record each."""

    name = "binary_rows"

    def __init__(self, path):
        self.path = str(path)

    def _run(self, df: DataFrame) -> DataFrame:
        files = SparkSession.active().read.format("binaryFile").load(self.path)
        return files.select(F.col("content").cast("string").alias("line"))


@query("SELECT CAST(n_nationkey AS VARCHAR) || ' ' || n_name || chr(10) AS line FROM nation")
def custom_source(spark, sf_dir):
    register_loader(".record")(BinaryRowsLoader)
    path = scratch_path(spark, "records") + ".record"
    lines = load(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(" ", "n_nationkey", "n_name").alias("value"))
    lines.repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return LoaderFactory.create(path).run(None)


@query("SELECT * FROM (VALUES ('.csv', 'CSVLoader'), ('.json', 'JSONLoader'), ('.orc', 'ORCLoader'), ('.parquet', 'ParquetLoader')) t(extension, loader)")
def loader_registry(spark, sf_dir):
    known = LoaderFactory.registry()
    rows = [(e, known[e]) for e in LoaderFactory.supported_extensions() if e in (".csv", ".json", ".orc", ".parquet")]
    return spark.createDataFrame(rows, "extension string, loader string")


@query("SELECT * FROM (VALUES (1, 10.0::DOUBLE, 0.1::DOUBLE), (2, 20.0::DOUBLE, 0.15::DOUBLE)) t(id, fare_amount, tip_pct)")
def in_memory_source(spark, sf_dir):
    source = RowsSource([(1, 10.0, 1.0), (2, 20.0, 3.0)], "id int, fare_amount double, tip_amount double")
    return Pipeline([source, RatioStep("tip_amount", "fare_amount", "tip_pct"), DropColumnsStep(["tip_amount"])]).run(None)


@query("SELECT * FROM customer")
def parquet_multi_file(spark, sf_dir):
    path = scratch_path(spark, "files")
    load(spark, sf_dir, "customer").repartition(4, "c_custkey").write.parquet(path)
    return scan_parquet_files(path)


@query("SELECT c_mktsegment, count(*) AS n_rows FROM customer GROUP BY 1")
def parquet_partitioned(spark, sf_dir):
    path = write_parquet(load(spark, sf_dir, "customer"), scratch_path(spark, "by-segment"), partition_by=["c_mktsegment"])
    return ParquetLoader(path).run(None).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT * FROM customer")
def parquet_sink_roundtrip(spark, sf_dir):
    return ParquetLoader(write_parquet(load(spark, sf_dir, "customer"), scratch_path(spark, "sink"))).run(None)


# Projections and expressions -----------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount, coalesce(l_tax / nullif(l_discount, 0), 0.0) AS tip_pct FROM lineitem")
def safe_ratio(spark, sf_dir):
    """Flagship: scan, select, ratio as a pipeline of steps, one lazy plan."""
    columns = ["l_orderkey", "l_linenumber", "l_tax", "l_discount"]
    steps = [ParquetLoader(f"{sf_dir}/lineitem.parquet", columns), RatioStep("l_tax", "l_discount", "tip_pct")]
    return Pipeline(steps).run(None)


@query("SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS raw_ratio FROM lineitem")
def raw_ratio_null(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", ratio(df, "l_tax", "l_discount").alias("raw_ratio"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS raw_ratio FROM lineitem")
def raw_ratio_zero(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", ratio(df, "l_tax", "l_discount", "zero").alias("raw_ratio"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN CAST(l_tax / l_discount AS VARCHAR) IS NOT NULL ELSE true END AS is_set, "
    "l_discount = 0 AND l_tax > 0 AS is_infinite, l_discount = 0 AND l_tax = 0 AS is_undefined FROM lineitem"
)
def raw_ratio_ieee(spark, sf_dir):
    """The three kinds of IEEE results, as flags that any comparison can hold."""
    df = load(spark, sf_dir, "lineitem")
    value = ratio(df, "l_tax", "l_discount", "ieee")
    return df.select("l_orderkey", "l_linenumber", value.isNotNull().alias("is_set"), (value == float("inf")).alias("is_infinite"), F.isnan(value).alias("is_undefined"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS replaced, coalesce(nullif(l_discount, 0), -1.0) AS filled FROM lineitem")
def replace_and_fill(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    df = df.select("l_orderkey", "l_linenumber", replace_value(df, "l_discount", 0.0).alias("replaced"))
    return df.withColumn("filled", fill_missing(df, "replaced", -1.0))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def identity_drop(spark, sf_dir):
    return Pipeline([IdentityStep()]).run(load(spark, sf_dir, "orders")).drop("o_orderpriority")


# Aggregates ----------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return aggregates.value_counts(load(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT o_orderpriority AS value, count(*) / sum(count(*)) OVER () AS count FROM orders GROUP BY 1")
def value_counts_norm(spark, sf_dir):
    return aggregates.value_counts(load(spark, sf_dir, "orders"), "o_orderpriority", normalize=True)


@query("SELECT count(DISTINCT o_custkey) AS n_distinct FROM orders")
def nunique(spark, sf_dir):
    return aggregates.distinct_count(load(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT round(avg(o_totalprice), 6) AS mean FROM orders")
def global_mean(spark, sf_dir):
    return aggregates.global_mean(load(spark, sf_dir, "orders"), "o_totalprice").select(F.round("mean", 6).alias("mean"))


@query("SELECT count(*) AS n_rows, sum(l_quantity) AS sum_quantity FROM lineitem")
def row_count_and_sum(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_quantity"))


# Encoders ------------------------------------------------------------------------------------

_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _dummies(column: str, values, prefix: str, hole: str = "") -> str:
    return ", ".join(f"CAST(coalesce({hole or column} = '{v}', false) AS TINYINT) AS \"{prefix}_{v}\"" for v in values)


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, {_dummies('o_orderstatus', 'FOP', 'o_orderstatus')} FROM orders")
def one_hot(spark, sf_dir):
    return OneHotStrategy().encode(load(spark, sf_dir, "orders", _ORDER), "o_orderstatus")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, {_dummies('o_orderstatus', 'OP', 'o_orderstatus')} FROM orders")
def one_hot_drop_first(spark, sf_dir):
    return OneHotStrategy(drop_first=True).encode(load(spark, sf_dir, "orders", _ORDER), "o_orderstatus")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, {_dummies('o_orderstatus', 'FOP', 'st')} FROM orders")
def one_hot_prefix(spark, sf_dir):
    return OneHotStrategy(prefix="st").encode(load(spark, sf_dir, "orders", _ORDER), "o_orderstatus")


@query(f"SELECT l_orderkey, l_quantity, {', '.join(f'CAST(l_linenumber = {i} AS TINYINT) AS l_linenumber_{i}' for i in range(1, 8))} FROM lineitem")
def one_hot_numbers(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_linenumber"])
    return OneHotStrategy(categories=list(range(1, 8))).encode(df, "l_linenumber")


_HOLED = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {} END"


@query(f"SELECT o_orderkey, {_dummies('', 'FOP', 'status', '(' + _HOLED.format('o_orderstatus') + ')')} FROM orders")
def one_hot_nulls(spark, sf_dir):
    df = load(spark, sf_dir, "orders").selectExpr("o_orderkey", _HOLED.format("o_orderstatus") + " AS status")
    return OneHotStrategy().encode(df, "status")


_KEEP = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query(
    f"SELECT {_KEEP}, coalesce(f, 0.0) AS o_orderpriority_freq FROM orders LEFT JOIN "
    "(SELECT o_orderpriority AS k, count(*) / sum(count(*)) OVER () AS f FROM orders GROUP BY 1) ON o_orderpriority = k"
)
def freq_encode(spark, sf_dir):
    return FeatureEngineer(FrequencyEncodingStrategy()).fit_transform(load(spark, sf_dir, "orders", _ORDER), "o_orderpriority")


@query(
    f"SELECT {_KEEP}, CAST(f AS DOUBLE) AS o_orderpriority_freq FROM orders LEFT JOIN "
    "(SELECT o_orderpriority AS k, count(*) AS f FROM orders GROUP BY 1) ON o_orderpriority = k"
)
def freq_encode_counts(spark, sf_dir):
    return FrequencyEncodingStrategy(normalize=False).encode(load(spark, sf_dir, "orders", _ORDER), "o_orderpriority")


@query(
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, coalesce(f, 0.0) AS o_custkey_freq FROM orders LEFT JOIN "
    "(SELECT o_custkey AS k, count(*) / sum(count(*)) OVER () AS f FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON o_custkey = k"
)
def freq_encode_unseen(spark, sf_dir):
    df = load(spark, sf_dir, "orders", _ORDER)
    return FrequencyEncodingStrategy().fit(df.where("o_orderkey % 2 = 0"), "o_custkey").encode(df, "o_custkey")


@query(
    f"WITH o AS (SELECT o_orderkey, {_HOLED.format('o_orderpriority')} AS priority FROM orders) "
    "SELECT o_orderkey, coalesce(f, 0.0) AS priority_freq FROM o LEFT JOIN "
    "(SELECT priority AS k, count(*) / sum(count(*)) OVER () AS f FROM o WHERE priority IS NOT NULL GROUP BY 1) ON priority = k"
)
def freq_encode_nulls(spark, sf_dir):
    df = load(spark, sf_dir, "orders").selectExpr("o_orderkey", _HOLED.format("o_orderpriority") + " AS priority")
    return FrequencyEncodingStrategy().encode(df, "priority")


@query(
    "SELECT l_orderkey, l_quantity, f AS l_partkey_freq FROM lineitem JOIN "
    "(SELECT l_partkey AS k, count(*) / sum(count(*)) OVER () AS f FROM lineitem GROUP BY 1) ON l_partkey = k"
)
def freq_encode_high_cardinality(spark, sf_dir):
    return FrequencyEncodingStrategy().encode(load(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_partkey"]), "l_partkey")


def _target_sql(m: str, key: str = "o_orderpriority", keep: str = "o_orderkey, o_custkey, o_orderstatus, o_totalprice", where: str = "") -> str:
    return (
        f"WITH g AS (SELECT avg(o_totalprice) AS g FROM orders {where}), e AS (SELECT {key} AS k, "
        f"(count(o_totalprice) * avg(o_totalprice) + {m} * (SELECT g FROM g)) / (count(o_totalprice) + {m}) AS e FROM orders {where} GROUP BY 1) "
        f"SELECT {keep}, round(coalesce(e, (SELECT g FROM g)), 6) AS {key}_target_enc FROM orders LEFT JOIN e ON {key} = k"
    )


def _target(spark, sf_dir, smoothing: float, key: str = "o_orderpriority", where: str | None = None) -> DataFrame:
    df = load(spark, sf_dir, "orders", _ORDER)
    encoder = TargetEncodingStrategy(smoothing, "o_totalprice").fit(df.where(where) if where else df, key)
    name = f"{key}_target_enc"
    return encoder.encode(df, key).withColumn(name, F.round(name, 6))


@query(_target_sql("10.0"))
def target_encode(spark, sf_dir):
    return _target(spark, sf_dir, 10.0)


@query(_target_sql("CAST(1e9 AS DOUBLE)"))
def target_encode_m1e9(spark, sf_dir):
    return _target(spark, sf_dir, 1e9)


@query(_target_sql("0.0"))
def target_encode_m0(spark, sf_dir):
    return _target(spark, sf_dir, 0.0)


@query(_target_sql("10.0", "o_custkey", "o_orderkey, o_orderstatus, o_totalprice, o_orderpriority", "WHERE o_orderkey % 2 = 0"))
def target_encode_unseen(spark, sf_dir):
    return _target(spark, sf_dir, 10.0, "o_custkey", "o_orderkey % 2 = 0")


@query(
    f"WITH o AS (SELECT o_orderkey, {_HOLED.format('o_orderpriority')} AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders), "
    "g AS (SELECT avg(price) AS g FROM o), e AS (SELECT priority AS k, (count(price) * avg(price) + 10.0 * (SELECT g FROM g)) / (count(price) + 10.0) AS e FROM o WHERE priority IS NOT NULL GROUP BY 1) "
    "SELECT o_orderkey, price, round(coalesce(e, (SELECT g FROM g)), 6) AS priority_target_enc FROM o LEFT JOIN e ON priority = k"
)
def target_encode_nulls(spark, sf_dir):
    priority, price = _HOLED.format("o_orderpriority") + " AS priority", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price"
    df = load(spark, sf_dir, "orders").selectExpr("o_orderkey", priority, price)
    out = FeatureEngineer(TargetEncodingStrategy()).fit_transform(df, "priority", "price")
    return out.withColumn("priority_target_enc", F.round("priority_target_enc", 6))


@query(
    "SELECT o_orderpriority AS category, round((count(*) * avg(o_totalprice) + 10.0 * (SELECT avg(o_totalprice) FROM orders)) / (count(*) + 10.0), 6) AS encoding FROM orders GROUP BY 1"
)
def target_mapping(spark, sf_dir):
    strategy = TargetEncodingStrategy()
    sums = strategy.sums(load(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"]), "o_orderpriority", "o_totalprice")
    mapping = strategy.mapping(sums, strategy.mean(sums))
    return mapping.withColumn("encoding", F.round("encoding", 6))


@query(
    f"SELECT o_orderkey, o_custkey, o_totalprice, f AS o_orderpriority_freq, {_dummies('o_orderstatus', 'FOP', 'o_orderstatus')} FROM orders JOIN "
    "(SELECT o_orderpriority AS k, count(*) / sum(count(*)) OVER () AS f FROM orders GROUP BY 1) ON o_orderpriority = k"
)
def strategy_hot_swap(spark, sf_dir):
    engineer = FeatureEngineer(FrequencyEncodingStrategy())
    df = engineer.fit_transform(load(spark, sf_dir, "orders", _ORDER), "o_orderpriority")
    engineer.set_strategy(OneHotStrategy())
    return engineer.fit_transform(df, "o_orderstatus")


# Ordered rows, casts, events, fingerprints ---------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders)")
def drop_last_row(spark, sf_dir):
    return rows.drop_last_row(load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1")
def first_row(spark, sf_dir):
    return rows.first_row(load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey")


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def temp_cast(spark, sf_dir):
    with casts.temp_dtypes(load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), {"o_custkey": "float64"}) as df:
        return df


@query("SELECT o_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS DOUBLE) AS o_totalprice FROM orders")
def cast_roundtrip(spark, sf_dir):
    return casts.cast_roundtrip(load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), {"o_totalprice": "int64"})


def _observed(spark, sf_dir, *observers) -> None:
    source = ParquetLoader(f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])
    pipeline = Pipeline([source, DropLastRowStep("o_orderkey"), FirstRowStep("o_orderkey"), SelectStep(["o_orderkey"])], metrics="eager")
    for o in observers:
        pipeline.attach_observer(o)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        pipeline.run(None)
    pipeline.release()


@query(
    "SELECT 'parquet_loader' AS step, 'ParquetLoader' AS step_class, CAST(NULL AS BIGINT) AS rows_in, count(*) AS rows_out FROM orders "
    "UNION ALL SELECT 'drop_last_row', 'DropLastRowStep', count(*), count(*) - 1 FROM orders "
    "UNION ALL SELECT 'first_row', 'FirstRowStep', count(*) - 1, 1 FROM orders UNION ALL SELECT 'select', 'SelectStep', 1, 1"
)
def pipeline_metrics(spark, sf_dir):
    metrics = MetricsObserver()
    _observed(spark, sf_dir, metrics)
    return metrics.to_df(spark).drop("duration_ms")


@query("SELECT 1 AS alert, concat('[first_row] lost ', format('{:.1f}', 100.0 - 100.0 / (count(*) - 1)), '% of its rows (', count(*) - 1, ' -> 1)') AS message FROM orders")
def alert_drop_ratio(spark, sf_dir):
    alerts = AlertObserver(0.5)
    _observed(spark, sf_dir, alerts)
    return spark.createDataFrame(list(enumerate(alerts.alerts, 1)), "alert int, message string")


@query("SELECT count(*) AS n_rows, true AS same_after_reorder, true AS differs_after_edit, true AS differs_after_copy FROM orders")
def content_fingerprint_orders(spark, sf_dir):
    """Whether the fingerprint ignores row order, and sees one edited value and one row more."""
    df = load(spark, sf_dir, "orders")
    last = F.col("o_orderkey") == df.agg(F.max("o_orderkey")).scalar()
    variants = {
        "own": df,
        "reordered": df.repartition(7, "o_custkey"),
        "edited": df.withColumn("o_totalprice", F.when(last, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))),
        "copied": df.union(df.where(last)),
    }
    prints = None
    for name, frame in variants.items():
        own = content_fingerprint(frame).select(F.lit(name).alias("of"), "n_rows", F.struct("n_rows", "hash_xor", "hash_sum", "schema").alias("print"))
        prints = own if prints is None else prints.union(own)
    one = lambda name, c="print": F.max(F.when(F.col("of") == name, F.col(c)))
    return prints.agg(
        one("own", "n_rows").alias("n_rows"),
        (one("own") == one("reordered")).alias("same_after_reorder"),
        (one("own") != one("edited")).alias("differs_after_edit"),
        (one("own") != one("copied")).alias("differs_after_copy"),
    )


# Pipelines, caches, configuration, streams -----------------------------------------------------

_SAFE_RATIO = "SELECT l_orderkey, l_linenumber, l_tax, l_discount, coalesce(l_tax / nullif(l_discount, 0), 0.0) AS tip_pct FROM lineitem"


@query(_SAFE_RATIO)
def pipeline_manifest(spark, sf_dir):
    """The flagship saved as a manifest, loaded and run."""
    columns = ["l_orderkey", "l_linenumber", "l_tax", "l_discount"]
    with tempfile.TemporaryDirectory() as folder:  # a file of the driver's own
        path = Path(folder, "deep", "pipeline.json")
        Pipeline([ParquetLoader(f"{sf_dir}/lineitem.parquet", columns), RatioStep("l_tax", "l_discount", "tip_pct")]).save(path)
        return Pipeline.load(path).run(None)


@query(
    "SELECT 'parquet_loader' AS step, CAST(NULL AS BIGINT) AS rows_in, count(*) AS rows_out FROM orders "
    "UNION ALL SELECT 'function', count(*), count(*) FILTER (o_totalprice > 100000) FROM orders"
)
def pipeline_observed(spark, sf_dir):
    """Row counts that ride on the first action."""
    metrics = MetricsObserver()
    steps = [ParquetLoader(f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"]), FunctionStep(lambda df: df.where("o_totalprice > 100000"))]
    pipeline = Pipeline(steps, metrics="observe")
    pipeline.attach_observer(metrics)
    pipeline.run(None).write.format("noop").mode("overwrite").save()
    pipeline.flush(timeout=30)
    return metrics.to_df(spark).select("step", "rows_in", "rows_out")


@query(
    f"SELECT {_KEEP}, coalesce(f, 0.0) AS o_orderpriority_freq FROM orders LEFT JOIN "
    "(SELECT o_orderpriority AS k, count(*) / sum(count(*)) OVER () AS f FROM orders GROUP BY 1) ON o_orderpriority = k"
)
def encode_step(spark, sf_dir):
    source = ParquetLoader(f"{sf_dir}/orders.parquet", _ORDER)
    return Pipeline([source, EncodeStep(FrequencyEncodingStrategy(), "o_orderpriority")]).run(None)


@query("SELECT 1 AS built, true AS same_frame, true AS evicted, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'F'")
def memoized(spark, sf_dir):
    """A cache of one result: the second call is a hit, another frame evicts it."""
    built = []

    @memoize_dataframe(maxsize=1)
    def finished(df):
        built.append(df)
        return df.where("o_orderstatus = 'F'")

    first = finished(load(spark, sf_dir, "orders"))
    same, n, calls = finished(load(spark, sf_dir, "orders")) is first, first.count(), len(built)
    finished(load(spark, sf_dir, "orders", ["o_orderstatus"]))
    evicted = not first.is_cached
    finished.cache_clear()
    return spark.createDataFrame([(calls, same, evicted, n)], "built int, same_frame boolean, evicted boolean, n_rows bigint")


@query("SELECT 3 AS attempts, count(*) AS n_rows FROM region")
def retried(spark, sf_dir):
    attempts = []

    @retry(max_attempts=3, backoff=0.01)
    def flaky():
        attempts.append(1)
        if len(attempts) < 3:
            raise OSError("not yet")
        return load(spark, sf_dir, "region").count()

    n = flaky()
    return spark.createDataFrame([(len(attempts), n)], "attempts int, n_rows bigint")


@query("SELECT * FROM (VALUES (1, 'INFO', '[identity] start rows_in=5'), (2, 'INFO', '[identity] done rows_out=5'), (3, 'INFO', '[function] start rows_in=5'), (4, 'ERROR', '[function] error')) t(line, level, message)")
def log_file(spark, sf_dir):
    """The lines that a run with a failing step leaves, without times and error texts."""

    def fails(df):
        raise ValueError("planned")

    with tempfile.TemporaryDirectory() as folder:  # the log is a file of the driver's own
        pipeline = Pipeline([IdentityStep(), FunctionStep(fails)], metrics="eager")
        pipeline.attach_observer(LoggingObserver(Path(folder, "run.log")))
        try:
            pipeline.run(load(spark, sf_dir, "region"))
        except ValueError:
            pipeline.release()
        lines = Path(folder, "run.log").read_text(encoding="utf-8").splitlines()
    rows = [(i, *x.split(" | ")[1:]) for i, x in enumerate(lines, 1)]
    cut = F.regexp_replace("message", r" duration_ms=.*|(?<=error) .*", "")
    return spark.createDataFrame(rows, "line int, level string, message string").withColumn("message", cut)


@query(
    "SELECT * FROM (VALUES ('paths.raw_data', 'data/raw'), ('paths.processed_data', 'data/processed'), ('paths.features_data', 'data/features'), "
    "('model.learning_rate', '0.05'), ('model.n_estimators', '500'), ('model.max_depth', '9'), ('model.objective', 'regression'), ('model.seed', '7'), "
    "('pipeline.n_jobs', '-1'), ('pipeline.chunk_size', '2048'), ('same object', 'True'), ('arrow rows', '2048')) t(key, value)"
)
def config_values(spark, sf_dir):
    """A YAML file over the defaults, read once."""
    Config.reset()
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "config.yaml")
        path.write_text("model: {max_depth: 9, seed: 7}\npipeline: {chunk_size: 2048}\n", encoding="utf-8")
        config = Config(path)
    values = {"paths": {k: str(getattr(config, f"{k}_path")) for k in DEFAULTS["paths"]}, "model": config.model, "pipeline": config.pipeline}
    rows = [(f"{part}.{k}", str(v)) for part, own in values.items() for k, v in own.items()]
    rows += [("same object", str(Config("elsewhere.yaml") is config)), ("arrow rows", session_conf(config)["spark.sql.execution.arrow.maxRecordsPerBatch"])]
    Config.reset()
    return spark.createDataFrame(rows, "key string, value string")


@query(
    "SELECT * FROM (VALUES ('fine', 'none'), ('rate below 0', 'ValueError'), ('rate above 1', 'ValueError'), ('few trees', 'ValueError'), "
    "('unknown objective', 'ValueError'), ('depth no integer', 'TypeError'), ('no such column', 'KeyError'), ('no step', 'TypeError'), "
    "('no frame', 'TypeError'), ('no target', 'ValueError'), ('not fitted', 'RuntimeError'), ('no file', 'FileNotFoundError'), ('unknown mode', 'ValueError')) t(attempt, error)"
)
def checked_errors(spark, sf_dir):
    """Which error each breach of a contract raises, before any job runs."""
    orders = load(spark, sf_dir, "orders")
    attempts = {
        "fine": lambda: ModelConfig(0.05, 200, "regression", 8),
        "rate below 0": lambda: ModelConfig(-0.1, 200, "regression", 8),
        "rate above 1": lambda: ModelConfig(1.1, 200, "regression", 8),
        "few trees": lambda: ModelConfig(0.1, 5, "regression", 8),
        "unknown objective": lambda: ModelConfig(0.1, 200, "clustering", 8),
        "depth no integer": lambda: ModelConfig(0.1, 200, "regression", 4.5),
        "no such column": lambda: OneHotStrategy().encode(orders, "nowhere"),
        "no step": lambda: Pipeline(["step"]),
        "no frame": lambda: Pipeline([IdentityStep()]).run("frame"),
        "no target": lambda: TargetEncodingStrategy().fit(orders, "o_orderstatus"),
        "not fitted": lambda: TargetEncodingStrategy().encode(orders, "o_orderstatus"),
        "no file": lambda: LoaderFactory.create(f"{sf_dir}/nowhere.parquet"),
        "unknown mode": lambda: Pipeline(metrics="sometimes"),
    }
    return spark.createDataFrame([(name, _error_of(f)) for name, f in attempts.items()], "attempt string, error string")


def _error_of(attempt) -> str:
    try:
        attempt()
    except Exception as error:  # noqa: BLE001 - its type is the result
        return type(error).__name__
    return "none"


@query(_SAFE_RATIO)
def stream_ratio(spark, sf_dir):
    """The flagship over a stream of files, with its sink and checkpoint in the shared folder."""
    table = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_tax", "l_discount"])
    source = write_parquet(table, scratch_path(spark, "stream-in"))
    stream = spark.readStream.schema(table.schema).parquet(source)
    out = scratch_path(spark, "stream-out")
    query = run_stream(Pipeline([RatioStep("l_tax", "l_discount", "tip_pct")]), stream, out, scratch_path(spark, "stream-state"))
    query.awaitTermination()
    return spark.read.parquet(out)
