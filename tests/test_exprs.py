import math

import pytest
from pyspark.sql import functions as F

from featureflow.functions import fill_missing, indicator, is_missing, ratio, replace_value, safe_ratio

INF, NAN = float("inf"), float("nan")


@pytest.fixture
def edges(spark):
    rows = [(1, 1.0, 2.0), (2, 1.0, 0.0), (3, 0.0, 0.0), (4, None, 2.0), (5, 1.0, None), (6, 1.0, -0.0), (7, -1.0, 0.0), (8, NAN, 2.0), (9, INF, INF), (10, INF, 2.0), (11, 3.0, -2.0)]
    return spark.createDataFrame(rows, "i int, a double, b double")


def values(df, column):
    return {r["i"]: r["v"] for r in df.select("i", column.alias("v")).collect()}


def test_safe_ratio(edges):
    assert values(edges, safe_ratio(edges, "a", "b")) == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 0.0, 9: 0.0, 10: INF, 11: -1.5}


def test_ratio_kinds(edges):
    null, zero, ieee = (values(edges, ratio(edges, "a", "b", k)) for k in ("null", "zero", "ieee"))
    assert null[2] is None and null[3] is None and null[1] == 0.5 and null[4] is None
    assert zero[2] == 0.0 and zero[5] is None
    assert ieee[2] == INF and ieee[6] == -INF and ieee[7] == -INF and math.isnan(ieee[3]) and ieee[4] is None
    with pytest.raises(ValueError):
        ratio(edges, "a", "b", "what")


def test_missing_and_fill(edges):
    assert {i for i, v in values(edges, is_missing(edges, "a")).items() if v} == {4, 8}
    assert values(edges, fill_missing(edges, "a", -1.0))[8] == -1.0
    assert values(edges, replace_value(edges, "b", 0.0))[6] is None


def test_indicator(spark):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, 1.0)], "i int, a double")
    assert values(df, indicator(df, "a", 1.0)) == {1: 0, 2: 0, 3: 1}
    assert df.select(indicator(df, "a", 1.0).alias("x")).dtypes == [("x", "tinyint")]


def test_unknown_column(edges):
    for f in (lambda: safe_ratio(edges, "a", "zz"), lambda: fill_missing(edges, "zz", 0), lambda: replace_value(edges, "zz", 0)):
        with pytest.raises(KeyError):
            f()
    assert edges.agg(F.count("i")).first()[0] == 11
