import pytest
from helpers import SMALL, assert_same

from featureflow.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_duckdb(spark, name):
    assert_same(catalog.queries()[name](spark, SMALL), SMALL, ORACLES[name])


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["safe_ratio", "one_hot", "freq_encode", "target_encode", "scan_filter_dnf"])
def test_no_python_in_the_plan(spark, name):
    text = plan(catalog.queries()[name](spark, SMALL))
    assert "Python" not in text and "ArrowEval" not in text and "MapInPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.queries()["scan_filter_unprojected"](spark, SMALL)).split("Physical Plan")[1]
    assert "EqualTo(o_orderstatus,F)" in text and "o_totalprice" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_discount:double,l_tax:double>" in plan(catalog.queries()["safe_ratio"](spark, SMALL))


def test_small_mapping_is_broadcast(spark):
    df = catalog.queries()["freq_encode"](spark, SMALL)
    df.collect()
    assert "BroadcastHashJoin" in plan(df)
