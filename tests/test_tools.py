import logging
import time

import pytest

from featureflow import config
from featureflow.config import Config, ConfigNew, SingletonMeta, overlaid
from featureflow.operators import cast_roundtrip, drop_last_row, first_row, temp_dtypes, value_counts
from featureflow.plans import cache
from featureflow.plans.cache import content_fingerprint, memoize_dataframe
from featureflow.plans.instrument import MemoryGuard, Timer, log_calls, retry, timeit
from featureflow.session import session_conf
from featureflow.validation import BoundedFloat, ModelConfig, OneOf, Positive, TypedAttr


def test_timeit_and_log_calls(caplog):
    @timeit
    def f(x):
        return x

    @timeit(unit="s")
    def fails():
        raise ValueError

    @log_calls
    def g(name="NYC", n=1): ...

    @log_calls(level="debug", log_args=False)
    def h(a): ...

    with caplog.at_level(logging.DEBUG):
        assert f(3) == 3
        g()
        h(1)
        with pytest.raises(ValueError):
            fails()
    assert "[timeit] f took" in caplog.text and "fails" not in caplog.text
    assert "name='NYC'" in caplog.text and "[log_calls] h()" in caplog.text
    with pytest.raises(ValueError):
        timeit(unit="h")
    with pytest.raises(ValueError):
        log_calls(level="LOUD")


def test_retry(monkeypatch):
    pauses, calls = [], []
    monkeypatch.setattr(time, "sleep", pauses.append)

    @retry(max_attempts=3, backoff=2.0)
    def flaky(until):
        calls.append(1)
        if len(calls) < until:
            raise OSError("again")
        return "ok"

    assert flaky(3) == "ok" and pauses == [1.0, 2.0]
    calls.clear()
    with pytest.raises(OSError):
        flaky(9)
    assert len(calls) == 3

    @retry()
    def other():
        raise KeyError

    with pytest.raises(KeyError):
        other()
    for bad in ({"max_attempts": 0}, {"backoff": 0}):
        with pytest.raises(ValueError):
            retry(**bad)


def test_timer_and_guard(spark, caplog):
    with caplog.at_level(logging.INFO), pytest.raises(KeyError):
        with Timer("load"):
            raise KeyError
    assert "[Timer] load" in caplog.text
    with pytest.raises(ValueError):
        Timer("x", unit="h")
    with MemoryGuard(1e9) as g:
        spark.range(10).count()
    assert g.peak_mb >= 0
    with pytest.raises(MemoryError):
        with MemoryGuard(-1e9):
            pass
    with pytest.raises(KeyError):
        with MemoryGuard(-1e9):
            raise KeyError


def test_memoize(spark):
    built = []

    @memoize_dataframe(maxsize=2)
    def double(df, k=1):
        built.append(1)
        return df.selectExpr(f"id * 2 * {k} AS v")

    a, b, c = spark.range(3), spark.range(4), spark.range(5)
    first = double(a)
    assert double(spark.range(3)) is first and len(built) == 1 and first.is_cached
    double(a, k=1), double(b)
    assert len(built) == 3 and double.cache_size() == 2 and not first.is_cached
    double(c)
    double.cache_clear()
    assert double.cache_size() == 0

    @memoize_dataframe()
    def plain(x):
        built.append(x)
        return None

    plain(1), plain(True), plain([1]), plain((1,))
    assert len(built) == 8
    with pytest.raises(TypeError):
        plain(bytearray())

    class Collides(cache.PlanKey):
        def __init__(self, df):
            super().__init__(df)
            self.code = 1

        __hash__ = cache.PlanKey.__hash__

    keys = {Collides(spark.range(n)): n for n in (3, 4, 3)}
    assert len(keys) == 2 and keys[Collides(spark.range(4))] == 4
    with pytest.raises(ValueError):
        memoize_dataframe(maxsize=0)


def test_fingerprint(spark):
    def of(rows, schema="a int, b string"):
        return tuple(content_fingerprint(spark.createDataFrame(rows, schema)).first())

    assert of([(1, "x"), (2, None)]) == of([(2, None), (1, "x")])
    assert of([(1, "x")]) != of([(1, "y")]) and of([(1, "x")]) != of([(1, "x")], "a bigint, b string")
    assert of([(1, "x")]) != of([(1, "x"), (1, "x"), (1, "x")]) and of([])[0] == 0


def test_casts(spark):
    df = spark.createDataFrame([(2.9, 1), (None, 2)], "v double, w bigint")
    with temp_dtypes(df, {"w": "float64", "v": "string"}) as cast:
        assert cast.dtypes == [("v", "string"), ("w", "double")]
    assert df.dtypes == [("v", "double"), ("w", "bigint")]
    assert [r["v"] for r in cast_roundtrip(df, {"v": "int64"}).collect()] == [2.0, None]
    with pytest.raises(KeyError):
        with temp_dtypes(df, {"w": "int", "zz": "int"}):
            pass
    with pytest.raises(KeyError):
        cast_roundtrip(df, {"zz": "int"})
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        cast_roundtrip(spark.createDataFrame([(1e12,)], "v double"), {"v": "int"}).collect()


def test_ordered_rows(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert sorted(r["k"] for r in drop_last_row(df, "k").collect()) == [1, 2]
    assert first_row(df, "k").first()["v"] == "a"
    empty = df.where("k > 9")
    assert drop_last_row(empty, "k").count() == 0 and first_row(empty, "k").count() == 0
    assert drop_last_row(df.where("k = 1"), "k").count() == 0
    with pytest.raises(Exception, match="not unique"):
        drop_last_row(df.union(df.where("k = 3")), "k").collect()
    assert drop_last_row(df.union(df.where("k = 1")), "k").count() == 3
    assert drop_last_row(df.union(df.selectExpr("k", "upper(v) v")), ["k", "v"]).count() == 5
    with pytest.raises(KeyError):
        first_row(df, "zz")


def test_value_counts_share(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),), (2.0,), (None,)], "v double")
    assert {r["value"]: r["count"] for r in value_counts(df, "v", normalize=True).collect()} == {1.0: 2 / 3, 2.0: 1 / 3}


def test_config(tmp_path):
    Config.reset()
    path = tmp_path / "c.yaml"
    path.write_text("paths: {raw_data: custom/raw}\nmodel: {seed: 123, extra: 1}\npipeline: {chunk_size: 2048}\n")
    c = Config(path)
    assert Config("other.yaml") is c and ConfigNew is Config and isinstance(Config, SingletonMeta)
    assert str(c.raw_data_path) == "custom/raw" and str(c.processed_data_path) == "data/processed"
    assert c.seed == 123 and c.model["extra"] == 1 and c.model["n_estimators"] == 500
    c.model["seed"] = 0
    assert c.seed == 123
    for name in ("raw_data_path", "processed_data_path", "features_data_path", "seed", "model", "pipeline"):
        with pytest.raises(AttributeError):
            setattr(c, name, 1)
    assert session_conf(c)["spark.sql.execution.arrow.maxRecordsPerBatch"] == "2048" and session_conf(c)["spark.master"] == "local[*]"
    Config.reset()
    assert Config(tmp_path / "none.yaml").seed == 42
    Config.reset()
    (tmp_path / "empty.yaml").write_text("")
    assert Config(tmp_path / "empty.yaml").pipeline["chunk_size"] == 100_000
    Config.reset()
    assert overlaid({"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": {"e": 1}}) == {"a": {"b": 1, "d": 2}, "c": {"e": 1}}
    assert overlaid({"a": {"b": 1, "c": 2}}, {"a": 5}, {"a": {"b": 3}}) == {"a": {"b": 3}} and overlaid() == {}


def test_config_is_found_without_a_path(tmp_path, monkeypatch):
    (tmp_path / "config.yaml").write_text("model: {seed: 9}\n")
    monkeypatch.setattr(config, "LOOKED_UP", (tmp_path / "none.yaml", tmp_path / "config.yaml"))
    Config.reset()
    assert Config().seed == 9 and Config().model["max_depth"] == 6
    Config.reset()
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(config, "LOOKED_UP", config.LOOKED_UP[:1] + (type(tmp_path)("config.yaml"),))
    assert Config().seed == 9
    Config.reset()

    class Other(metaclass=SingletonMeta): ...

    assert Other() is Other() and not isinstance(Config(), Other)
    Config.reset()


def test_descriptors():
    class Box:
        p, o, t, b = Positive(), OneOf("x", "y"), TypedAttr(int), BoundedFloat(0.0, 1.0)

    box = Box()
    assert box.p is None and isinstance(Box.p, Positive)
    box.p, box.o, box.t, box.b = 0.5, "x", 3, 1.0
    for name, value, error in (
        ("p", 0, ValueError), ("p", True, TypeError), ("p", "1", TypeError), ("o", "z", ValueError), ("t", True, TypeError),
        ("t", 1.0, TypeError), ("b", 1, TypeError), ("b", 1.1, ValueError), ("b", float("nan"), ValueError),
    ):
        with pytest.raises(error):
            setattr(box, name, value)
    for bad in (lambda: OneOf(), lambda: BoundedFloat(1.0, 0.0)):
        with pytest.raises(ValueError):
            bad()
    m = ModelConfig(0.05, 200, "regression", 8)
    assert "200" in repr(m)
    for args in ((-0.1, 200, "regression", 8), (0.1, 10, "regression", 8), (0.1, 200, "clustering", 8)):
        with pytest.raises(ValueError):
            ModelConfig(*args)
    with pytest.raises(TypeError):
        ModelConfig(0.1, 200, "binary", 4.5)
