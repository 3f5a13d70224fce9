import pandas as pd
import pytest

from featureflow.operators import encoders
from featureflow.operators.encoders import FeatureEngineer, FrequencyEncodingStrategy, OneHotStrategy, TargetEncodingStrategy

NAN = float("nan")


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, None if i % 11 == 0 else "abcd"[i * i % 4], NAN if i % 7 == 0 else None if i % 13 == 0 else i * 0.25, float(i % 3) if i % 5 else NAN) for i in range(200)]
    rows += [(200 + i, "never", NAN, 1.0) for i in range(3)]
    return spark.createDataFrame(rows, "i int, k string, t double, f double")


def as_pandas(df):
    return df.toPandas().sort_values("i").reset_index(drop=True)


def test_one_hot_against_pandas(frame):
    got = as_pandas(OneHotStrategy().encode(frame, "k"))
    want = pd.get_dummies(as_pandas(frame)["k"], prefix="k").astype("int8")
    assert list(got.columns) == ["i", "t", "f", *want.columns]
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_frequency_against_pandas(frame):
    for normalize in (True, False):
        got = as_pandas(FrequencyEncodingStrategy(normalize).encode(frame, "k"))
        k = as_pandas(frame)["k"]
        assert list(got.columns) == ["i", "t", "f", "k_freq"]
        pd.testing.assert_series_equal(got["k_freq"], k.map(k.value_counts(normalize=normalize)).fillna(0.0), check_names=False, check_dtype=False)


def test_float_keys_treat_nan_as_missing(frame):
    got = as_pandas(FrequencyEncodingStrategy().encode(frame, "f"))
    f = as_pandas(frame)["f"]
    pd.testing.assert_series_equal(got["f_freq"], f.map(f.value_counts(normalize=True)).fillna(0.0), check_names=False)


def test_target_against_pandas(frame):
    p = as_pandas(frame)
    mean = p["t"].mean()
    stats = p.groupby("k")["t"].agg(["mean", "count"])
    want = p["k"].map((stats["count"] * stats["mean"] + 10 * mean) / (stats["count"] + 10)).fillna(mean)
    got = as_pandas(TargetEncodingStrategy().fit(frame, "k", "t").encode(frame, "k"))
    assert list(got.columns) == ["i", "t", "f", "k_target_enc"]
    assert (got["k_target_enc"] - want).abs().max() < 1e-12


def test_smoothing_extremes(frame):
    mean = as_pandas(frame)["t"].mean()
    heavy = as_pandas(TargetEncodingStrategy(1e12, "t").fit(frame, "k").encode(frame, "k"))
    assert (heavy["k_target_enc"] - mean).abs().max() < 1e-6
    none = as_pandas(TargetEncodingStrategy(0.0, "t").fit(frame, "k").encode(frame, "k"))
    assert not none["k_target_enc"].isna().any()


def test_unseen_values(spark, frame):
    new = spark.createDataFrame([(1, "zzz", 0.0, 0.0), (2, None, 0.0, 0.0)], frame.schema)
    assert [r["k_freq"] for r in FrequencyEncodingStrategy().fit(frame, "k").encode(new, "k").collect()] == [0.0, 0.0]
    mean = as_pandas(frame)["t"].mean()
    assert all(abs(r["k_target_enc"] - mean) < 1e-12 for r in TargetEncodingStrategy(target_col="t").fit(frame, "k").encode(new, "k").collect())


def test_state_is_per_column_and_sticky(spark, frame):
    s = FrequencyEncodingStrategy()
    s.encode(frame, "k")
    other = spark.createDataFrame([(1, "a", 0.0, 5.0)], frame.schema)
    assert s.encode(other, "k").first()["k_freq"] < 1.0
    assert s.encode(other, "f").first()["f_freq"] == 1.0
    with pytest.raises(RuntimeError):
        TargetEncodingStrategy(target_col="t").fit(frame, "k").encode(frame, "f")


def test_all_missing_column(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0)], "i int, k string, t double")
    assert {r["k_freq"] for r in FrequencyEncodingStrategy().fit(df, "k").encode(df, "k").collect()} == {0.0}
    assert {r["k_target_enc"] for r in TargetEncodingStrategy(target_col="t").fit(df, "k").encode(df, "k").collect()} == {3.0}
    assert OneHotStrategy().encode(df, "k").columns == ["i", "t"]


def test_errors(frame):
    with pytest.raises(KeyError):
        OneHotStrategy().encode(frame, "zz")
    with pytest.raises(KeyError):
        FrequencyEncodingStrategy().fit(frame, "zz")
    with pytest.raises(ValueError):
        TargetEncodingStrategy().fit(frame, "k")
    with pytest.raises(KeyError):
        TargetEncodingStrategy().fit(frame, "k", "zz")
    with pytest.raises(KeyError):
        TargetEncodingStrategy(target_col="t").encode(frame, "zz")


def test_awkward_categories(spark):
    df = spark.createDataFrame([(1, "x.y", True), (2, "", None), (3, "z`", False)], "i int, k string, b boolean")
    out = OneHotStrategy().encode(df, "k")
    assert out.columns == ["i", "b", "k_", "k_x.y", "k_z`"] and out.count() == 3
    assert OneHotStrategy().encode(df, "b").columns == ["i", "k", "b_False", "b_True"]
    clash = spark.createDataFrame([("a",), ("A",)], "k string")
    with pytest.raises(ValueError):
        OneHotStrategy().encode(clash, "k")


def test_one_hot_options(frame):
    assert OneHotStrategy(drop_first=True, prefix="p").encode(frame, "k").columns[3:] == ["p_b", "p_never"] or OneHotStrategy(drop_first=True, prefix="p").encode(frame, "k").columns[3][:2] == "p_"
    assert OneHotStrategy(categories=["a", "q"]).encode(frame, "k").columns == ["i", "t", "f", "k_a", "k_q"]
    assert OneHotStrategy(prefix="").encode(frame, "k").columns[3].startswith("k_")


def test_output_column_replaced_in_place(spark):
    df = spark.createDataFrame([("a", 9.0, 1)], "k string, k_freq double, z int")
    out = FrequencyEncodingStrategy().encode(df, "k")
    assert out.columns == ["k_freq", "z"] and out.first()["k_freq"] == 1.0


def test_large_mapping_is_written_and_not_hinted(spark, frame, monkeypatch):
    monkeypatch.setattr(encoders, "LOCAL_ROWS", 2)
    s = FrequencyEncodingStrategy().fit(frame, "k")
    assert s._fitted["k"][1] is False
    p = as_pandas(frame)["k"]
    pd.testing.assert_series_equal(as_pandas(s.encode(frame, "k"))["k_freq"], p.map(p.value_counts(normalize=True)).fillna(0.0), check_names=False)


def test_feature_engineer(frame):
    e = FeatureEngineer(FrequencyEncodingStrategy())
    assert e.fit(frame, "k") is e and "k_freq" in e.transform(frame, "k").columns
    assert "fitted=True" in repr(e.strategy)
    e.set_strategy(OneHotStrategy())
    assert "k_a" in e.fit_transform(frame, "k").columns and "k" in frame.columns
