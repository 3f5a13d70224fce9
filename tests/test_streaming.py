import pytest

from featureflow.operators.encoders import FrequencyEncodingStrategy
from featureflow.plans.pipeline import Pipeline
from featureflow.plans.steps import FunctionStep, RatioStep
from featureflow.streaming import run_stream, streamable


def test_fitted_pipeline_over_a_stream(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 0.0), ("b", 3.0, 2.0)], "k string, x double, y double")
    batch.write.parquet(str(tmp_path / "in"))
    encoder = FrequencyEncodingStrategy().fit(batch, "k")
    p = Pipeline([RatioStep("x", "y", "r"), FunctionStep(lambda df: encoder.encode(df, "k"))])
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run_stream(p, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("r", "k_freq").collect())
    assert got == [(0.0, 2 / 3), (0.5, 2 / 3), (1.5, 1 / 3)]
    with pytest.raises(ValueError):
        streamable(p, batch)
    with pytest.raises(ValueError):
        streamable(Pipeline(p.steps, metrics="eager"), stream)
