import importlib.util
from pathlib import Path

from featureflow.config import Config


def test_flagship_job(spark, tmp_path):
    path = Path(__file__).resolve().parents[1] / "scripts" / "tip_pipeline.py"
    spec = importlib.util.spec_from_file_location("tip_pipeline", path)
    job = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(job)
    trips = spark.createDataFrame([(10.0, 1.0, "a"), (0.0, 3.0, "b"), (None, 1.0, "c")], "fare_amount double, tip_amount double, zone string")
    trips.write.parquet(str(tmp_path / "in.parquet"))
    Config.reset()
    records = job.main([str(tmp_path / "in.parquet"), str(tmp_path / "out"), "--log", str(tmp_path / "p.log")])
    Config.reset()
    got = {r["zone"]: r["tip_pct"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 0.1, "b": 0.0, "c": 0.0}
    assert [(r["step"], r["rows_out"]) for r in records] == [("parquet_loader", 3), ("tip_pct", 3)]
    assert "[tip_pct] done" in (tmp_path / "p.log").read_text()
