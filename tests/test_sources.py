import pandas as pd
import pytest
from pyspark.sql import DataFrame

from featureflow.plans.step import BasePipelineStep
from featureflow.sources import CSVLoader, JSONLoader, LoaderFactory, ORCLoader, ParquetLoader, dnf_predicate, open_parquet_files, register_loader, scan_parquet_files
from featureflow.sources.loaders import json_document
from featureflow.sources.sinks import CSVSink, JSONSink, ParquetSink


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(10)], "a bigint, b int, c string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    return str(tmp_path / "t.parquet")


def test_parquet_projection_and_filters(spark, table):
    assert ParquetLoader(table, ["c", "a"]).run(None).columns == ["c", "a"]
    got = ParquetLoader(table, ["a"], [[("b", "==", 1), ("a", ">", 3)], [("c", "in", ["n0"])]]).run(None)
    assert {r["a"] for r in got.collect()} == {0, 4, 7}
    assert ParquetLoader(table, filters=[("b", "not in", [0, 1])]).run(None).count() == 3
    assert ParquetLoader(table).name == "parquet_loader" and CSVLoader("x").name == "csv_loader" and JSONLoader("x").name == "json_loader"
    with pytest.raises(ValueError):
        dnf_predicate([("a", "~", 1)])
    with pytest.raises(ValueError):
        dnf_predicate([("a", 1)])
    assert dnf_predicate(None) is None


def test_csv_missing_tokens_and_types(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("i,d,b,s,day\n1,1.5,True,x,2020-01-01\nNA,,False,None,2020-01-02\n3,2,,n/a,2020-01-03\n")
    df = CSVLoader(path).run(None)
    assert df.dtypes == [("i", "bigint"), ("d", "double"), ("b", "boolean"), ("s", "string"), ("day", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "x", "2020-01-01"), (None, None, False, None, "2020-01-02"), (3, 2.0, None, None, "2020-01-03")]
    typed = CSVLoader(path, schema="i int, d double, b boolean, s string, day date").run(None)
    assert dict(typed.dtypes)["day"] == "date" and typed.first()["i"] == 1
    with pytest.raises(ValueError):
        CSVLoader(path, chunksize=5)


def test_csv_separator_and_encoding(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("a;b\n1;é\n".encode("latin-1"))
    assert tuple(CSVLoader(path, sep=";", encoding="ISO-8859-1").run(None).first()) == (1, "é")


@pytest.mark.parametrize("orient", ["records", "columns", "index", "split", "table"])
def test_json_orients(spark, tmp_path, orient):
    rows = [{"z": 1, "a": "x"}, {"z": 2, "a": "y"}]
    path = tmp_path / "d.json"
    path.write_text(json_document(rows, orient))
    df = JSONLoader(path, orient=orient, schema="z bigint, a string").run(None)
    assert df.columns == ["z", "a"] and sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y")]


def test_json_values_lines_and_errors(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json_document([{"a": 1, "b": "x"}], "values"))
    assert tuple(JSONLoader(path, orient="values").run(None).first()) == (1, "x")
    lines = tmp_path / "l.json"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    assert JSONLoader(lines, lines=True).run(None).count() == 2
    table = tmp_path / "t.json"
    pd.DataFrame({"b": [1, 2], "a": ["x", None], "f": [0.5, 1.5], "t": [True, False]}).to_json(table, orient="table")
    df = JSONLoader(table, orient="table").run(None)
    assert df.dtypes == [("b", "bigint"), ("a", "string"), ("f", "double"), ("t", "boolean")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", 0.5, True), (2, None, 1.5, False)]
    with pytest.raises(ValueError):
        JSONLoader(lines, orient="rows")
    with pytest.raises(ValueError):
        JSONLoader(lines, orient="split", lines=True)


def test_factory(spark, table, tmp_path):
    assert isinstance(LoaderFactory.create(table), ParquetLoader)
    assert {".csv", ".json", ".orc", ".parquet"} <= set(LoaderFactory.supported_extensions())
    assert LoaderFactory.registry()[".parquet"] == "ParquetLoader"
    with pytest.raises(FileNotFoundError):
        LoaderFactory.create(tmp_path / "ghost.xyz")
    (tmp_path / "f.xyz").write_text("")
    with pytest.raises(ValueError, match=r"\.csv"):
        LoaderFactory.create(tmp_path / "f.xyz")
    (tmp_path / "a.csv.gz").write_text("")
    with pytest.raises(ValueError):
        LoaderFactory.create(tmp_path / "a.csv.gz")


def test_custom_loader(spark, tmp_path):
    @register_loader(".Feather")
    class Custom(BasePipelineStep):
        name = "custom"

        def __init__(self, path):
            self.path = path

        def _run(self, df: DataFrame) -> DataFrame:
            return spark.range(3).toDF("a")

    (tmp_path / "x.FEATHER").write_text("")
    assert LoaderFactory.create(tmp_path / "x.FEATHER").run(None).count() == 3
    with pytest.raises(TypeError):
        register_loader(".no")(dict)


def test_multi_file(spark, tmp_path):
    for n, v in (("b", [3, 4]), ("a", [1, 2])):
        pd.DataFrame({"value": v}).to_parquet(tmp_path / f"{n}.parquet")
    with open_parquet_files(tmp_path) as df:
        assert sorted(r["value"] for r in df.collect()) == [1, 2, 3, 4]
    files = scan_parquet_files(tmp_path, path_column="file")
    assert {r["file"].rsplit("/", 1)[1] for r in files.collect()} == {"a.parquet", "b.parquet"}
    assert scan_parquet_files(tmp_path, "*.nope", "value bigint").count() == 0


def test_nanoseconds(spark, tmp_path):
    stamps = pd.Series(pd.to_datetime(["2020-01-01 00:00:00.123456789"]))
    pd.DataFrame({"t": stamps}).to_parquet(tmp_path / "n.parquet", coerce_timestamps=None, version="2.6")
    row = ParquetLoader(tmp_path / "n.parquet", nanos_as_micros=["t"]).run(None).first()
    assert row["t"].microsecond == 123456


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a bigint, b string")
    assert ParquetSink(tmp_path / "p").run(df).collect() == df.collect()
    CSVSink(tmp_path / "c").run(df)
    JSONSink(tmp_path / "j").run(df)
    df.write.orc(str(tmp_path / "o.orc"))
    assert CSVLoader(tmp_path / "c").run(None).collect() == df.collect()
    assert JSONLoader(tmp_path / "j", lines=True).run(None).collect() == df.collect()
    assert ORCLoader(tmp_path / "o.orc", ["b"]).run(None).columns == ["b"]
