import logging
import sys
import warnings

import pytest
from pyspark.sql import DataFrame

from featureflow.plans.events import AlertObserver, LoggingObserver, MetricsObserver, PipelineSubject
from featureflow.plans.pipeline import LoggableMixin, Pipeline, SerializableMixin, ValidatableMixin
from featureflow.plans.step import BasePipelineStep
from featureflow.plans.steps import DropLastRowStep, FirstRowStep, FunctionStep, IdentityStep, RatioStep, RowsSource, SelectStep, TipPctStep


class Recorder:
    def __init__(self):
        self.events = []

    def update(self, event):
        self.events.append(event)


class Failing(BasePipelineStep):
    name = "failing"

    def _run(self, df: DataFrame) -> DataFrame:
        raise ValueError("no")


class NoFrame(BasePipelineStep):
    name = "no_frame"

    def _run(self, df: DataFrame) -> DataFrame:
        return 5


@pytest.fixture
def source():
    return RowsSource([(10.0, 1.0), (20.0, 3.0)], "fare_amount double, tip_amount double")


def test_contract_is_checked_at_class_creation():
    def make(**body):
        return type("Bad", (BasePipelineStep,), body)

    def good(self, df: DataFrame) -> DataFrame: ...
    def unannotated(self, df): ...
    def wrong(self, df: int) -> DataFrame: ...
    def more(self, df: DataFrame, x: int = 1) -> DataFrame: ...

    for body in (
        {"_run": good}, {"name": 5, "_run": good}, {"name": "x", "_run": good, "run": good}, {"name": "x", "_run": unannotated},
        {"name": "x", "_run": wrong}, {"name": "x", "_run": more}, {"name": "x", "_run": 5},
    ):
        with pytest.raises(TypeError):
            make(**body)
    step = make(name="x", _run=good)
    assert type("Child", (step,), {}).name == "x"
    with pytest.raises(NotImplementedError):
        BasePipelineStep()._run(None)


def test_flagship_and_order(spark, source):
    out = Pipeline([source, TipPctStep()]).run(None)
    assert sorted(r["tip_pct"] for r in out.collect()) == [0.1, 0.15]
    kept = Pipeline([source, TipPctStep(), DropLastRowStep("fare_amount")]).run(None)
    assert [r["fare_amount"] for r in kept.collect()] == [10.0]
    assert Pipeline([source, FirstRowStep("fare_amount"), SelectStep(["tip_amount"])]).run(None).collect()[0][0] == 1.0
    assert Pipeline([FunctionStep(lambda df: df.limit(1))]).run(out).count() == 1


def test_event_order_and_errors(spark):
    df, seen = spark.range(3).toDF("a"), Recorder()
    p = Pipeline([IdentityStep(), Failing()], metrics="eager")
    p.attach_observer(seen)
    p.attach_observer(seen)
    with pytest.raises(ValueError):
        p.run(df)
    p.release()
    assert [(e["event"], e["step"]) for e in seen.events] == [("before_run", "identity"), ("after_run", "identity"), ("before_run", "failing"), ("run_error", "failing")]
    assert seen.events[1]["rows_in"] == seen.events[1]["rows_out"] == 3
    seen.events.clear()
    with pytest.raises(TypeError):
        Pipeline([NoFrame()]).run(df)
    step = NoFrame()
    step.attach(seen)
    with pytest.raises(TypeError):
        step.run(df)
    assert [e["event"] for e in seen.events] == ["before_run", "run_error"]
    p.detach_observer(seen)
    assert not p.observers and not p.steps[0].observers
    p.detach_observer(seen)


def test_observers_reach_later_steps(spark):
    p, seen = Pipeline(), Recorder()
    p.attach_observer(seen)
    p.add_step(IdentityStep())
    p.run(spark.range(1))
    assert [e["event"] for e in seen.events] == ["before_run", "after_run"] and seen.events[1]["rows_out"] is None
    with pytest.raises(TypeError):
        p.add_step("step")
    with pytest.raises(TypeError):
        p.run("frame")
    assert p.validate(None) and Pipeline().run(None) is None
    assert "identity" in repr(p)


def test_observe_mode_counts_on_the_action(spark):
    metrics = MetricsObserver()
    p = Pipeline([IdentityStep(), FunctionStep(lambda df: df.where("a > 1"))], metrics="observe")
    p.attach_observer(metrics)
    out = p.run(spark.createDataFrame([(i,) for i in range(4)], "a int"))
    assert not metrics.records
    out.write.format("noop").mode("overwrite").save()
    p.flush(timeout=10)
    assert [(r["rows_in"], r["rows_out"]) for r in metrics.records] == [(None, 4), (4, 2)]


def test_observe_mode_never_hangs(spark):
    metrics = MetricsObserver()
    p = Pipeline([IdentityStep()], metrics="observe")
    p.attach_observer(metrics)
    p.run(spark.range(3))
    p.flush(timeout=0.2)
    assert metrics.records[0]["rows_out"] is None
    with pytest.raises(ValueError):
        Pipeline(metrics="maybe")


def test_metrics_table(spark, source):
    metrics = MetricsObserver()
    p = Pipeline([source, IdentityStep()], metrics="eager")
    p.attach_observer(metrics)
    p.run(None)
    p.release()
    assert [tuple(r)[:4] for r in metrics.to_df(spark).collect()] == [("rows", "RowsSource", None, 2), ("identity", "IdentityStep", 2, 2)]


def test_alerts():
    def alerts(threshold, rows_in, rows_out, kind="after_run"):
        a = AlertObserver(threshold)
        with warnings.catch_warnings(record=True) as caught:
            warnings.simplefilter("always")
            a.update({"event": kind, "step": "s", "rows_in": rows_in, "rows_out": rows_out})
        assert len(caught) == len(a.alerts) and all(w.category is RuntimeWarning for w in caught)
        return a.alerts

    assert "75.0%" in alerts(0.3, 4, 1)[0]
    for quiet in ((0.9, 4, 1), (0.5, 4, 2), (0.3, None, 1), (0.3, 0, 0), (0.3, 4, None), (0.3, 4, 9), (0.3, 4, 1, "before_run")):
        assert not alerts(*quiet)


def test_log_file(tmp_path, spark):
    path = tmp_path / "logs" / "p.log"
    for observer in (LoggingObserver(path), LoggingObserver(path)):
        step = IdentityStep()
        step.attach(observer)
        step.run(spark.range(1))
    LoggingObserver(path).update({"event": "run_error", "step": "s", "error": "E"})
    LoggingObserver(path).update({"event": "other", "step": "s"})
    lines = path.read_text().splitlines()
    assert len(lines) == 6 and "[identity] start" in lines[0] and "[identity] done" in lines[1] and "ERROR" in lines[4] and " | " in lines[5]


def test_subject_checks_observers_when_notifying():
    s = PipelineSubject()
    s.attach(object())
    with pytest.raises(TypeError):
        s.notify({})


def test_manifest(spark, source, tmp_path):
    p = Pipeline([source, RatioStep("tip_amount", "fare_amount", "r")])
    p.save(tmp_path / "deep" / "p.json")
    again = Pipeline.load(tmp_path / "deep" / "p.json")
    assert sorted(r["r"] for r in again.run(None).collect()) == [0.1, 0.15]
    (tmp_path / "bad.json").write_text('{"class": "builtins:dict", "params": {}}')
    with pytest.raises(TypeError):
        Pipeline.load(tmp_path / "bad.json")
    (tmp_path / "hostile.json").write_text('{"class": "featureflow.plans.pipeline:Pipeline", "steps": [{"class": "this:s", "params": {}}]}')
    with pytest.raises(TypeError, match="none of the packages"):
        Pipeline.load(tmp_path / "hostile.json")
    assert "this" not in sys.modules  # the module was not imported

    class Other(Pipeline): ...

    with pytest.raises(TypeError):
        Other.load(tmp_path / "deep" / "p.json")


def test_logging_and_mixins(spark, caplog):
    with caplog.at_level(logging.INFO):
        Pipeline([IdentityStep()]).run(spark.range(1))
    assert "Pipeline step=identity" in caplog.text
    assert issubclass(Pipeline, (LoggableMixin, SerializableMixin, ValidatableMixin))
    with caplog.at_level(logging.WARNING):
        Pipeline().log_warning("careful")
    assert "careful" in caplog.text
    with pytest.raises(TypeError):
        ValidatableMixin()
