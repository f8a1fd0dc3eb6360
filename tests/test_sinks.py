import datetime as dt
import glob
import json
import os

import pytest

from sluice.plans import sinks
from sluice.plans.config import builtin
from sluice.plans.pipelines import run_pipeline
from sluice.plans.runs import RunStore
from tests.test_faults import item_rows

AS_OF = dt.date(2026, 3, 31)


class Failing(sinks.JsonLinesLoader):
    """A loader whose second row of a task cannot be written, after its file was."""

    def load(self, rows):
        receipt = super().load(rows)
        if any(json.loads(line)["item_key"] == "I3" for f in glob.glob(f"{self.options['root']}/_pending/*/{receipt[0]}") for line in open(f)):
            raise OSError("disk full")
        return receipt


@pytest.fixture()
def registered(tmpdir_path):
    sinks.register_sink("files", sinks.JsonLinesLoader, root=os.path.join(tmpdir_path, "good"))
    sinks.register_sink("failing", Failing, root=os.path.join(tmpdir_path, "bad"))
    yield tmpdir_path
    sinks.SINKS.clear()


def rows(spark):
    return item_rows(spark, [("I1", "Soup", "1.5", "f"), ("I2", "Rice", "2", "f"), ("I3", "Oats", "-1", "f"), ("I4", "Tea", "3", "f")])


def files(root):
    return [f for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f)]


def test_a_registered_sink_receives_a_run(spark, registered):
    cfg = builtin("item")
    cfg.validation.error_threshold_percent = 50
    result = run_pipeline(spark, cfg, rows(spark).repartition(3), None, AS_OF, "run-2", sink="Files")
    assert (result.status, result.loaded, result.rejected) == ("PARTIAL", 3, 1)
    got = [json.loads(line) for f in files(f"{registered}/good") for line in open(f)]
    assert {(r["item_key"], r["etl_execution_id"]) for r in got} == {(k, "run-2") for k in ("I1", "I2", "I4")}
    assert not os.path.exists(f"{registered}/good/_pending/run-2")


def test_an_aborted_task_leaves_nothing(spark, registered):
    cfg = builtin("item")
    store = RunStore(spark, os.path.join(registered, "runs"))
    good = item_rows(spark, [(f"I{i}", "Soup", "1", "f") for i in range(1, 7)]).repartition(3)
    result = run_pipeline(spark, cfg, good, None, AS_OF, "run-3", store, sink="failing")
    assert result.status == "FAILED" and result.exception is not None
    assert files(f"{registered}/bad") == []
    steps = {r.step_name: r.status for r in store.read("steps").collect()}
    assert steps["LOAD"] == "FAILED" and steps["VALIDATE_BUSINESS"] == "SUCCESS"
    assert [r.step_name for r in store.read("errors").collect()] == ["LOAD"]


def test_unknown_sinks_fail_the_run(spark):
    result = run_pipeline(spark, builtin("item"), item_rows(spark, [("I1", "Soup", "1", "f")]), None, AS_OF, sink="nowhere")
    assert result.status == "FAILED" and "No loader" in result.errors[0]
