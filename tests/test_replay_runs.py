"""Replay of rejects, retry chains, seek paging, step records, untyped envelopes, code tables, merged duplicates."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sluice.operators import load, strategy
from sluice.plans import pipelines, replay, runs
from sluice.plans.config import SourceConfig, builtin, load_yaml
from sluice.plans.pipelines import run_pipeline
from sluice.plans.runs import RunStore
from sluice.sources import registry as sources
from sluice.sources.json import explode_untyped
from tests.test_faults import item_rows

AS_OF = dt.date(2026, 3, 31)


def store_of(spark, folder):
    return RunStore(spark, os.path.join(folder, "runs"))


def test_a_mended_reject_loads_once(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path)
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "items"), ["item_key"], 2, parts=2)
    cfg = builtin("item")
    cfg.validation.error_threshold_percent = 100
    raw = item_rows(spark, [("I1", "Soup", "1.5", "f"), ("I2", "Rice", "bad", "f"), ("I3", "Oats", "-2", "f"), ("I2", "Rice", "bad", "g")])
    run_pipeline(spark, cfg, raw, target, AS_OF, "run-1", store)
    assert replay.open_rejects(store, 3, cfg.id).count() == 3

    def mend(rows):
        return rows.withColumn("unit_price", F.when(F.col("unit_price") == "bad", F.lit("4")).otherwise(F.col("unit_price"))) \
            .where("not (item_key = 'I2' and _source = 'g')")

    first = replay.reprocess(spark, cfg, store, target, mend, 3, AS_OF, "run-2")
    assert (first.status, first.read, first.loaded, first.rejected) == ("PARTIAL", 2, 1, 1)
    got = {r.item_key: str(r.unit_price) for r in target.read().collect()}
    assert got == {"I1": "1.50", "I2": "4.00"}
    left = {(r.source_file, r.source_row_number): r.attempt for r in replay.open_rejects(store, 3).collect()}
    assert left == {("f", 4): 2, ("g", 5): 1}  # the price below zero once more; the row that was left out as before
    again = replay.reprocess(spark, cfg, store, target, lambda r: r, 3, AS_OF, "run-3")
    assert (again.read, again.loaded) == (2, 0)
    # three attempts of one row, two of the other: one left
    assert {r.source_row_number: r.attempt for r in replay.open_rejects(store, 3).collect()} == {5: 2}
    replay.reprocess(spark, cfg, store, target, lambda r: r, 3, AS_OF, "run-4")
    assert replay.reprocess(spark, cfg, store, target, lambda r: r, 3, AS_OF) is None
    assert target.read().count() == 2
    chain = {r.execution_id: (r.root_execution_id, r.depth, r.attempts, r.final_status)
             for r in runs.retry_chains(store.read("executions")).collect()}
    assert chain["run-1"][0] == "run-1" and chain["run-4"] == ("run-1", 3, 4, "PARTIAL")
    assert {r.execution_id: r.retry_count for r in store.read("executions").collect()}["run-3"] == 2


def test_a_failed_replay_resolves_nothing(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path)
    cfg = builtin("item")
    run_pipeline(spark, cfg, item_rows(spark, [("I1", "Soup", "x", "f")]), None, AS_OF, "run-1", store)

    class Lost(load.BucketedTable):
        def exists(self):
            raise RuntimeError("connection lost")

    mend = lambda rows: rows.withColumn("unit_price", F.lit("1"))
    result = replay.reprocess(spark, cfg, store, Lost(spark, os.path.join(tmpdir_path, "t"), ["item_key"]), mend, 3, AS_OF, "run-2")
    assert result.status == "FAILED" and replay.open_rejects(store, 3).count() == 1


def test_chains_of_several_levels_and_lost_parents(spark):
    rows = [("a", None, "FAILED"), ("b", "a", "FAILED"), ("c", "b", "SUCCESS"), ("d", "gone", "FAILED"), ("e", "d", "PARTIAL"),
            ("f", "a", "FAILED"), ("g", None, "RUNNING")]
    df = spark.createDataFrame([(*r, dt.datetime(2026, 1, 1 + i)) for i, r in enumerate(rows)],
                               "execution_id string, parent_execution_id string, status string, created_at timestamp")
    got = {r.execution_id: (r.root_execution_id, r.depth, r.attempts, r.final_status) for r in runs.retry_chains(df).collect()}
    assert got == {"a": ("a", 0, 4, "SUCCESS"), "b": ("a", 1, 4, "SUCCESS"), "c": ("a", 2, 4, "SUCCESS"), "f": ("a", 1, 4, "SUCCESS"),
                   "d": ("d", 0, 2, "PARTIAL"), "e": ("d", 1, 2, "PARTIAL"), "g": ("g", 0, 1, "RUNNING")}


def test_seek_equals_offset_and_reads_one_partition(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path)
    for run, n in (("r1", 230), ("r2", 70)):
        rows = spark.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in runs.REJECT_SCHEMA])
        rows = rows.withColumns({"execution_id": F.lit(run), "source_row_number": F.monotonically_increasing_id(),
                                 "source_file": F.concat(F.lit("f"), (F.rand(1) * 3).cast("int"))})
        store.append("rejects", rows.select([f.name for f in runs.REJECT_SCHEMA]))
    every = store.read("rejects").where("execution_id = 'r1'")
    after, seen = None, []
    for _ in range(6):
        page = runs.rejects_after(store, "r1", after, 50).collect()
        seen += [(r.source_row_number, r.source_file) for r in page]
        after = seen[-1]
    order = [F.col("source_row_number"), F.col("source_file")]
    assert seen == [(r.source_row_number, r.source_file) for n in range(5) for r in runs.page(every, n, 50, order).collect()]
    plan = runs.rejects_after(store, "r1", after, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(execution_id" in plan and "GreaterThanOrEqual(source_row_number" in plan
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        runs.rejects_after(store, "r1", None, 201)


def test_unreadable_run_tables_are_no_empty_tables(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path)
    assert store.read("executions").count() == 0
    os.makedirs(store.path("executions"))
    with open(os.path.join(store.path("executions"), "part-0.parquet"), "w") as fh:
        fh.write("no parquet")
    with pytest.raises(Exception):
        store.read("executions").collect()


def test_steps_have_their_own_times_and_nothing_is_left(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path)
    result = run_pipeline(spark, builtin("item"), item_rows(spark, [("I1", "Soup", "1", "f")]), None, AS_OF, "r", store)
    steps = {r.step_name: (r.finished_at - r.started_at).total_seconds() for r in store.read("steps").collect()}
    assert all(steps[s] > 0.02 for s in ("EXTRACT", "VALIDATE_SCHEMA", "TRANSFORM", "VALIDATE_BUSINESS"))
    metrics = {r.metric_name: r.metric_value for r in runs.metrics_of(store, "r").collect()}
    assert metrics["duration_transform_ms"] > 0
    assert os.path.exists(result.staging.root.removeprefix("file:")) and result.valid().count() == 1
    result.close()
    assert not os.path.exists(result.staging.root.removeprefix("file:"))


def test_a_schema_breach_ends_the_run_at_its_step(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path)
    cfg = builtin("item")
    raw = item_rows(spark, [(None, "Soup", "1", "f")] * 3 + [("I1", "Soup", "1", "f"), ("I2", "Rice", "zz", "f")])
    result = run_pipeline(spark, cfg, raw, None, AS_OF, "r", store)
    steps = {r.step_name: r.status for r in store.read("steps").collect()}
    failing = [r.step_name for r in store.read("errors").collect()]
    assert result.status == "FAILED" and failing == ["VALIDATE_SCHEMA"]
    assert steps == {"EXTRACT": "SUCCESS", "VALIDATE_SCHEMA": "FAILED", "AUDIT": "SUCCESS"}
    rejects = store.read("rejects").collect()
    assert len(rejects) == 4
    assert all(json.loads(r.raw_data)["item_name"] in ("Soup", "Rice") and r.source_file == "f" for r in rejects)


def test_valid_rows_carry_no_json(spark):
    tagged = pipelines.tag_rows(item_rows(spark, [("I1", "Soup", "1", "f"), ("I2", "Rice", "zz", "f")]), builtin("item"), AS_OF)
    got = {r.item_key: r._raw for r in tagged.collect()}
    assert got["I1"] is None and json.loads(got["I2"])["unit_price"] == "zz"


def test_staged_frames_keep_odd_names_and_count(spark, tmpdir_path):
    staging = strategy.Staging(spark, "odd")
    df = spark.range(7).select(F.col("id").alias("a b"), F.lit(None).alias("x,;{}()=y"), F.lit(1).alias("c.d"))
    back, seen = staging.write(df, "t", {"n": F.count(F.lit(1)), "even": F.count_if(F.col("a b") % 2 == 0)})
    assert seen == {"n": 7, "even": 4} and back.columns == df.columns and back.count() == 7
    none, seen = staging.write(df.where("false"), "u", {"n": F.count(F.lit(1))})
    assert seen == {"n": 0} and none.count() == 0
    assert os.path.exists(staging.root.removeprefix("file:"))
    staging.clear()
    assert not os.path.exists(staging.root.removeprefix("file:"))


def test_untyped_envelopes(spark):
    bodies = ['{"d":{"items":[{"id":1,"v":1.5,"n":null,"odd key":"x","t":{"a":1}},{"id":2,"v":"s"}]}}', '{"d":{"items":[]}}',
              '{"d":{"items":[{"id":30000000000,"extra":true}]}}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "k int, body string")
    out = explode_untyped(df, "body", "d.items", keep=["k"])
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    assert kinds["id"] == "bigint" and kinds["v"] == "variant" and kinds["n"] == "string" and kinds["extra"] == "boolean"
    assert kinds["t"] == "struct<a:bigint>"
    rows = {(r.k, r._pos): r for r in out.withColumn("v", F.col("v").cast("string")).collect()}
    assert set(rows) == {(0, 0), (0, 1), (2, 0)} and rows[0, 0].v == "1.5" and rows[0, 1].v == "s" and rows[0, 0]["odd key"] == "x"
    plain = explode_untyped(spark.createDataFrame([('{"a":[1,2]}',)], "body string"), "body", "a")
    assert [r.v for r in plain.select(F.col("value").cast("int").alias("v")).orderBy("v").collect()] == [1, 2]
    for bad in ('{"d":{"items":{"x":1}}}', '{"d":{}}', '{"d":{"items":5}}'):
        with pytest.raises(Exception, match="is not an array"):
            explode_untyped(spark.createDataFrame([(bad,)], "body string"), "body", "d.items").collect()


def test_every_source_says_where_its_rows_come_from(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "j")
    os.makedirs(folder)
    for name in ("a", "b"):
        with open(os.path.join(folder, f"{name}.json"), "w") as fh:
            json.dump([{"id": name, "n": 1}], fh)
    rows = sources.extract(spark, SourceConfig(type="JSON", location=folder)).collect()
    assert {(r.id, os.path.basename(r._source)) for r in rows} == {("a", "a.json"), ("b", "b.json")}
    assert len({r._extracted_at for r in rows}) == 1 and all(r._row is not None for r in rows)
    with open(os.path.join(tmpdir_path, "e.json"), "w") as fh:
        json.dump({"data": [{"id": 1}, {"id": 2}]}, fh)
    cfg = SourceConfig(type="JSON", location=os.path.join(tmpdir_path, "e.json"), properties={"responseArrayPath": "data"})
    assert sorted((r.id, r._row, os.path.basename(r._source)) for r in sources.extract(spark, cfg).collect()) == [(1, 1, "e.json"), (2, 2, "e.json")]


def test_code_tables_and_merged_duplicates_from_config(spark, tmpdir_path):
    place = os.path.join(tmpdir_path, "codes")
    spark.createDataFrame([("1", "ONE"), ("2", "TWO")], "code string, name string").write.parquet(place)
    cfg = load_yaml(f"""
pipeline:
  id: p
  name: p
  validation-config:
    unique-key-columns: [k]
    duplicates: consolidate
    consolidate: {{by: at, sum: [n], latest: [state]}}
  transformation-config:
    code-tables:
      state: {{location: {place}, key: code, value: name}}
""")
    day = dt.date(2026, 1, 1)
    rows = [("a", 1, "1", day, 1, "x"), ("a", 2, "2", day.replace(day=2), 2, "x"), ("a", 4, "1", day.replace(day=2), 3, "y"),
            ("b", 8, "9", day, 4, "x"), ("b", 16, None, None, 5, "x"), ("b", 32, "2", None, 6, "x")]
    raw = spark.createDataFrame(rows, "k string, n long, state string, at date, _row long, _source string")
    got = {(r.k, r._row): (r.n, r.state, r.at, r._step, r._src_rows) for r in pipelines.tag_rows(raw, cfg, AS_OF).collect()}
    # the unknown code is rejected on its own; a later date wins, equal dates keep the earlier row, no date never wins
    assert got == {("a", 1): (7, "TWO", day.replace(day=2), None, 3), ("b", 4): (8, None, day, "TRANSFORM", None),
                   ("b", 5): (48, None, None, None, 2)}
    for bad in ("duplicates: sometimes", "duplicates: CONSOLIDATE"):
        with pytest.raises(ValueError):
            load_yaml(f"pipeline:\n  id: p\n  name: p\n  validation-config:\n    {bad}\n")


def test_large_sales_reject_their_row(spark):
    cols = "transaction_id,customer_id,product_id,amount,currency,sale_date,salesperson_id,channel,product_quantity,discount_rate"
    line = ["C-100", "P-100", "10.50", "USD", "2026-03-01", "S-001", "1", "1", "0"]
    big = [*line]
    big[2], big[7] = "900000000000", "99999"
    raw = spark.createDataFrame([(f"T{i}", *x, i, "f") for i, x in enumerate([line] * 99 + [big])],
                                ", ".join(f"{c} string" for c in cols.split(",")) + ", _row long, _source string")
    result = run_pipeline(spark, builtin("sales"), raw, None, AS_OF)
    assert (result.status, result.loaded, result.rejected) == ("PARTIAL", 99, 1), result.errors
    assert "out of range" in result.rejects().first().errors[0].message
