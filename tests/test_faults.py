"""Faults that must not lose or multiply rows: restarts, competing writers, failed loads, colliding row numbers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sluice.operators import dedup, load, strategy
from sluice.plans.config import builtin
from sluice.plans.pipelines import run_pipeline
from sluice.plans.runs import RunStore
from sluice.streaming.landing import landing_stream, run_on_batches

AS_OF = dt.date(2026, 3, 31)
ITEM = "item_key,item_name,desc,unit_price,man_country,supplier,unit"


def item_rows(spark, rows):
    raw = spark.createDataFrame(
        [(k, n, None, p, "peru", "acme", "CANS", i + 2, s) for i, (k, n, p, s) in enumerate(rows)],
        ", ".join(f"{c} string" for c in ITEM.split(",")) + ", _row long, _source string",
    )
    return raw.withColumnsRenamed({"desc": "description", "man_country": "manufacturer_country", "supplier": "supplier_name"})


@pytest.mark.parametrize("limit", ["1000000", "0"])
def test_equal_row_numbers_of_two_sources(spark, limit):
    rows = [("I1", "a", 1), ("I2", "a", 2), ("I1", "b", 1), ("I3", "b", 2), (None, "a", 3), (None, "b", 3)]
    df = spark.createDataFrame(rows, "k string, _source string, _row long")
    spark.conf.set(strategy.BROADCAST_CONF, limit)
    try:
        first = dedup.duplicate_flags(df, ["k"], row_id=["_source", "_row"]).collect()
        every = dedup.duplicate_flags(df, ["k"], row_id=["_source", "_row"], reject_all=True).collect()
        # a row number that is not unique flags no wrong row twice and multiplies none
        loose = dedup.duplicate_flags(df, ["k"], row_id="_row").collect()
    finally:
        spark.conf.unset(strategy.BROADCAST_CONF)
    assert {(r.k, r._source) for r in first if r._dup} == {("I1", "b"), (None, "b")} and len(first) == 6
    assert {(r.k, r._source) for r in every if r._dup} == {("I1", "a"), ("I1", "b"), (None, "a"), (None, "b")}
    assert len(loose) == len(every) == 6


def test_hot_key_plans_without_sort_over_all_rows(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("_row"))
    flagged = dedup.duplicate_flags(df, ["k"])
    assert flagged.filter("_dup").count() == 999 and flagged.filter("not _dup").first()._row == 0


def above_scans(df):
    """Per scan of a bucketed table: the operators above it, from the scan up; any kind of join is a Join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Bucketed: true" in line:
            depth, nodes = len(line) - len(line.lstrip(" :+-")), []
            for up in reversed(lines[:i]):
                at = len(up) - len(up.lstrip(" :+-"))
                if at < depth:
                    depth = at
                    name = up.lstrip(" :+-").split(" ")[0]
                    nodes.append("Join" if "Join" in name else name)
            out.append(nodes)
    return out


def test_merge_reads_the_target_without_an_exchange(spark, tmpdir_path):
    """Only the batch is shuffled, into the target's buckets, however many shuffle partitions the session has."""
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k", "n"], 4, parts=3)
    t.create(spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("n"), F.lit(1).alias("v")))
    batch = spark.range(1990, 2010).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("n"), F.lit(2).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for frame in (load.merge_frame(t.read(), batch, ["k", "n"]), load.insert_new_rows(t.read(), batch, ["k", "n"])):
            above = above_scans(frame)
            assert above and all("Join" in nodes and "Exchange" not in nodes[: nodes.index("Join")] for nodes in above)
        by_key = t.read().groupBy("k", "n").count()
        assert "Exchange" not in by_key._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_upsert_rewrites_only_folders_with_a_matched_key(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k"], 2, parts=16)
    t.create(spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v")))
    before = {f: os.path.getmtime(f) for f in _files(t.root)}
    assert t.upsert(spark.createDataFrame([("17", 5), ("new", 6)], "k string, v int")) == {"updated": 1, "inserted": 1}
    kept = [f for f in before if os.path.exists(f)]
    assert len(before) * 15 // 16 - 2 <= len(kept) < len(before)
    again = load.BucketedTable(spark.newSession(), t.root, ["k"], 99)  # the stored layout counts
    got = {r.k: r.v for r in again.read().where("v > 0").collect()}
    assert got == {"17": 5, "new": 6} and again.read().count() == 4001 and again.num_buckets == 2
    with pytest.raises(ValueError, match="keyed by"):
        load.BucketedTable(spark, t.root, ["v"]).read()
    with pytest.raises(FileExistsError):
        t.create(spark.createDataFrame([("a", 1)], "k string, v int"))


def test_loads_of_nothing(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k"], 2)
    none = spark.createDataFrame([], "k string, v int")
    t.create(none)
    assert t.read().count() == 0 and t.upsert(none) == {} and t.insert(none) == {}
    t.upsert(spark.createDataFrame([("a", 1)], "k string, v int"))
    assert t.replace(none) == {} and t.read().count() == 0
    assert t.rollback("nobody") == 0


def test_history_restores_an_earlier_state(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k"], 2, parts=4, history=True)
    t.create(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"))
    states = [{r.k: r.v for r in t.read().collect()}]
    t.upsert(spark.createDataFrame([("a", 2), ("c", 2)], "k string, v int"))
    states.append({r.k: r.v for r in t.read().collect()})
    t.insert(spark.createDataFrame([("d", 3)], "k string, v int"))
    states.append({r.k: r.v for r in t.read().collect()})
    t.replace(spark.createDataFrame([("z", 4)], "k string, v int"))
    assert t.version == 4
    for version in (3, 1, 2):
        t.restore(version)
        assert {r.k: r.v for r in t.read().collect()} == states[version - 1]
    assert t.version == 7
    with pytest.raises(FileNotFoundError):
        t.restore(99)


def test_insert_appends_only_new_rows(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k"], 4)
    t.create(spark.range(20000).select(F.col("id").cast("string").alias("k"), F.rand(1).alias("v")))
    before = set(_files(t.root))
    batch = spark.range(19990, 20010).select(F.col("id").cast("string").alias("k"), F.lit(0.0).alias("v"), F.col("id").alias("_row"))
    counts = t.insert(batch.unionByName(batch.withColumns({"v": F.lit(1.0), "_row": F.col("_row") + 100})), "_row")
    assert counts == {"inserted": 10}
    added = sum(os.path.getsize(f) for f in _files(t.root) if f not in before)
    assert added < 0.1 * sum(os.path.getsize(f) for f in before)
    assert t.read().where("k >= '20000' and length(k) = 5 and v = 0").count() == 10
    assert t.read().count() == 20010


def test_table_without_key_appends(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), [], 4)
    t.create(spark.createDataFrame([("a", 1)], "k string, v int"))
    t.insert(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"))
    assert t.read().count() == 3


def test_null_keys_never_conflict(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k"], 4)
    t.create(spark.createDataFrame([(None, 1)], "k string, v int"))
    counts = t.insert(spark.createDataFrame([(None, 2), (None, 3), ("a", 4), ("a", 5)], "k string, v int"))
    assert counts == {"inserted": 3}


def test_columns_beyond_the_target_are_refused(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k"], 4)
    t.create(spark.createDataFrame([("a", 1)], "k string, v int"))
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([("a", 1, 2)], "k string, v int, w int"))
    with pytest.raises(ValueError):
        load.BucketedTable(spark, os.path.join(tmpdir_path, "u"), ["k"], 4).create(
            spark.createDataFrame([("a",)], ["bad;name"]))


def _files(root):
    return [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")]


class Broken(load.BucketedTable):
    """A target whose merge commits and then loses its connection."""

    def upsert(self, *args, **kwargs):
        super().upsert(*args, **kwargs)
        raise RuntimeError("connection lost")


def test_failed_load_is_recorded_and_rolled_back(spark, tmpdir_path):
    cfg = builtin("item")
    store = RunStore(spark, os.path.join(tmpdir_path, "runs"))
    target = Broken(spark, os.path.join(tmpdir_path, "items"), ["item_key"], 4)
    raw = item_rows(spark, [(f"I{i}", "Soup", "1.5", "f") for i in range(99)] + [("I100", "Rice", "-1", "f")])
    result = run_pipeline(spark, cfg, raw, target, AS_OF, "run-1", store)
    assert result.status == "FAILED" and isinstance(result.exception, RuntimeError)
    assert target.read().count() == 0
    run = store.read("executions").collect()
    assert [r.status for r in run] == ["FAILED"] and "connection lost" in run[0].error_summary
    assert run[0].total_read == 100 and store.read("rejects").count() == 1
    audit = store.read("audit").collect()
    assert [r.status for r in audit] == ["FAILED"] and "connection lost" in audit[0].details
    steps = {r.step_name: r.status for r in store.read("steps").collect()}
    assert steps["LOAD"] == "FAILED" and steps["VALIDATE_BUSINESS"] == "SUCCESS" and steps["AUDIT"] == "SUCCESS"
    assert [r.severity for r in store.read("errors").collect()] == ["CRITICAL"]


def test_steps_of_a_good_run(spark, tmpdir_path):
    store = RunStore(spark, os.path.join(tmpdir_path, "runs"))
    raw = item_rows(spark, [("I1", "Soup", "1.5", "f"), ("I2", "Rice", "2", "g")])
    result = run_pipeline(spark, builtin("item"), raw, None, AS_OF, "run-2", store)
    assert result.status == "SUCCESS"
    steps = store.read("steps").orderBy("step_order").collect()
    assert [s.step_name for s in steps] == [
        "EXTRACT", "VALIDATE_SCHEMA", "TRANSFORM", "VALIDATE_BUSINESS", "LOAD", "CLOSE", "AUDIT"]
    assert all(s.status == "SUCCESS" and s.finished_at >= s.started_at for s in steps)
    assert store.read("errors").count() == 0


def test_stream_restart_loads_the_file_that_came_between(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "landing")
    os.makedirs(land)
    cfg = builtin("item")
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "items"), ["item_key"], 4)
    store = RunStore(spark, os.path.join(tmpdir_path, "runs"))

    def run(session, name, key):
        with open(os.path.join(land, name), "w") as fh:
            fh.write(f"{ITEM}\n{key},Soup,,1.5,peru,acme,CANS\n")
        stream = landing_stream(session, land, cfg, ITEM.split(","))
        return run_on_batches(session, stream, cfg, target, store, AS_OF)[1]

    assert [r.loaded for r in run(spark, "a.csv", "I1")] == [1]
    # another session has another checkpoint folder of its own
    spark.sparkContext.setCheckpointDir(os.path.join(tmpdir_path, "other"))
    assert [r.loaded for r in run(spark.newSession(), "b.csv", "I2")] == [1]
    assert sorted(r.item_key for r in target.read().collect()) == ["I1", "I2"]
    assert store.read("executions").count() == 2


def test_numbers_out_of_range_reject_their_row_only(spark):
    raw = item_rows(spark, [("I1", "Soup", "1.5", "f"), ("I2", "Rice", "1e30", "f"), ("I3", "Oats", "1e60", "f")])
    result = run_pipeline(spark, builtin("item"), raw, None, AS_OF)
    assert result.status in ("PARTIAL", "FAILED") and result.exception is None
    assert {r.item_key for r in result.rejects().collect()} == {"I2", "I3"}


def test_readers_of_a_run(spark, tmpdir_path):
    from sluice.plans import runs

    store = RunStore(spark, os.path.join(tmpdir_path, "runs"))
    raw = item_rows(spark, [("I1", "Soup", "1.5", "f")])
    run_pipeline(spark, builtin("item"), raw, None, AS_OF, "run-3", store)
    assert [r.step_name for r in runs.steps_of(store, "run-3").collect()][0] == "EXTRACT"
    assert [r.status for r in runs.audit_of(store, "run-3").collect()] == ["SUCCESS"]
    assert runs.errors_of(store, "run-3").count() == 0
    names = [r.metric_name for r in runs.metrics_of(store, "run-3").collect()]
    assert names == sorted(names) and "records_read" in names and "duration_load_ms" in names
    page, total, pages = runs.page_with_total(spark.range(45), 2, 20, [F.col("id")])
    assert (total, pages, [r.id for r in page.collect()]) == (45, 3, list(range(40, 45)))


def test_first_attempts_have_no_parent(spark):
    from sluice.plans import runs

    table = spark.createDataFrame(
        [("a", None, "FAILED"), ("b", "a", "SUCCESS"), ("c", "zz", "FAILED")],
        "execution_id string, parent_execution_id string, status string")
    got = {r.execution_id: r.parent_status for r in runs.retry_chain(table).collect()}
    assert got == {"a": None, "b": "FAILED", "c": None}


def test_registered_transformers_and_validators(spark):
    from sluice.operators import rules
    from sluice.plans import pipelines

    def shout(df, cfg, as_of):
        return df.withColumn("item_name", F.upper("item_name")), []

    def no_soup(df, cfg, as_of):
        return [rules.check(F.col("item_name") == "SOUP", "item_name", F.col("item_name"), "NO_SOUP", "Soup is out")]

    def quiet(df, cfg, as_of):
        return df.withColumn("item_name", F.lower("item_name")), []

    raw = item_rows(spark, [("I1", "Soup", "1.5", "f"), ("I2", "Rice", "1", "f")])
    other = builtin("item")
    other.id = other.name = "other-sync"
    pipelines.register_transformer("*", quiet, "QUIET", order=200)
    pipelines.register_transformer("common", shout, "SHOUT", order=5)
    pipelines.register_validator("Other-Sync", no_soup)
    try:
        rows = {r.item_key: (r.item_name, r._labels) for r in pipelines.tag_rows(raw, other, AS_OF).collect()}
        own = {r.item_key: (r.item_name, r._labels) for r in pipelines.tag_rows(raw, builtin("item"), AS_OF).collect()}
    finally:
        pipelines.clear_extensions()
    assert rows == {"I1": ("SOUP", "NO_SOUP:item_name"), "I2": ("RICE", "")}
    assert own == {"I1": ("Soup", ""), "I2": ("Rice", "")}  # a pipeline's own transformer wins


def test_table_translation_takes_the_smallest_value(spark):
    from sluice.operators.lookup import map_table

    codes = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "code string, name string")
    df = spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    got = {r.k: r.out for r in map_table(df, "k", codes, "code", "name", "out").collect()}
    assert got == {"x": "a", "z": None, None: None}
