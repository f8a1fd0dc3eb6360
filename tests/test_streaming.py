import datetime as dt
import os

from sluice.operators import load
from sluice.plans.config import builtin
from sluice.plans.runs import RunStore
from sluice.streaming.landing import landing_stream, run_on_batches


def test_landing_files_run_as_batches(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "landing")
    os.makedirs(land)
    header = "item_key,item_name,desc,unit_price,man_country,supplier,unit\n"
    with open(os.path.join(land, "a.csv"), "w") as fh:
        fh.write(header + "I1,Soup,,1.5,peru,acme,CANS\nI2,Rice,,-2,peru,acme,BAGS\n")
    with open(os.path.join(land, "b.csv"), "w") as fh:
        fh.write(header + "I1,Soup v2,,1.75,peru,acme,CANS\n")
    cfg = builtin("item")
    cols = ["item_key", "item_name", "desc", "unit_price", "man_country", "supplier", "unit"]
    stream = landing_stream(spark, land, cfg, cols, max_files_per_trigger=1)  # one file per batch
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "items"), ["item_key"], 4)
    store = RunStore(spark, os.path.join(tmpdir_path, "runs"))
    query, results = run_on_batches(spark, stream, cfg, target, store, dt.date(2026, 3, 31), name="items-test")
    assert sum(r.read for r in results) == 3, [(r.status, r.read, r.errors) for r in results]
    assert all(r.status != "FAILED" for r in results), [(r.status, r.read, r.errors) for r in results]
    rows = {r.item_key: r for r in target.read().collect()}
    assert [r.status for r in results] == ["PARTIAL", "SUCCESS"]
    assert set(rows) == {"I1"} and rows["I1"].item_name == "Soup v2" and str(rows["I1"].unit_price) == "1.75"
    assert store.read("executions").count() == 2


def test_landed_files_are_read_as_by_a_batch(spark, tmpdir_path):
    """Header names, cells beyond the header, quoted breaks and line numbers survive the stream."""
    from sluice.plans.config import PipelineConfig
    from sluice.streaming.landing import read_landed

    land = os.path.join(tmpdir_path, "landing")
    os.makedirs(land)
    with open(os.path.join(land, "a.csv"), "w") as fh:
        fh.write('k,v\n1,2,3\n2,"x\ny"\n4,5\n')
    cfg = PipelineConfig("p", "p")
    seen = []

    def each(batch, _):
        rows = read_landed(spark, batch, cfg)
        seen.extend((r.k, r.v, r.column_3, r._row, os.path.basename(r._source)) for r in rows.collect())

    stream = landing_stream(spark, land, cfg).writeStream.foreachBatch(each).option("checkpointLocation", os.path.join(tmpdir_path, "c"))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [("1", "2", "3", 2, "a.csv"), ("2", "x\ny", None, 3, "a.csv"), ("4", "5", None, 5, "a.csv")]
