import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from sluice.functions import derive
from sluice.operators import rules


def test_split_and_combine_names(spark):
    df = spark.createDataFrame([("  JOHN   doe smith ",), ("madonna",), ("  ",)], ["full"])
    f, l, bad = derive.split_name(F.col("full"), "LAST_NAME")
    got = [tuple(r) for r in df.select(f, l, bad).collect()]
    assert got == [("John", "Doe Smith", False), (None, "Madonna", False), (None, None, True)]
    f2, l2, bad2 = derive.split_name(F.col("full"), "REJECT")
    assert [r[0] for r in df.select(bad2).collect()] == [False, True, True]
    row = spark.range(1).select(derive.combine_name(F.lit(" ana "), F.lit("PEREZ  lopez"))).first()[0]
    assert row == "Ana Perez Lopez"


def test_composite_split(spark):
    df = spark.createDataFrame([("a, b ,c",), ("a",), ("a,b,c,d",)], ["s"])
    vals, failed = derive.split_composite(F.col("s"), ",", {0: "x", 1: "y", 2: "z"}, "REJECT", default="?")
    got = [tuple(r) for r in df.select(*vals.values(), failed).collect()]
    assert got == [("a", "b", "c", False), ("a", "?", "?", False), ("a", "b", "c", True)]


def test_derived_kinds(spark):
    r = spark.range(1).select(
        derive.percentage(F.lit("200.00"), F.lit(19)).alias("p"),
        derive.concatenation([F.lit("Main St"), ", ", F.lit(None).cast("string"), " ", F.lit("110111")]).alias("c"),
        derive.date_diff_days(F.lit("2026-03-31"), F.lit("2026-03-01")).alias("d"),
        derive.conditional(F.lit("A"), "A", "Active", "Inactive").alias("k"),
        derive.lookup(F.lit("CO"), {"CO": "LATAM"}, "OTHER").alias("l"),
    ).first()
    assert (r.p, r.c, r.d, r.k, r.l) == (Decimal("38.00"), "Main St,  110111", 30, "Active", "LATAM")


def test_extra_predicates(spark):
    df = spark.createDataFrame([("CC", "12345", "a@BAD.com", dt.date(2000, 1, 1)),
                                ("NIT", "123456789-1", "b@ok.com", dt.date(2026, 1, 1))],
                               "t string, n string, e string, d date")
    checks = [rules.max_age_check("d", dt.date(2026, 3, 31), 365), rules.blocked_domain_check("e", ["bad.com"]),
              rules.document_format_check("t", "n", {"CC": "[0-9]{6,10}", "NIT": "[0-9]{9}-[0-9]"})]
    got = [[e.rule for e in r.errors] for r in rules.attach_errors(df, checks).collect()]
    assert got == [["MAX_AGE", "BLOCKED_DOMAIN", "DOCUMENT_FORMAT"], []]


def test_dead_letter_and_throughput(spark):
    from sluice.plans import runs

    rej = spark.createDataFrame([("K1", dt.datetime(2026, 1, 1), "a"), ("K1", dt.datetime(2026, 1, 2), "b"),
                                 ("K2", dt.datetime(2026, 1, 1), "c")], "k string, rejected_at timestamp, reason string")
    out = {r.k: r for r in runs.dead_letter_summary(rej, ["k"], 2).collect()}
    assert (out["K1"].attempts, out["K1"].last_reason, out["K1"].retryable) == (2, "b", False)
    assert out["K2"].retryable
    r = spark.createDataFrame([("e", dt.datetime(2026, 1, 1, 0, 0, 0), dt.datetime(2026, 1, 1, 0, 0, 3), 10, 1)],
                              "execution_id string, started_at timestamp, finished_at timestamp, total_read long, total_rejected long")
    t = runs.step_throughput(r).first()
    assert (t.records_per_second, t.rejected_pct) == (Decimal("3.33"), Decimal("10.00"))


def test_near_duplicate_key(spark):
    df = spark.createDataFrame([(1, "Hello   World\n"), (2, "hello world"), (3, "hello  there")], ["id", "t"])
    keys = {r.id: r.k for r in df.select("id", rules.near_duplicate_key("t").alias("k")).collect()}
    assert keys[1] == keys[2] != keys[3]


def test_restore_and_incremental(spark, tmpdir_path):
    import os

    from sluice.operators import load
    from sluice.sources.registry import incremental, watermark

    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "t"), ["k"], 4, history=True)
    t.create(spark.createDataFrame([("a", 1)], "k string, v int"))
    t.upsert(spark.createDataFrame([("a", 2)], "k string, v int"))
    assert t.read().first().v == 2
    t.restore(1)
    assert t.read().first().v == 1
    t.upsert(spark.createDataFrame([("b", 3)], "k string, v int"))  # history is kept: the restore is version 3
    assert t.version == 4 and t.read().count() == 2
    ev = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 3))], "id int, ts timestamp")
    w = watermark(ev.filter(F.col("id") == 1), "ts")
    assert [r.id for r in incremental(ev, "ts", w).collect()] == [2]


def test_offset_timestamps_and_run_lookups(spark):
    from sluice.functions import dates
    from sluice.plans import runs

    ts = spark.createDataFrame([("2026-01-15T10:00:00-05:00",), ("2026-01-15T10:00:00Z",)], ["s"]).select(
        dates.to_utc_timestamp_multi(F.col("s")).alias("t")).collect()
    assert [r.t for r in ts] == [dt.datetime(2026, 1, 15, 15, 0), dt.datetime(2026, 1, 15, 10, 0)]
    r = spark.createDataFrame([("e1", "p1", "RUNNING"), ("e2", "p9", "SUCCESS")], "execution_id string, pipeline_id string, status string")
    p = spark.createDataFrame([("p1", "sales-daily", "ACTIVE")], "pipeline_id string, name string, status string")
    names = {x.execution_id: x.pipeline_name for x in runs.with_pipeline_names(r, p).collect()}
    assert names == {"e1": "sales-daily", "e2": "p9"}
    assert [x.execution_id for x in runs.active_runs(r).collect()] == ["e1"]
    assert runs.active_pipelines(p).count() == 1
    rej = spark.createDataFrame([("e1",), ("e1",), ("e2",)], ["execution_id"])
    assert {x.execution_id: x.rejected for x in runs.rejected_per_execution(rej).collect()} == {"e1": 2, "e2": 1}
