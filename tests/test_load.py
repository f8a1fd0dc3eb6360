import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import functions as F

from sluice.operators import load

SCHEMA = "transaction_id string, customer_id string, amount decimal(18,2), sale_date date, status string, etl_execution_id string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_upsert_insert_and_update_counts(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "sales"), ["transaction_id"], num_buckets=8)
    d = dt.date(2026, 3, 1)
    t.create(rows(spark, [("TXN-1", "C-1", Decimal("1.00"), d, "OPEN", "e0")]))
    counts = t.upsert(rows(spark, [("TXN-1", "C-2", Decimal("2.00"), d, "OPEN", "e1"),
                                     ("TXN-2", "C-1", Decimal("3.00"), d, "OPEN", "e1")]))
    by = counts
    assert by == {"updated": 1, "inserted": 1}
    cur = {r.transaction_id: r for r in t.read().collect()}
    assert cur["TXN-1"].customer_id == "C-2" and len(cur) == 2


def test_closed_guard_and_rollback(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "sales"), ["transaction_id"], num_buckets=4)
    d = dt.date(2026, 3, 1)
    t.create(rows(spark, [("TXN-400", "C-1", Decimal("10.00"), d, "CLOSED", "e0")]))
    counts = t.upsert(rows(spark, [("TXN-400", "C-9", Decimal("99.00"), d, "OPEN", "e1"),
                                     ("TXN-401", "C-1", Decimal("5.00"), d, "OPEN", "e1")]),
                         guard_column="status", guard_value="CLOSED")
    by = counts
    assert by == {"skipped_closed": 1, "inserted": 1}
    cur = {r.transaction_id: r for r in t.read().collect()}
    assert cur["TXN-400"].amount == Decimal("10.00") and cur["TXN-400"].status == "CLOSED"
    t.rollback("e1")
    assert sorted(r.transaction_id for r in t.read().collect()) == ["TXN-400"]


def test_null_guard_flag_counts_as_open(spark):
    d = dt.date(2026, 3, 1)
    target = rows(spark, [("T1", "C", Decimal("1"), d, None, "e0")])
    staging = rows(spark, [("T1", "C", Decimal("2"), d, "OPEN", "e1")])
    m = load.merge_frame(target, staging, ["transaction_id"], "status", "CLOSED").first()
    assert m._action == "updated" and m.amount == Decimal("2.00")


def test_insert_ignore_and_replace(spark, tmpdir_path):
    t = load.BucketedTable(spark, os.path.join(tmpdir_path, "x"), ["transaction_id"], num_buckets=4)
    d = dt.date(2026, 3, 1)
    t.create(rows(spark, [("A", "C", Decimal("1"), d, "OPEN", "e0")]))
    counts = t.insert(rows(spark, [("A", "C", Decimal("9"), d, "OPEN", "e1"), ("B", "C", Decimal("2"), d, "OPEN", "e1")]))
    by = counts
    assert by["inserted"] == 1
    assert {r.transaction_id: r.amount for r in t.read().collect()} == {"A": Decimal("1.00"), "B": Decimal("2.00")}
    t.replace(rows(spark, [("Z", "C", Decimal("3"), d, "OPEN", "e2")]))
    assert [r.transaction_id for r in t.read().collect()] == ["Z"]


def test_staging_checks(spark):
    d = dt.date(2026, 3, 1)
    st = rows(spark, [("A", None, Decimal("1"), d, "OPEN", "e"), ("A", "C", Decimal("1"), d, "OPEN", "e"),
                      ("B", "C", Decimal("1"), d, "OPEN", "e")])
    row = load.staging_check_frame(st, ["transaction_id"], ["customer_id"]).first()
    details = load.staging_check_details(row, 4, ["customer_id"])
    assert details == ["Row count mismatch: expected=4, actual=3",
                       "Mandatory staging column has null values: customer_id (1 rows)",
                       "Business key duplicates found in staging: 1"]


def test_constraint_rejects_are_per_row(spark):
    from sluice.operators import rules

    d = dt.date(2026, 3, 1)
    st = rows(spark, [("A", "C", Decimal("-1.00"), d, "OPEN", "e"), ("B", "C", Decimal("1.00"), d, "OPEN", "e")])
    checked = rules.attach_errors(st, load.constraint_checks(st, not_null=["customer_id"], non_negative=["amount"]))
    bad = {r.transaction_id: [e.rule for e in r.errors] for r in checked.collect()}
    assert bad == {"A": ["CHECK_CONSTRAINT"], "B": []}


def test_trace_columns_and_union(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 3.5)], "id int, b double")
    run = load.RunContext(execution_id="e", pipeline_id="p", source_file="f.csv", load_timestamp=dt.datetime(2026, 1, 1))
    out = load.add_trace_columns(load.union_for_load([a, b]), run)
    assert set(load.TRACE_COLUMNS) <= set(out.columns)
    assert sorted((r.id, r.a, r.b) for r in out.collect()) == [(1, "x", None), (2, None, 3.5)]
    assert load.checked_columns(["ok_name"]) == ["ok_name"]
    import pytest

    with pytest.raises(ValueError):
        load.checked_columns(["bad;drop"])
