"""Steps whose cost must grow no faster than the rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.operators import dedup, lookup, strategy
from sluice.plans import pipelines
from sluice.plans.config import builtin


@pytest.fixture()
def many(spark):
    """No table counts as small."""
    spark.conf.set(strategy.BROADCAST_CONF, "0")
    yield spark
    spark.conf.unset(strategy.BROADCAST_CONF)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan_of(df).split("Initial Plan")[-1].count("Exchange hashpartitioning")


def keyed(spark):
    rows = [("hot", 9 - i % 3, i, i % 5 > 0) for i in range(40)]
    rows += [("b", None, 50, True), ("b", 1, 51, True), ("c", 1, 52, True), (None, 2, 53, True), (None, 1, 54, True),
             (None, 1, 54, True), (None, 0, 55, False)]
    return spark.createDataFrame(rows, "k string, o int, _row long, fit boolean")


@pytest.mark.parametrize("hot_rows", [200_000, 10])
@pytest.mark.parametrize("reject_all", [False, True])
def test_many_repeated_keys_flag_what_few_do(many, monkeypatch, hot_rows, reject_all):
    monkeypatch.setattr(dedup, "HOT_ROWS", hot_rows)
    df = keyed(many)

    def flags():
        out = dedup.duplicate_flags(df, ["k"], order_cols=["o"], reject_all=reject_all, where=F.col("fit"))
        assert out.columns == [*df.columns, "_dup"]
        return sorted(((r.k or "", r._row, r._dup) for r in out.collect()))

    windowed = flags()
    many.conf.unset(strategy.BROADCAST_CONF)
    assert windowed == flags() and len(windowed) == df.count()
    assert not any(dup for k, row, dup in windowed if row in (0, 55))


def test_rows_of_many_repeated_keys_move_once(many):
    flagged = dedup.duplicate_flags(keyed(many), ["k"], order_cols=["o"])
    flagged.collect()
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_large_catalogs_are_hashed_not_sorted(many):
    rows = many.createDataFrame([("a", 1), ("x", 2), (None, 3)], "k string, _row long")
    catalog = many.createDataFrame([("a",), ("b",)], "code string")
    flagged, known, _ = lookup.catalog_flags(rows, "k", catalog, "code")
    assert {(r._row, r[known]) for r in flagged.collect()} == {(1, True), (2, False), (3, None)}
    assert "SortMergeJoin" not in flagged._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("reject_all", [False, True])
def test_rows_that_lie_by_their_key_stay_there(many, reject_all):
    lines = many.createDataFrame([(i % 7, i % 3, 90 - i, i, i % 4 > 0) for i in range(60)], "a long, n int, o int, _row long, fit boolean")
    orders = many.createDataFrame([(i, "x") for i in range(7)], "b long, c string")
    joined = lines.join(orders, lines.a == orders.b).withColumn("k", F.when(F.col("n") > 0, F.concat_ws("-", "a", "n")))
    assert not dedup.crowded(joined, ["a"])

    def flags(where, **how):
        out = dedup.duplicate_flags(joined, ["k"], order_cols=["o"], reject_all=reject_all, where=where, **how)
        return out, sorted((r._row, r._dup) for r in out.collect())

    fit = F.col("fit") & F.col("k").isNotNull()  # rows without a key do not agree in their order
    lying, near = flags(fit, near=["a"])
    assert near == flags(fit)[1] and any(dup for _, dup in near)
    assert exchanges(lying) == exchanges(joined) and "hashpartitioning(k#" not in plan_of(lying)


def test_crowded_columns(many, monkeypatch):
    df = many.createDataFrame([(1,), (1,), (2,)], "a int")
    assert not dedup.crowded(df, ["a"])
    assert dedup.crowded(df.union(many.createDataFrame([(None,)], "a int")), ["a"])
    monkeypatch.setattr(dedup, "HOT_ROWS", 1)
    assert dedup.crowded(df, ["a"])


@pytest.mark.parametrize("limit, near", [("2", []), ("0", ["a"]), ("0", [])])
def test_unlisted_values_come_to_the_rows(many, limit, near):
    many.conf.set(strategy.BROADCAST_CONF, limit)
    lines = many.createDataFrame([(i % 4, k, i) for i, k in enumerate(["a", "b", "x", None, "c", "x", "b", None])], "a long, k string, _row long")
    rows = lines.join(many.createDataFrame([(i,) for i in range(4)], "z long"), F.col("a") == F.col("z"))
    catalog = many.createDataFrame([("a", True), ("b", False), ("b", False), ("c", True)], "code string, on boolean")
    flagged, known, active = lookup.catalog_flags(rows, "k", catalog, "code", active=F.col("on"), near=near)
    want = {"a": (True, True), "b": (True, False), "x": (False, False), "c": (True, True), None: (None, None)}
    got = flagged.collect()
    assert len(got) == 8 and all((r[known], r[active]) == want[r.k] for r in got)
    assert flagged.columns == [*rows.columns, known, active]
    if near or limit != "0":  # no row is dealt out by the value
        assert "hashpartitioning(k#" not in flagged._jdf.queryExecution().executedPlan().toString()


def test_rows_that_lie_by_their_key_are_not_stored(spark, monkeypatch):
    cfg = builtin("sales")
    names = ["transaction_id", "customer_id", "product_id", "amount", "currency", "sale_date", "salesperson_id", "channel"]
    rows = [(f"T{i % 5}", "C-100", "P-100", "5" if i % 4 else "x", "USD", "2024-01-05", "S-001", "1", i, i % 5) for i in range(20)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + ", _row long, _order int")

    def outcome(**how):
        return {(r._row, r._step, r._labels, r.total_amount) for r in pipelines.tag_rows(raw, cfg, dt.date(2024, 2, 1), **how).collect()}

    stored = outcome()
    monkeypatch.setattr(strategy.Staging, "write", None)
    assert outcome(near=["_order"]) == stored and len({step for _, step, *_ in stored}) == 3


def test_duplicates_are_told_before_catalogs_are_joined(spark):
    cfg = builtin("sales")
    names = ["transaction_id", "customer_id", "product_id", "amount", "currency", "sale_date", "salesperson_id", "channel"]
    rows = [("T1", "C-100", "P-100", "5", "USD", "2024-01-05", "S-001", "1", i) for i in (1, 2)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + ", _row long")
    seen = []

    def catalogs(df):
        seen.extend(df.columns)
        return df

    tagged = pipelines.tag_rows(raw, cfg, dt.date(2024, 2, 1), catalog_frames=catalogs)
    assert {(r._row, r._labels) for r in tagged.collect()} == {(1, ""), (2, "UNIQUE_BUSINESS_KEY:transaction_id")}
    assert "_dup" in seen
