import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.operators import dedup, quality, rules
from sluice.plans.config import FutureDateRule, RangeRule, ValidationConfig


def errors_by_row(df, key="id"):
    return {r[key]: sorted(e.rule for e in r.errors) for r in df.collect()}


def test_missing_mandatory_column_rejects_every_row(spark):
    df = spark.createDataFrame([("1", "10")], ["id", "amount"])
    cfg = ValidationConfig(mandatory_columns=["id", "amount", "currency"], column_types={"amount": "DECIMAL"})
    out = rules.validate_schema(df, cfg).first()
    assert [(e.rule, e.field) for e in out.errors] == [("MANDATORY_COLUMN_MISSING", "currency")]


def test_schema_types_patterns(spark):
    df = spark.createDataFrame(
        [("1", "abc", " 5", "2026-13-01", "yes", "x1"), ("2", "1.5e3", "7", "15/01/2026", "TRUE", "AB"),
         ("3", " ", None, None, None, None)],
        "id string, amount string, qty string, d string, flag string, code string")
    cfg = ValidationConfig(mandatory_columns=["id", "amount"],
                           column_types={"amount": "DECIMAL", "qty": "INTEGER", "d": "DATE", "flag": "BOOLEAN"},
                           column_patterns={"code": "[A-Z]+"}, date_format="dd/MM/yyyy")
    got = errors_by_row(rules.validate_schema(df, cfg))
    assert got["1"] == ["PATTERN_MISMATCH"] + ["TYPE_COMPATIBILITY"] * 4
    assert got["2"] == []
    assert got["3"] == ["NOT_NULL_OR_EMPTY", "TYPE_COMPATIBILITY"]  # blank is not null: both fire


def test_business_rules(spark):
    df = spark.createDataFrame(
        [(1, "TX-1", "-10", "P-9", "5", "2026-03-20", "ONLINE"),
         (2, "TX-1", "10", "P-1", "150", "2026-03-26", "PARTNER"),
         (3, "TX-3", "0", "P-1", "100", "2026-03-27", "ONLINE")],
        "_row long, id string, amount string, product string, disc string, d string, channel string")
    cfg = ValidationConfig(
        amount_fields=["amount"], range_rules={"disc": RangeRule(Decimal(0), Decimal(100), True)},
        future_date_fields=["d"], future_date_rules={"d": FutureDateRule(2, "channel", ["PARTNER"])},
        catalog_values={"product": ["P-1"]}, active_catalog_values={"product": ["P-1"]},
        unique_key_columns=["id"])
    checks = rules.business_checks(df, cfg, dt.date(2026, 3, 24))
    flagged = dedup.duplicate_flags(df, ["id"], row_id="_row")
    checks.append(rules.duplicate_error(["id"], "_dup"))
    got = errors_by_row(rules.attach_errors(flagged, checks), "_row")
    assert got[1] == ["ACTIVE_REFERENCE", "CATALOG_LOOKUP", "NON_NEGATIVE_AMOUNT"]
    assert got[2] == ["RANGE_CHECK", "UNIQUE_BUSINESS_KEY"]  # 26th is within PARTNER's +2 days
    assert got[3] == ["FUTURE_DATE"]


def test_quality_thresholds():
    r = quality.evaluate(10, 6, 5.0)
    assert r.error_rate == 60.0 and r.breached
    assert quality.evaluate(10000, 501, 5.0).breached
    assert not quality.evaluate(10000, 500, 5.0).breached
    assert quality.evaluate(0, 0, 5.0).error_rate == 0.0
    with pytest.raises(quality.QualityGateBreached):
        quality.gate(quality.evaluate(10000, 501, 5.0), True)
    assert quality.gate(quality.evaluate(10000, 501, 5.0), False).breached


def test_quality_report_frame(spark):
    df = spark.createDataFrame([(["x"],), ([],), ([],)], "errors array<string>")
    row = quality.quality_report(df, 5.0).first()
    assert (row.total, row.rejected, row.valid, row.error_rate, row.breached) == (3, 1, 2, Decimal("33.33"), True)


@pytest.mark.parametrize("limit", ["1000000", "0"])
def test_keep_first_and_reject_all_both_paths(spark, limit):
    spark.conf.set("sluice.broadcast.rowLimit", limit)
    try:
        rows = [(i, k) for i, k in enumerate(["a", "b", "a", None, None, "c", "a"], start=1)]
        df = spark.createDataFrame(rows, "_row long, k string")
        kf = {r._row: r._dup for r in dedup.keep_first(df, ["k"]).collect()}
        assert kf == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True}
        ra = {r._row: r._dup for r in dedup.reject_all(df, ["k"]).collect()}
        assert ra == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True}
    finally:
        spark.conf.set("sluice.broadcast.rowLimit", "1000000")


def test_hot_key_dedup(spark):
    # one key holds most rows: the aggregate pre-combines it map-side
    df = spark.range(0, 20000).select((F.col("id") + 1).alias("_row"),
                                      F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    out = dedup.keep_first(df, ["k"]).groupBy("_dup").count().collect()
    counts = {r._dup: r["count"] for r in out}
    assert counts[False] == 6667 + 1 and counts[True] == 20000 - 6668


def test_consolidate_latest(spark):
    df = spark.createDataFrame(
        [(2, "ABC-123", "W-001", 5, 1, Decimal("10.50"), dt.datetime(2026, 3, 23), "x"),
         (3, "ABC-123", "W-001", 7, 2, Decimal("12.00"), dt.datetime(2026, 3, 24), "y"),
         (4, "SKU-1", "W-002", 4, 0, Decimal("5.00"), dt.datetime(2026, 3, 25), "z"),
         (5, "SKU-1", "W-002", 6, 0, Decimal("5.50"), dt.datetime(2026, 3, 25), "w")],
        "_row long, sku string, wh string, on_hand long, reserved long, cost decimal(18,2), updated timestamp, note string")
    out = {r.sku: r for r in dedup.consolidate_latest(df, ["sku", "wh"], ["on_hand", "reserved"], "updated",
                                                       ["cost"]).collect()}
    a = out["ABC-123"]
    assert (a.on_hand, a.reserved, a.cost, a.note, a._row) == (12, 3, Decimal("12.00"), "x", 2)
    s = out["SKU-1"]
    assert (s.on_hand, s.cost, s._merged_rows) == (10, Decimal("5.00"), 2)  # tie keeps the earlier row
