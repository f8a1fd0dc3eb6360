import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from sluice.functions import codes, dates, money, text
from sluice.operators import lookup
from sluice.operators.transform import common_transform
from sluice.plans.config import TransformationConfig


def one(spark, expr_col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys()))
    return df.select(expr_col.alias("v")).first()["v"]


def test_trim_and_null_tokens(spark):
    assert one(spark, text.trim_ws("x"), x="\t a b \n") == "a b"
    assert one(spark, text.null_tokens("x"), x=" n/a ") is None
    assert one(spark, text.null_tokens("x", case_sensitive=True), x="n/a") == "n/a"
    assert one(spark, text.null_tokens("x", case_sensitive=True), x=" N/A ") is None


def test_name_and_title_case(spark):
    assert one(spark, text.name_case("x"), x="mARia elena") == "Maria Elena"
    assert one(spark, text.name_case("x"), x="o'brien-smith") == "O'Brien-Smith"
    assert one(spark, text.name_case("x"), x="  jose3  de la  peña ") == "Jose De La Peña"
    assert one(spark, text.title_case("x"), x="  acme   IMPORTS ") == "Acme Imports"


def test_email_and_phone(spark):
    assert one(spark, text.normalize_email("x"), x=" MARIA@EXAMPLE.COM ") == "maria@example.com"
    assert one(spark, text.is_valid_email("x"), x="a@b") is False
    assert one(spark, text.phone_e164("p", "c", codes.COUNTRY_DIAL_CODES), p="3001234567", c="CO") == "+573001234567"
    assert one(spark, text.phone_e164("p", "c", codes.COUNTRY_DIAL_CODES), p="+1 (555) 123", c="CO") == "+1555123"
    assert one(spark, text.phone_e164("p", "c", codes.COUNTRY_DIAL_CODES), p="573001234567", c="CO") == "+573001234567"
    assert one(spark, text.phone_e164("p", "c", codes.COUNTRY_DIAL_CODES), p="abc", c="CO") is None
    assert one(spark, text.phone_e164("p", "c", codes.COUNTRY_DIAL_CODES), p="300", c="XX") is None


def test_sku(spark):
    assert one(spark, text.normalize_sku("x"), x="abc 00123") == "ABC-123"
    assert one(spark, text.normalize_sku("x"), x="SKU--001-") == "SKU-1"
    assert one(spark, text.normalize_sku("x"), x="A-99999999999") is None
    assert one(spark, text.normalize_sku("x"), x="   ") is None


def test_snake_case():
    assert text.snake_case("Sale Date") == "sale_date"
    assert text.snake_case("TransactionID") == "transaction_id"
    assert text.snake_case("customerID") == "customer_id"
    assert text.snake_case("unit.price-x") == "unit_price_x"


def test_dates(spark):
    ts = dates.to_utc_timestamp_multi(F.col("x"))
    assert one(spark, ts, x="2026-01-15T10:00:00") == dt.datetime(2026, 1, 15, 10, 0)
    assert one(spark, ts, x="15/01/2026") == dt.datetime(2026, 1, 15)
    assert one(spark, ts, x="03/04/2026") == dt.datetime(2026, 4, 3)  # day-first wins
    assert one(spark, ts, x="12/31/2026") == dt.datetime(2026, 12, 31)
    assert one(spark, ts, x="20260102") == dt.datetime(2026, 1, 2)
    assert one(spark, ts, x="31/02/2026") is None
    assert one(spark, ts, x="2026-3-2") is None
    bogota = dates.to_utc_timestamp_multi(F.col("x"), "America/Bogota")
    assert one(spark, bogota, x="2026-01-15 10:00:00") == dt.datetime(2026, 1, 15, 15, 0)


def test_allowed_windows(spark):
    w = [{"start": "01:30", "end": "04:00", "days": ["MONDAY"]}, {"start": "23:00", "end": "01:00", "days": []}]
    pred = dates.in_allowed_windows(F.col("t"), w)
    assert one(spark, pred, t=dt.datetime(2024, 1, 1, 4, 0)) is True  # Monday, inclusive end
    assert one(spark, pred, t=dt.datetime(2024, 1, 2, 2, 0)) is False  # Tuesday
    assert one(spark, pred, t=dt.datetime(2024, 1, 1, 23, 30)) is False  # crossing midnight never matches


def test_rounding_modes(spark):
    c = F.col("x").cast("decimal(10,3)")
    expect = {"HALF_UP": "-2.35", "HALF_EVEN": "-2.34", "HALF_DOWN": "-2.34", "UP": "-2.35", "DOWN": "-2.34",
              "FLOOR": "-2.35", "CEILING": "-2.34"}
    for mode, want in expect.items():
        assert one(spark, money.round_decimal(c, 2, mode), x="-2.345") == Decimal(want), mode
    assert one(spark, money.round_decimal(F.col("x").cast("decimal(10,3)"), 2, "HALF_DOWN"), x="2.346") == Decimal("2.35")


def test_sales_amounts(spark):
    m = money.sales_amounts(F.lit("100.00"), F.lit(2), F.lit("10"))
    row = spark.range(1).select(*[v.alias(k) for k, v in m.items()]).first()
    assert (row.subtotal, row.tax_amount, row.total_amount, row.discount_rate) == (
        Decimal("180.00"), Decimal("34.20"), Decimal("214.20"), Decimal("10.00"))


def test_code_map_policies(spark):
    mapping = {"ACTV": "ACTIVE"}
    for policy, want, failed in (("REJECT", None, True), ("DEFAULT", "UNK", False), ("PASS_THROUGH", "X", False)):
        v, f = lookup.map_code(F.col("s"), mapping, policy, "UNK")
        row = spark.createDataFrame([("X",)], ["s"]).select(v.alias("v"), f.alias("f")).first()
        assert (row.v, row.f) == (want, failed)


def test_common_transform(spark):
    df = spark.createDataFrame(
        [("2026-01-15T10:00:00", "10.125", "2.005", "EUR", " ACTV ")],
        ["Sale Date", "Amount", "Fee", "Currency", "Status"])
    cfg = TransformationConfig(
        currency_field="currency", base_currency="USD", currency_rates={"EUR": Decimal("1.10")},
        monetary_fields=["amount"], date_fields=["sale_date"], code_mappings={"status": {"ACTV": "ACTIVE"}},
        derived_columns={"total_amount": "amount + fee"}, rounding_fields=["amount", "total_amount"])
    r = common_transform(df, cfg).first()
    assert r.amount == Decimal("11.14")
    assert r.total_amount == Decimal("13.14")
    assert (r.currency, r.currency_original, r.status) == ("USD", "EUR", "ACTIVE")
    assert r.sale_date == dt.datetime(2026, 1, 15, 10, 0)
    assert r.errors == []


def test_common_transform_rejects(spark):
    df = spark.createDataFrame([("1", "0", "x"), ("4", "2", "ok")], ["a", "b", "s"])
    cfg = TransformationConfig(derived_columns={"q": "a / b"}, code_mappings={"s": {"ok": "OK"}})
    rows = {r.a: r for r in common_transform(df, cfg).collect()}
    assert rows["1"].errors[0].rule == "TRANSFORM_ERROR"
    assert rows["1"].errors[0].message.startswith("Missing code mapping")
    assert rows["4"].q == Decimal("2")
