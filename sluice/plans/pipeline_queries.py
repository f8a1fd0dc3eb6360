"""The customer, inventory and item pipelines as queries, and duplicate checks over several sources.

Each takes a driver table through the schema, transform and business steps of
its built-in configuration. Values that a feed would bring (odd spelling,
codes, bad dates and numbers, repeated keys) come from CASE expressions over
the table's columns, shared as SQL text with the DuckDB twins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import dedup, strategy
from sluice.plans import pipelines
from sluice.plans.config import builtin
from sluice.plans.registry import ORACLE, register, table

AS_OF = dt.date(2026, 3, 31)
NULL_TOKENS = ("", "NULL", "N/A", "-")


def _raw(df: DataFrame, columns: dict[str, str], row: str) -> DataFrame:
    """The feed: all-string columns with null tokens resolved as the readers do, and a row number; stored once."""
    cells = [text.null_tokens(F.expr(e), NULL_TOKENS, case_sensitive=True).alias(c) for c, e in columns.items()]
    return strategy.materialize(df.select(*cells, F.col(row).cast("long").alias("_row")))


def _cells_sql(columns: dict[str, str], row: str, name: str) -> str:
    """The same feed in SQL."""
    cells = ", ".join(
        f"CASE WHEN trim({e}) IN ('', 'NULL', 'N/A', '-') THEN NULL ELSE trim({e}) END AS {c}" for c, e in columns.items()
    )
    return f"SELECT {cells}, CAST({row} AS BIGINT) AS _row FROM {name}"


def _outcome(tagged: DataFrame, values: dict[str, str]) -> DataFrame:
    ok = F.col("_step").isNull()
    return tagged.select(
        F.col("_row").alias("source_row"),
        F.col("_step").alias("step"),
        F.col("_labels").alias("rules"),
        *[F.when(ok, F.col(c).cast(t)).alias(c) for c, t in values.items()],
    )


# -------------------------------------------------------------------- item

_ITEM = {
    "item_key": "CASE WHEN p_partkey % 101 = 0 THEN 'NULL' WHEN p_partkey % 97 = 0 THEN concat(' i', CAST(p_partkey - 1 AS STRING), ' ') "
                "ELSE concat('I', CAST(p_partkey AS STRING)) END",
    "item_name": "concat('  ', p_name, '   (new)  ')",
    "unit_price": "CASE WHEN p_partkey % 31 = 0 THEN 'abc' WHEN p_partkey % 37 = 0 THEN '-5' WHEN p_partkey % 41 = 0 THEN '1e13' "
                  "WHEN p_partkey % 43 = 0 THEN '1e30' WHEN p_partkey % 47 = 0 THEN '12.005000001' "
                  "ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) END",
    "description": "CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, '   tin') ELSE '-' END",
    "manufacturer_country": "CASE WHEN p_partkey % 3 = 0 THEN 'costa  RICA' ELSE 'peru' END",
    "supplier_name": "'acme   IMPORTS'",
    "unit": "CASE WHEN p_partkey % 53 = 0 THEN 'N/A' ELSE ' CANS  Large' END",
}
_ITEM_OUT = {"item_key": "string", "item_name": "string", "unit_price": "decimal(18,2)", "description": "string",
             "manufacturer_country": "string", "supplier_name": "string", "unit": "string"}


@register("item_pipeline")
def item_pipeline(spark, sf_dir):
    raw = _raw(table(spark, sf_dir, "part"), _ITEM, "p_partkey")
    return _outcome(pipelines.tag_rows(raw, builtin("item"), AS_OF), _ITEM_OUT)


ORACLE["item_pipeline"] = f"""
WITH raw AS ({_cells_sql(_ITEM, 'p_partkey', 'part')}),
s AS (
  SELECT *, concat_ws('|',
      CASE WHEN item_key IS NULL THEN 'NOT_NULL_OR_EMPTY:item_key' END,
      CASE WHEN unit IS NULL THEN 'NOT_NULL_OR_EMPTY:unit' END,
      CASE WHEN unit_price = 'abc' THEN 'TYPE_COMPATIBILITY:unit_price' END) AS schema_rules,
    upper(item_key) AS k,
    CASE WHEN unit_price IN ('abc', '1e30') THEN NULL WHEN unit_price = '1e13' THEN CAST(10000000000000 AS DECIMAL(38,9))
         ELSE CAST(unit_price AS DECIMAL(38,9)) END AS price
  FROM raw),
t AS (
  SELECT *, CASE WHEN schema_rules <> '' THEN NULL WHEN price IS NULL THEN 'TRANSFORM_ERROR'
                 WHEN price < 0 THEN 'ITEM_TRANSFORM_ERROR' END AS transform_rule,
    schema_rules = '' AND price >= 0 AS alive
  FROM s),
d AS (
  SELECT *, alive IS TRUE AS live, row_number() OVER (PARTITION BY alive IS TRUE, k ORDER BY _row) AS rn FROM t),
b AS (
  SELECT *, CASE WHEN live THEN concat_ws('|',
      CASE WHEN round(price, 2) > 100000 THEN 'RANGE_CHECK:unit_price' END,
      CASE WHEN rn > 1 THEN 'UNIQUE_BUSINESS_KEY:item_key' END) ELSE '' END AS business_rules
  FROM d),
o AS (
  SELECT *, CASE WHEN schema_rules <> '' THEN 'VALIDATE_SCHEMA' WHEN transform_rule IS NOT NULL THEN 'TRANSFORM'
                 WHEN business_rules <> '' THEN 'VALIDATE_BUSINESS' END AS step
  FROM b)
SELECT _row AS source_row, step,
  CASE WHEN schema_rules <> '' THEN schema_rules WHEN transform_rule IS NOT NULL THEN transform_rule ELSE business_rules END AS rules,
  CASE WHEN step IS NULL THEN k END AS item_key,
  CASE WHEN step IS NULL THEN regexp_replace(item_name, '\\s+', ' ', 'g') END AS item_name,
  CASE WHEN step IS NULL THEN CAST(round(price, 2) AS DECIMAL(18,2)) END AS unit_price,
  CASE WHEN step IS NULL THEN regexp_replace(description, '\\s+', ' ', 'g') END AS description,
  CASE WHEN step IS NULL THEN CASE WHEN _row % 3 = 0 THEN 'Costa Rica' ELSE 'Peru' END END AS manufacturer_country,
  CASE WHEN step IS NULL THEN 'Acme Imports' END AS supplier_name,
  CASE WHEN step IS NULL THEN 'cans large' END AS unit
FROM o"""


# --------------------------------------------------------------- inventory

_INVENTORY = {
    "sku": "CASE WHEN o_custkey % 89 = 0 THEN concat('sku 000', CAST(o_custkey % 5 AS STRING)) "
           "WHEN o_custkey % 97 = 0 THEN 'abc - 00123' ELSE concat('SKU-', CAST(o_custkey % 5 AS STRING)) END",
    "warehouse_id": "CASE o_orderkey % 8 WHEN 0 THEN 'wh001' WHEN 1 THEN 'CENTRAL' WHEN 2 THEN 'north' WHEN 3 THEN '3' "
                    "WHEN 4 THEN 'South' WHEN 5 THEN 'WH002' WHEN 6 THEN '2' ELSE 'MARS' END",
    "quantity_on_hand": "CASE WHEN o_orderkey % 83 = 0 THEN '-1' WHEN o_orderkey % 79 = 0 THEN '1.5' "
                        "ELSE CAST(20 + o_custkey % 50 AS STRING) END",
    "quantity_reserved": "CASE WHEN o_orderkey % 71 = 0 THEN '99' WHEN o_orderkey % 3 = 0 THEN '-' ELSE CAST(o_custkey % 7 AS STRING) END",
    "unit_cost": "CASE WHEN o_orderkey % 73 = 0 THEN '1e20' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END",
    "cost_currency": "CASE WHEN o_orderkey % 4 = 0 THEN 'COP' ELSE 'USD' END",
    "last_updated": "CASE WHEN o_orderkey % 67 = 0 THEN '' ELSE concat('2026-03-', CAST(10 + o_custkey % 15 AS STRING)) END",
}
_INVENTORY_OUT = {"sku": "string", "warehouse_id": "string", "quantity_on_hand": "long", "quantity_reserved": "long",
                  "unit_cost": "decimal(18,2)", "cost_currency": "string", "currency_original": "string"}


@register("inventory_pipeline")
def inventory_pipeline(spark, sf_dir):
    raw = _raw(table(spark, sf_dir, "orders"), _INVENTORY, "o_orderkey")
    tagged = pipelines.tag_rows(raw, builtin("inventory"), AS_OF)
    out = _outcome(tagged.withColumn("last_updated", F.to_date("last_updated")), {
        **_INVENTORY_OUT, "last_updated": "date"})
    merged = tagged.select(F.col("_row").alias("source_row"), F.col("_src_rows").cast("long").alias("merged_rows"))
    return out.join(merged, "source_row")


ORACLE["inventory_pipeline"] = f"""
WITH raw AS ({_cells_sql(_INVENTORY, 'o_orderkey', 'orders')}),
s AS (
  SELECT *, concat_ws('|',
      CASE WHEN last_updated IS NULL THEN 'NOT_NULL_OR_EMPTY:last_updated' END,
      CASE WHEN quantity_on_hand = '1.5' THEN 'TYPE_COMPATIBILITY:quantity_on_hand' END) AS schema_rules,
    CASE WHEN sku = 'abc - 00123' THEN 'ABC-123' WHEN sku LIKE 'sku 000%' THEN 'SKU-' || right(sku, 1) ELSE sku END AS sku_n,
    CASE upper(warehouse_id) WHEN 'WH001' THEN 'W-001' WHEN 'CENTRAL' THEN 'W-001' WHEN 'NORTH' THEN 'W-002'
      WHEN 'WH002' THEN 'W-002' WHEN '2' THEN 'W-002' WHEN '3' THEN 'W-003' WHEN 'SOUTH' THEN 'W-003' END AS wh,
    TRY_CAST(quantity_on_hand AS BIGINT) AS oh, COALESCE(CAST(quantity_reserved AS BIGINT), 0) AS rs,
    CASE WHEN unit_cost = '1e20' THEN NULL ELSE CAST(round(CAST(unit_cost AS DECIMAL(20,8)) *
      CAST(CASE cost_currency WHEN 'COP' THEN 0.00025 ELSE 1 END AS DECIMAL(17,8)), 2) AS DECIMAL(18,2)) END AS cost,
    CAST(last_updated AS DATE) AS upd
  FROM raw),
t AS (
  SELECT *, CASE WHEN schema_rules <> '' THEN NULL WHEN cost IS NULL THEN 'TRANSFORM_ERROR'
                 WHEN wh IS NULL OR oh < 0 OR rs > oh THEN 'INVENTORY_TRANSFORM_ERROR' END AS transform_rule
  FROM s),
g AS (
  SELECT sku_n, wh, min(_row) AS _row, sum(oh) AS oh, sum(rs) AS rs, max(upd) AS upd, count(*) AS merged,
    arg_min(cost, (-epoch(upd), _row)) AS cost, arg_min(cost_currency, (-epoch(upd), _row)) AS cur_orig
  FROM t WHERE schema_rules = '' AND transform_rule IS NULL GROUP BY sku_n, wh),
b AS (
  SELECT *, concat_ws('|',
      CASE WHEN sku_n NOT IN ('SKU-1', 'SKU-2', 'SKU-3', 'ABC-123') THEN 'CATALOG_LOOKUP:sku' END) AS business_rules
  FROM g)
SELECT _row AS source_row, CASE WHEN business_rules <> '' THEN 'VALIDATE_BUSINESS' END AS step, business_rules AS rules,
  CASE WHEN business_rules = '' THEN sku_n END AS sku, CASE WHEN business_rules = '' THEN wh END AS warehouse_id,
  CASE WHEN business_rules = '' THEN CAST(oh AS BIGINT) END AS quantity_on_hand,
  CASE WHEN business_rules = '' THEN CAST(rs AS BIGINT) END AS quantity_reserved,
  CASE WHEN business_rules = '' THEN cost END AS unit_cost,
  CASE WHEN business_rules = '' THEN 'USD' END AS cost_currency,
  CASE WHEN business_rules = '' THEN cur_orig END AS currency_original,
  CASE WHEN business_rules = '' THEN upd END AS last_updated, CAST(merged AS BIGINT) AS merged_rows
FROM b
UNION ALL
SELECT _row, CASE WHEN schema_rules <> '' THEN 'VALIDATE_SCHEMA' ELSE 'TRANSFORM' END,
  CASE WHEN schema_rules <> '' THEN schema_rules ELSE transform_rule END,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM t WHERE schema_rules <> '' OR transform_rule IS NOT NULL"""


# ---------------------------------------------------------------- customer

_CUSTOMER = {
    "customer_id": "concat('C', CAST(c_custkey AS STRING))",
    "document_type": "CASE c_custkey % 5 WHEN 0 THEN ' cc ' WHEN 1 THEN 'CE' WHEN 2 THEN 'nit' WHEN 3 THEN 'PASS' ELSE "
                     "CASE WHEN c_custkey % 11 = 0 THEN 'XX' ELSE 'PPN' END END",
    "document_number": "CAST(CASE WHEN c_custkey % 97 = 0 THEN c_custkey - 55 ELSE c_custkey END AS STRING)",
    "first_name": "CASE c_custkey % 3 WHEN 0 THEN 'mARia elena' WHEN 1 THEN 'o''brien-smith' ELSE 'JUAN  3 carlos' END",
    "last_name": "CASE WHEN c_custkey % 101 = 0 THEN 'N/A' ELSE ' de la-cruz ' END",
    "email": "CASE WHEN c_custkey % 53 = 0 THEN 'bad@mail' ELSE concat(' User', CAST(c_custkey AS STRING), '@EXAMPLE.Com ') END",
    "phone": "CASE c_custkey % 5 WHEN 0 THEN '300 123-4567' WHEN 1 THEN '+57 (300) 123' WHEN 2 THEN '573001234567' "
             "WHEN 3 THEN 'none' ELSE 'n/a' END",
    "country_code": "CASE WHEN c_custkey % 59 = 0 THEN 'ZZ' ELSE CASE c_custkey % 4 WHEN 0 THEN 'col' WHEN 1 THEN 'CO' "
                    "WHEN 2 THEN ' usa ' ELSE '484' END END",
    "registration_date": "CASE WHEN c_custkey % 61 = 0 THEN 'soon' WHEN c_custkey % 67 = 0 THEN '2099-01-01' ELSE '2024-05-01' END",
    "birth_date": "CASE WHEN c_custkey % 71 = 0 THEN '1850-01-01' WHEN c_custkey % 73 = 0 THEN '2090-01-01' "
                  "WHEN c_custkey % 2 = 0 THEN 'NULL' ELSE '1990-02-03' END",
    "status": "CASE WHEN c_custkey % 79 = 0 THEN 'gone' ELSE CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'INACTIVE' "
              "WHEN 2 THEN 'S' ELSE 'closed' END END",
    "preferred_language": "'es'",
}
_CUSTOMER_OUT = dict.fromkeys(
    ["crm_customer_id", "document_type", "document_number", "first_name", "last_name", "email", "phone", "country_code",
     "status", "customer_type"], "string")


@register("customer_pipeline")
def customer_pipeline(spark, sf_dir):
    raw = _raw(table(spark, sf_dir, "customer"), _CUSTOMER, "c_custkey")
    tagged = pipelines.tag_rows(raw, builtin("customer"), AS_OF)
    tagged = tagged.withColumns({c: F.to_date(c) for c in ("registration_date", "birth_date")})
    return _outcome(tagged, {**_CUSTOMER_OUT, "registration_date": "date", "birth_date": "date"})


ORACLE["customer_pipeline"] = f"""
WITH raw AS ({_cells_sql(_CUSTOMER, 'c_custkey', 'customer')}),
s AS (
  SELECT *, concat_ws('|',
      CASE WHEN last_name IS NULL THEN 'NOT_NULL_OR_EMPTY:last_name' END,
      CASE WHEN registration_date = 'soon' THEN 'TYPE_COMPATIBILITY:registration_date' END,
      CASE WHEN NOT regexp_full_match(email, '[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') THEN 'PATTERN_MISMATCH:email' END)
      AS schema_rules,
    upper(document_type) AS dtype,
    CASE upper(country_code) WHEN 'COL' THEN 'CO' WHEN 'CO' THEN 'CO' WHEN 'USA' THEN 'US' WHEN '484' THEN 'MX' END AS country,
    CASE upper(status) WHEN 'A' THEN 'ACTIVE' WHEN 'INACTIVE' THEN 'INACTIVE' WHEN 'S' THEN 'SUSPENDED' WHEN 'CLOSED' THEN 'CLOSED' END AS st,
    TRY_CAST(birth_date AS DATE) AS birth, TRY_CAST(registration_date AS DATE) AS reg
  FROM raw),
t AS (
  SELECT *, schema_rules = '' AND (country IS NULL OR st IS NULL OR
      COALESCE(birth > DATE '{AS_OF}' OR birth <= DATE '{AS_OF}' - INTERVAL 121 YEAR, false)) AS bad
  FROM s),
d AS (
  SELECT *, schema_rules = '' AND NOT bad AS live,
    row_number() OVER (PARTITION BY schema_rules = '' AND NOT bad, dtype, document_number ORDER BY _row) AS rn
  FROM t),
b AS (
  SELECT *, CASE WHEN live THEN concat_ws('|',
      CASE WHEN reg > DATE '{AS_OF}' THEN 'FUTURE_DATE:registration_date' END,
      CASE WHEN dtype = 'XX' THEN 'CATALOG_LOOKUP:document_type' END,
      CASE WHEN rn > 1 THEN 'UNIQUE_BUSINESS_KEY:document_type,document_number' END) ELSE '' END AS business_rules
  FROM d),
o AS (
  SELECT *, CASE WHEN schema_rules <> '' THEN 'VALIDATE_SCHEMA' WHEN bad THEN 'TRANSFORM'
                 WHEN business_rules <> '' THEN 'VALIDATE_BUSINESS' END AS step,
    CASE country WHEN 'CO' THEN '57' WHEN 'US' THEN '1' WHEN 'MX' THEN '52' END AS dial
  FROM b)
SELECT _row AS source_row, step,
  CASE WHEN schema_rules <> '' THEN schema_rules WHEN bad THEN 'CUSTOMER_TRANSFORM_ERROR' ELSE business_rules END AS rules,
  CASE WHEN step IS NULL THEN customer_id END AS crm_customer_id,
  CASE WHEN step IS NULL THEN dtype END AS document_type,
  CASE WHEN step IS NULL THEN document_number END AS document_number,
  CASE WHEN step IS NULL THEN CASE _row % 3 WHEN 0 THEN 'Maria Elena' WHEN 1 THEN 'O''Brien-Smith' ELSE 'Juan Carlos' END END AS first_name,
  CASE WHEN step IS NULL THEN 'De La-Cruz' END AS last_name,
  CASE WHEN step IS NULL THEN lower(email) END AS email,
  CASE WHEN step IS NULL THEN CASE _row % 5 WHEN 0 THEN '+' || dial || '3001234567' WHEN 1 THEN '+57300123'
    WHEN 2 THEN CASE WHEN dial = '57' THEN '+573001234567' ELSE '+' || dial || '573001234567' END END END AS phone,
  CASE WHEN step IS NULL THEN country END AS country_code,
  CASE WHEN step IS NULL THEN st END AS status,
  CASE WHEN step IS NULL THEN 'INDIVIDUAL' END AS customer_type,
  CASE WHEN step IS NULL THEN reg END AS registration_date,
  CASE WHEN step IS NULL THEN birth END AS birth_date
FROM o"""


# ------------------------------------------- duplicates over several sources


@register(
    "keep_first_multi_source",
    """WITH src AS (SELECT *, 'file-' || CAST(o_orderkey % 3 AS VARCHAR) AS _source, o_orderkey // 3 AS _row,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)
SELECT o_orderkey, row_number() OVER (PARTITION BY k ORDER BY _source, _row) > 1 AS is_dup,
  count(*) OVER (PARTITION BY k) > 1 AS in_repeated_key FROM src""",
)
def keep_first_multi_source(spark, sf_dir):
    """Three sources that number their rows alike; null keys are one key."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("file-"), (F.col("o_orderkey") % 3).cast("string")).alias("_source"),
        F.floor(F.col("o_orderkey") / 3).cast("long").alias("_row"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("k"),
    )
    flagged = dedup.duplicate_flags(orders, ["k"], row_id=["_source", "_row"], flag="is_dup")
    flagged = dedup.duplicate_flags(flagged, ["k"], row_id=["_source", "_row"], reject_all=True, flag="in_repeated_key")
    return flagged.select("o_orderkey", "is_dup", "in_repeated_key")
