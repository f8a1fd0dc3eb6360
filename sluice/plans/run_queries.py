"""Queries over runs, rejects and configured options, each with a DuckDB twin.

They run the library's run tables, replay, envelope and configuration code on
the driver's tables; as elsewhere, what a feed would bring comes from CASE
expressions that both sides share.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sluice.operators import load, rules, strategy
from sluice.plans import pipelines, runs
from sluice.plans.config import PipelineConfig, TransformationConfig, ValidationConfig
from sluice.plans.registry import _DUCK_ORDERS_CLEAN, _DUCK_RUNS, _orders_validated, _runs, RAW_COLS, register, table
from sluice.plans.registry import ORDERS_DATE_SPARK, ORDERS_RAW_COMMON, ORDERS_SCHEMA_CFG

AS_OF = dt.date(2026, 3, 31)

# ------------------------------------------------------------- runs


@register(
    "retry_chains",
    f"""WITH RECURSIVE {_DUCK_RUNS},
chain AS (
  SELECT execution_id AS root_execution_id, execution_id, 0 AS depth FROM runs
  WHERE parent_execution_id IS NULL OR parent_execution_id NOT IN (SELECT execution_id FROM runs)
  UNION ALL
  SELECT root_execution_id, r.execution_id, depth + 1 FROM chain c JOIN runs r ON r.parent_execution_id = c.execution_id),
known AS (SELECT c.*, status, created_at FROM chain c JOIN runs USING (execution_id)),
ends AS (
  SELECT root_execution_id, count(*) AS attempts, arg_max(status, CAST(depth AS BIGINT) * 1000000000 + CAST(execution_id AS BIGINT)) AS final_status
  FROM known GROUP BY root_execution_id)
SELECT execution_id, root_execution_id, depth, attempts, final_status FROM known JOIN ends USING (root_execution_id)""",
)
def retry_chains(spark, sf_dir):
    r = _runs(spark, sf_dir).select("execution_id", "parent_execution_id", "status", "created_at")
    return runs.retry_chains(strategy.materialize(r))


_STEP_SECONDS = {"EXTRACT": "event_id % 50", "TRANSFORM": "event_id % 31 + 1", "LOAD": "event_id % 17"}


@register(
    "run_step_metrics",
    " UNION ALL ".join(
        f"SELECT CAST(event_id AS VARCHAR) AS execution_id, 'duration_{s.lower()}_ms' AS metric_name, "
        f"CAST(({e}) * 1000 AS DECIMAL(20,2)) AS metric_value FROM events" for s, e in _STEP_SECONDS.items()),
)
def run_step_metrics(spark, sf_dir):
    """The step durations among a run's metrics, steps of one job beginning together."""
    r = _runs(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    steps = e.select("event_id", "ts", F.explode(F.array(*[
        F.struct(F.lit(s).alias("step_name"), F.expr(x).cast("int").alias("seconds")) for s, x in _STEP_SECONDS.items()])).alias("s"))
    steps = steps.select(F.col("event_id").cast("string").alias("execution_id"), "s.step_name", F.col("ts").alias("started_at"),
                         F.expr("timestampadd(SECOND, s.seconds, ts)").alias("finished_at"))
    return runs.run_metrics(r, steps).where(F.col("metric_name").isin([f"duration_{s.lower()}_ms" for s in _STEP_SECONDS]))


@register(
    "rejected_counts",
    f"WITH {_DUCK_RUNS} SELECT pipeline_id AS execution_id, count(*) AS rejected FROM runs WHERE total_rejected > 0 GROUP BY 1",
)
def rejected_counts(spark, sf_dir):
    """A reject per run with rejected rows, counted for every user's series of runs."""
    r = _runs(spark, sf_dir).where("total_rejected > 0")
    return runs.rejected_per_execution(r.select(F.col("pipeline_id").alias("execution_id")))


@register(
    "run_names",
    f"""WITH {_DUCK_RUNS}, names AS (SELECT CAST(c_custkey AS VARCHAR) AS pid, c_name FROM customer WHERE c_custkey % 3 <> 0)
SELECT execution_id, coalesce(c_name, pipeline_id) AS pipeline_name FROM runs LEFT JOIN names ON pipeline_id = pid""",
)
def run_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").cast("string").alias("pipeline_id"), F.col("c_name").alias("name"))
    return runs.with_pipeline_names(_runs(spark, sf_dir), names).select("execution_id", "pipeline_name")


# ----------------------------------------------------------- replay

@register(
    "dead_letter_replay",
    f"""WITH {_DUCK_ORDERS_CLEAN},
rejected AS (SELECT o_orderkey, rules FROM validated WHERE n_errors > 0)
SELECT o_orderkey, rules AS first_rules,
  array_to_string(list_filter(string_split(rules, '|'), lambda r: r NOT LIKE '%:amount'), '|') AS second_rules
FROM rejected""",
)
def dead_letter_replay(spark, sf_dir):
    """Rejected orders read back from their JSON, their amounts mended, and checked again."""
    from sluice.plans.replay import source_rows

    o = table(spark, sf_dir, "orders")
    exprs = {**ORDERS_RAW_COMMON, "order_date": ORDERS_DATE_SPARK}
    feed = o.select("o_orderkey", F.to_json(F.struct(*[F.expr(exprs[c]).alias(c) for c in RAW_COLS])).alias("raw_data"))
    checked = _orders_validated(spark, sf_dir).where(F.size("errors") > 0).select("o_orderkey", F.col("rules").alias("first_rules"))
    rejects = strategy.materialize(checked.join(feed, "o_orderkey").select(
        "first_rules", "raw_data", F.col("o_orderkey").alias("source_row_number"), F.lit("orders").alias("source_file"),
        F.lit("run-1").alias("first_execution_id"), F.lit(1).alias("attempt")))
    rows = source_rows(rejects, RAW_COLS).withColumn("amount", F.lit("0"))
    from sluice.functions import text

    tokens = text.DEFAULT_NULL_TOKENS
    clean = rows.select("_row", *[text.null_tokens(F.col(c).cast("string"), tokens, case_sensitive=True).alias(c) for c in RAW_COLS])
    again = rules.validate_schema(clean, ORDERS_SCHEMA_CFG, labels="second_rules").select("_row", "second_rules")
    first = rejects.select(F.col("source_row_number").alias("_row"), "first_rules")
    return first.join(again, "_row").select(F.col("_row").alias("o_orderkey"), "first_rules", "second_rules")


# -------------------------------------------------- envelopes

@register(
    "json_untyped",
    """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS _pos, event_id AS id,
  event_type AS kind, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 1000 AS DOUBLE) / 4 END AS amount, CAST(event_id % 2 = 0 AS BOOLEAN) AS even,
  CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) ELSE '"' || event_type || '"' END AS mixed
FROM events""",
)
def json_untyped(spark, sf_dir):
    """One envelope per user, exploded without a schema: types as the documents have them."""
    from sluice.sources.json import explode_untyped

    e = table(spark, sf_dir, "events")
    amount = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 1000 / 4).cast("double"))
    item = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), amount.alias("amount"),
                    (F.col("event_id") % 2 == 0).alias("even"))
    text = F.to_json(item)
    mixed = F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    body = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"mixed":'), mixed, F.lit("}"))
    items = e.select("user_id", F.struct("event_id", body.alias("body")).alias("x")).groupBy("user_id").agg(
        F.array_sort(F.collect_list("x")).alias("xs"))
    bodies = strategy.materialize(items.select("user_id", F.concat(
        F.lit('{"data":{"items":['), F.array_join(F.col("xs.body"), ","), F.lit("]}}")).alias("body")))
    out = explode_untyped(bodies, "body", "data.items", keep=["user_id"])
    return out.select("user_id", "_pos", "id", "kind", F.col("amount").cast("double").alias("amount"), "even",
                      F.to_json("mixed").alias("mixed"))


# ------------------------------------------- configured options

@register(
    "consolidated_duplicates",
    """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS latest,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS first FROM orders)
SELECT o_custkey AS customer, o_orderpriority AS priority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount,
  max(CASE WHEN latest = 1 THEN CAST(o_orderdate AS DATE) END) AS order_date, max(CASE WHEN latest = 1 THEN o_orderstatus END) AS status,
  min(o_orderkey) AS first_row, count(*) AS source_rows
FROM r GROUP BY 1, 2""",
)
def consolidated_duplicates(spark, sf_dir):
    """Duplicates merged as configured: amounts added, the latest order's date and status."""
    cfg = PipelineConfig("orders-merged", "orders-merged", validation=ValidationConfig(
        unique_key_columns=["customer", "priority"], duplicates="CONSOLIDATE", consolidate_by="order_date",
        consolidate_sum=["amount"], consolidate_latest=["status"]))
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("_row"))
    merged = pipelines.tag_rows(raw, cfg, AS_OF)
    return merged.select("customer", "priority", "amount", "order_date", "status",
                         F.col("_row").alias("first_row"), F.col("_src_rows").alias("source_rows"))


@register(
    "code_tables",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'ELSEWHERE' ELSE n_name END AS nation, r_name AS region,
  CASE WHEN r_name IS NULL THEN 'TRANSFORM' END AS step
FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON CASE WHEN s_suppkey % 11 = 0 THEN 99 ELSE n_regionkey END = r_regionkey""",
)
def code_tables(spark, sf_dir):
    """Codes translated by tables that the configuration names, with a default and with rejects for unknown codes."""
    cfg = PipelineConfig("suppliers", "suppliers", transformation=TransformationConfig(code_tables={
        "nation": {"location": f"{sf_dir}/nation.parquet", "key": "n_nationkey", "value": "n_name", "policy": "DEFAULT",
                   "default": "ELSEWHERE"},
        "region": {"location": f"{sf_dir}/region.parquet", "key": "r_regionkey", "value": "r_name"}}))
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    j = s.join(strategy.hint_broadcast(n, strategy.broadcastable(n)), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = j.select(
        F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 'zz' ELSE CAST(s_nationkey AS STRING) END").alias("nation"),
        F.expr("CAST(CASE WHEN s_suppkey % 11 = 0 THEN 99 ELSE n_regionkey END AS STRING)").alias("region"),
        F.col("s_suppkey").alias("_row"))
    return pipelines.tag_rows(raw, cfg, AS_OF).select(F.col("_row").alias("s_suppkey"), "nation", "region", F.col("_step").alias("step"))


@register(
    "upsert_immutable",
    """SELECT t.o_orderkey, CASE WHEN t.o_orderkey % 3 = 0 THEN 'X' ELSE t.o_orderstatus END AS o_orderstatus, t.o_custkey,
  CASE WHEN t.o_orderkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS _action
FROM orders t""",
)
def upsert_immutable(spark, sf_dir):
    """An upsert of every third order that may not change the customer."""
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    batch = target.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_custkey") + 1).alias("o_custkey"))
    return load.merge_frame(target, batch, ["o_orderkey"], immutable=["o_custkey"])


_BIG_AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_orderkey % 5 = 0 THEN 100000000 ELSE 1 END AS DECIMAL(28,2))"
_BIG_QUANTITY = "CAST(CASE WHEN l_orderkey % 3 = 0 THEN 99999 ELSE l_quantity END AS INT)"


@register(
    "sales_overflow",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_BIG_AMOUNT} AS amount, {_BIG_QUANTITY} AS quantity FROM lineitem),
t AS (SELECT *, CAST(amount AS DECIMAL(28,2)) * CAST(quantity AS DECIMAL(9,0)) AS sub FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN amount < 1e14 AND sub < 1e16 THEN CAST(sub AS DECIMAL(18,2)) END AS subtotal,
  amount >= 1e14 OR round(sub * 1.19, 2) >= 1e16 AS refused
FROM t""",
)
def sales_overflow(spark, sf_dir):
    """Sales beyond the range of the amounts: their row is refused, the run goes on."""
    from sluice.functions import money

    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_BIG_AMOUNT).alias("amount"), F.expr(_BIG_QUANTITY).alias("quantity"))
    made = money.sales_amounts(F.col("amount"), F.col("quantity"), F.lit(0).cast("decimal(20,8)"))
    refused = F.lit(False)
    for k in ("subtotal", "tax_amount", "total_amount"):
        refused = refused | made[k].isNull()
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", made["subtotal"].alias("subtotal"), refused.alias("refused"))
