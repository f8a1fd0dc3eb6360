"""The four built-in pipelines and the generic pipeline runner.

``tag_rows`` builds one lazy plan that takes every source row through the
schema step, the transform step (common rules, then the pipeline's own) and
the business step, recording for each row the step it failed at and all its
errors. ``run_pipeline`` materialises that plan once (the staging write),
derives the quality gates, counters, rejects and the rows to load from the
materialised copy, promotes into the target and records the run.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import codes, dates, money, text
from sluice.operators import dedup, load, lookup, quality, rules, strategy
from sluice.operators.transform import common_transform, with_first_error
from sluice.plans.config import PipelineConfig
from sluice.plans import sinks
from sluice.plans.runs import STEP_NAMES

Specific = Callable[[DataFrame, PipelineConfig, dt.date], tuple[DataFrame, list[Column]]]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def _str(df: DataFrame, c: str) -> Column:
    return _q(c).cast("string") if _has(df, c) else F.lit(None).cast("string")


def _finish(df: DataFrame, values: dict[str, Column], msgs: list[Column], drop=()) -> tuple[DataFrame, list[Column]]:
    """Apply new values and failure messages in one projection (messages
    see the values before the step) and return the message columns."""
    names = [f"_smsg{i}" for i in range(len(msgs))]
    out = df.withColumns({**values, **dict(zip(names, msgs))})
    if drop:
        out = out.drop(*[c for c in drop if c in out.columns])
    return out, [F.col(n) for n in names]


# ------------------------------------------------------------------ sales


def sales_rules(df: DataFrame, cfg: PipelineConfig, as_of: dt.date) -> tuple[DataFrame, list[Column]]:
    msgs = []
    amount = _q("amount").try_cast("decimal(38,10)") if _has(df, "amount") else F.lit(None).cast("decimal(38,10)")
    pq = _str(df, "product_quantity")
    qty = F.when(pq.isNull(), F.lit(1)).otherwise(F.when(money.is_int32_text(pq), pq.try_cast("int")))
    dr = _str(df, "discount_rate") if not (_has(df, "discount_rate") and isinstance(df.schema["discount_rate"].dataType, T.NumericType)) else _q("discount_rate")
    disc = F.when(dr.isNull(), F.lit(0).cast("decimal(20,8)")).otherwise(money.to_amount(dr))
    chan_in = F.upper(text.trim_ws(F.coalesce(_str(df, "channel"), F.lit("null"))))
    channel, _ = lookup.map_code(chan_in, codes.CHANNEL_MAPPING, "REJECT")
    # what is read more than once becomes a column first, so that it is evaluated once a row
    held = {"_sale_amount": amount, "_sale_quantity": qty, "_sale_discount": disc, "_sale_channel": channel}
    df = df.withColumns(held)
    amount, qty, disc, channel = (F.col(c) for c in held)
    terms = dict(zip(("_sale_rate", "_sale_subtotal"), money.sales_terms(amount, qty, disc)))
    df = df.withColumns(terms)
    msgs.append(F.when(amount.isNull(), F.lit("amount is required")))
    msgs.append(F.when(qty.isNull(), F.concat(F.lit("For input string: "), pq)))
    msgs.append(F.when(disc.isNull(), F.concat(F.lit("Invalid discount_rate: "), dr.cast("string"))))
    msgs.append(F.when(channel.isNull(), F.concat(F.lit("Missing channel mapping for value "), F.coalesce(_str(df, "channel"), F.lit("null")))))
    amounts = money.sales_totals(*[F.col(c) for c in terms], codes.SALES_TAX_RATE)
    values = {"channel": channel, "quantity": qty, **amounts}
    if not _has(df, "status"):
        values["status"] = F.lit(codes.SALES_DEFAULT_STATUS)
    for k in ("discount_rate", "subtotal", "tax_amount", "total_amount"):
        msgs.append(F.when(amount.isNotNull() & qty.isNotNull() & disc.isNotNull() & amounts[k].isNull(),
                           F.lit(f"{k} out of range")))
    return _finish(df, values, msgs, drop=["product_quantity", *held, *terms])


# --------------------------------------------------------------- customer


def customer_rules(df: DataFrame, cfg: PipelineConfig, as_of: dt.date) -> tuple[DataFrame, list[Column]]:
    msgs = []
    if not _has(df, "crm_customer_id") and _has(df, "customer_id"):
        df = df.withColumnRenamed("customer_id", "crm_customer_id")
    country_code = text.upper_code(_str(df, "country_code"))
    country, c_failed = lookup.map_code(country_code, codes.COUNTRY_MAPPING, "REJECT")
    msgs.append(F.when(country_code.isNull(), F.lit("Required code field is null")))
    msgs.append(F.when(c_failed, F.concat(F.lit("Unknown country code: "), _str(df, "country_code"))))
    email = text.normalize_email(_str(df, "email"))
    msgs.append(F.when(~text.is_valid_email(email), F.lit("Invalid email format")))
    doc_type = text.upper_code(_str(df, "document_type"))
    msgs.append(F.when(doc_type.isNull(), F.lit("Required code field is null")))
    st_code = text.upper_code(_str(df, "status"))
    status, s_failed = lookup.map_code(st_code, codes.STATUS_MAPPING, "REJECT")
    msgs.append(F.when(st_code.isNull(), F.lit("Required code field is null")))
    msgs.append(F.when(s_failed, F.concat(F.lit("Unknown customer status: "), _str(df, "status"))))
    first = text.name_case(_str(df, "first_name"))
    last = text.name_case(_str(df, "last_name"))
    msgs.append(F.when(text.trim_to_null(_str(df, "first_name")).isNull() | text.trim_to_null(_str(df, "last_name")).isNull(),
                       F.lit("Customer name fields are mandatory")))
    values = {
        "country_code": country, "email": email, "document_type": doc_type, "status": status,
        "first_name": first, "last_name": last,
        "phone": text.phone_e164(_str(df, "phone"), country, codes.COUNTRY_DIAL_CODES),
    }
    if not _has(df, "customer_type"):
        values["customer_type"] = F.lit(codes.CUSTOMER_DEFAULT_TYPE)
    if _has(df, "birth_date"):
        birth = F.to_date(_q("birth_date").cast("timestamp"))
        as_of_d = F.lit(as_of).cast("date")
        # whole years are truncated toward zero in the reference; a birth date
        # in the future is rejected outright here (documented decision)
        years = dates.whole_years_between(birth, as_of_d)
        bad = birth.isNotNull() & ((birth > as_of_d) | (years < codes.AGE_MIN_YEARS) | (years > codes.AGE_MAX_YEARS))
        msgs.append(F.when(bad, F.lit("Birth date is outside valid age range")))
    return _finish(df, values, msgs)


# -------------------------------------------------------------- inventory


def inventory_rules(df: DataFrame, cfg: PipelineConfig, as_of: dt.date) -> tuple[DataFrame, list[Column]]:
    msgs = []
    sku_raw = _str(df, "sku")
    sku = text.normalize_sku(sku_raw)
    msgs.append(F.when(text.trim_to_null(sku_raw).isNull(), F.lit("SKU is required")))
    msgs.append(F.when(sku.isNull(), F.concat(F.lit("Invalid SKU segment: "), sku_raw)))
    wh_raw = _str(df, "warehouse_id")
    wh, w_failed = lookup.map_code(F.upper(text.trim_to_null(wh_raw)), codes.WAREHOUSE_MAPPING, "REJECT")
    msgs.append(F.when(text.trim_to_null(wh_raw).isNull(), F.lit("warehouse_id is required")))
    msgs.append(F.when(w_failed, F.concat(F.lit("Unknown warehouse mapping for "), wh_raw)))

    def to_long(c):
        if not _has(df, c):
            return F.lit(None).cast("long")
        if isinstance(df.schema[c].dataType, T.NumericType):
            return _q(c).try_cast("long")
        s = _q(c).cast("string")
        return F.when(money.is_int64_text(s), s.try_cast("long"))

    on_hand = to_long("quantity_on_hand")
    reserved = F.when(_q("quantity_reserved").isNull(), F.lit(0).cast("long")).otherwise(to_long("quantity_reserved")) \
        if _has(df, "quantity_reserved") else F.lit(0).cast("long")
    msgs.append(F.when(on_hand.isNull() | reserved.isNull(), F.lit("Invalid inventory quantity")))
    msgs.append(F.when((on_hand < 0) | (reserved < 0), F.lit("Inventory quantities must be non-negative")))
    msgs.append(F.when(reserved > on_hand, F.lit("Reserved quantity cannot exceed on-hand quantity")))
    return _finish(df, {"sku": sku, "warehouse_id": wh, "quantity_on_hand": on_hand, "quantity_reserved": reserved}, msgs)


def inventory_consolidate(valid: DataFrame) -> DataFrame:
    """Rows sharing (sku, warehouse) merged: quantities summed, cost and currency of the latest update (of the
    first row where none says when), everything else from the first row."""
    known = "last_updated" in valid.columns
    latest = [c for c in ("unit_cost", "unit_cost_original", "currency", "currency_original") if c in valid.columns]
    if not known:
        valid = valid.withColumn("last_updated", F.lit(None).cast("timestamp"))
    out = dedup.consolidate_latest(
        valid, ["sku", "warehouse_id"], ["quantity_on_hand", "quantity_reserved"], "last_updated", latest,
        order_cols=["_row"], count_col="_src_rows")
    return out if known else out.drop("last_updated")


# ------------------------------------------------------------------- item


def item_rules(df: DataFrame, cfg: PipelineConfig, as_of: dt.date) -> tuple[DataFrame, list[Column]]:
    msgs = []
    key = text.upper_code(_str(df, "item_key"))
    msgs.append(F.when(key.isNull(), F.lit("item_key is required")))
    name = text.collapse_text(_str(df, "item_name"))
    msgs.append(F.when(name.isNull(), F.lit("item_name is required")))
    price_raw = _q("unit_price") if _has(df, "unit_price") else F.lit(None).cast("string")
    price = price_raw.try_cast("decimal(38,10)") if _has(df, "unit_price") and isinstance(
        df.schema["unit_price"].dataType, T.NumericType) else money.to_amount(price_raw, "decimal(38,10)")
    msgs.append(F.when(price_raw.isNull(), F.lit("unit_price is required")))
    fits = F.round(price, 2).try_cast("decimal(18,2)").isNotNull()
    msgs.append(F.when(price_raw.isNotNull() & (price.isNull() | ~fits), F.lit("unit_price must be a valid decimal")))
    msgs.append(F.when(price < 0, F.lit("unit_price must be non-negative")))
    return _finish(df, {
        "item_key": key,
        "item_name": name,
        "unit_price": F.round(price, 2).try_cast("decimal(18,2)"),
        "description": text.collapse_text(_str(df, "description")),
        "manufacturer_country": text.title_case(text.collapse_text(_str(df, "manufacturer_country"))),
        "supplier_name": text.title_case(text.collapse_text(_str(df, "supplier_name"))),
        "unit": text.lower_text(_str(df, "unit")),
    }, msgs)


# ---------------------------------------------------------------- registry

SPECIFIC: dict[str, tuple[Specific, str]] = {
    "sales-daily": (sales_rules, "SALES_TRANSFORM_ERROR"),
    "customer-sync": (customer_rules, "CUSTOMER_TRANSFORM_ERROR"),
    "inventory-sync": (inventory_rules, "INVENTORY_TRANSFORM_ERROR"),
    "item-sync": (item_rules, "ITEM_TRANSFORM_ERROR"),
}

# names that stand for every pipeline
EVERY = ("*", "common")
Validator = Callable[[DataFrame, PipelineConfig, dt.date], list[Column]]
_SHARED: list[tuple[int, Specific, str]] = []
_VALIDATORS: list[tuple[int, str, Validator]] = []


def register_transformer(name: str, fn: Specific, rule: str, order: int = 100) -> None:
    """Extension hook: a transformer for a pipeline's name or id, or (``*`` or ``common``) for pipelines without their own.

    Of several for pipelines without their own, the lowest ``order`` counts. Names compare without case.
    """
    if name.lower() in EVERY:
        _SHARED.append((order, fn, rule))
        _SHARED.sort(key=lambda x: x[0])
    else:
        SPECIFIC[name.lower()] = (fn, rule)


def register_validator(name: str, fn: Validator, order: int = 100) -> None:
    """Extension hook: more checks of the business step, for a pipeline's name or id or for every pipeline.

    ``fn(df, cfg, as_of)`` returns checks as ``rules.check`` builds them; they follow the built-in ones by ``order``.
    """
    _VALIDATORS.append((order, name.lower(), fn))
    _VALIDATORS.sort(key=lambda x: x[0])


def clear_extensions() -> None:
    """Forget the transformers for all pipelines and the validators that were registered."""
    _SHARED.clear()
    _VALIDATORS.clear()


def resolve_transformer(cfg: PipelineConfig) -> tuple[Specific, str] | None:
    """Exact name or id wins, then the first one for all pipelines; None leaves the common rules only."""
    own = SPECIFIC.get(cfg.name.lower()) or SPECIFIC.get(cfg.id.lower())
    return own or (_SHARED[0][1:] if _SHARED else None)


# ----------------------------------------------------------------- tagging


def transform_rows(raw: DataFrame, cfg: PipelineConfig, as_of: dt.date) -> DataFrame:
    """Schema and transform steps over a source, lazily: the transformed columns with each step's errors, ``_alive``
    (no error so far) and ``_cells`` (the source's cells, of which a reject's JSON is made)."""
    # HotSpot never compiles a method of more than 8,000 bytes: a stage of that size is left to its operators
    raw.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    empty = F.array().cast(rules.ERRORS_TYPE)
    data_cols = [c for c in raw.columns if not c.startswith("_")]
    cells = F.struct(*[_q(c).alias(f"f{i}") for i, c in enumerate(data_cols)]) if data_cols else F.lit(None).cast("string")
    base = raw.withColumn("_cells", cells)
    # schema step on raw header names
    s = rules.validate_schema(base, cfg.validation, "_e_schema", labels="_l_schema")
    schema_ok = F.size("_e_schema") == 0
    # transform step: common rules then pipeline-specific rules
    t = common_transform(s, cfg.transformation, "_e_transform")
    spec = resolve_transformer(cfg)
    if spec is not None:
        fn, rule = spec
        common_failed = F.size("_e_transform") > 0
        t2, msgs = fn(t, cfg, as_of)
        t2 = with_first_error(t2, [F.when(~common_failed, m) for m in msgs], rule, "_e_spec")
        t = t2.withColumn("_e_transform", F.concat("_e_transform", "_e_spec")).drop("_e_spec", *[
            c for c in t2.columns if c.startswith("_smsg")])
    t = t.withColumn("_e_transform", F.when(schema_ok, F.col("_e_transform")).otherwise(empty))
    return t.withColumn("_alive", schema_ok & (F.size("_e_transform") == 0))


def needs_staging(cfg: PipelineConfig) -> bool:
    """Whether the transformed rows are read more than once: by a duplicate check or a consolidation."""
    return bool(cfg.validation.unique_key_columns) or consolidation(cfg) is not None


def transform_metrics() -> dict[str, Column]:
    return {
        "rows": F.count(F.lit(1)),
        "schema_rej": F.count_if(F.size("_e_schema") > 0),
        "transform_rej": F.count_if((F.size("_e_schema") == 0) & (F.size("_e_transform") > 0)),
    }


def consolidation(cfg: PipelineConfig) -> Callable[[DataFrame], DataFrame] | None:
    """How rows of one key are merged before the business step: by the pipeline's own rules, or as configured."""
    if (resolve_transformer(cfg) or (None,))[0] is inventory_rules:
        return inventory_consolidate
    v = cfg.validation
    if v.duplicates != "CONSOLIDATE":
        return None

    def merge(valid: DataFrame) -> DataFrame:
        known = [c for c in v.consolidate_latest if c in valid.columns]
        return dedup.consolidate_latest(
            valid, v.unique_key_columns, [c for c in v.consolidate_sum if c in valid.columns], v.consolidate_by, known,
            order_cols=["_source", "_row"] if "_source" in valid.columns else ["_row"], count_col="_src_rows")

    return merge


def consolidate(t: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Rows still valid merged by key, where the configuration asks for it (``_src_rows`` counts what each stands for)."""
    merge = consolidation(cfg)
    if merge is None:
        return t
    return merge(t.filter("_alive")).unionByName(t.filter("not _alive"), allowMissingColumns=True)


def business_rows(t: DataFrame, cfg: PipelineConfig, as_of: dt.date, names: list[str],
                  table_catalogs: dict[str, tuple[str, str | None]] | None = None,
                  catalog_frames: Callable[[DataFrame], DataFrame] | None = None,
                  dedup_order: list[str] | None = None, refine: Callable[[DataFrame], DataFrame] | None = None,
                  near: Sequence[str] = ()) -> DataFrame:
    """Business step over transformed rows, lazily; ``names`` are the source's column names, for the rejects' JSON, and
    ``refine`` may reject more rows by their ``_step`` and ``errors``."""
    empty = F.array().cast(rules.ERRORS_TYPE)
    alive = F.col("_alive")
    keys = [k for k in cfg.validation.unique_key_columns if k in t.columns]
    unique = bool(keys) and cfg.validation.duplicates != "CONSOLIDATE"
    if unique:
        # before the catalogs are joined: counting keys reads the stored rows, and no join
        # row numbers are per file or sheet: the source is part of a row's identity
        ids = ["_source", "_row"] if "_source" in t.columns else "_row"
        t = dedup.duplicate_flags(t, keys, row_id=ids, order_cols=dedup_order,
                                  reject_all=cfg.validation.reject_all_duplicates, flag="_dup", where=alive, near=near)
    if catalog_frames is not None:
        t = catalog_frames(t)
    checks = rules.business_checks(t, cfg.validation, as_of, table_catalogs)
    for _, name, validate in _VALIDATORS:
        if name in (*EVERY, cfg.name.lower(), cfg.id.lower()):
            checks += validate(t, cfg, as_of)
    if unique:
        checks.append(rules.duplicate_error(keys, "_dup", "_row"))
    t, checks = rules.hold_checks(t, checks)
    t = t.withColumns({"_e_business": F.when(alive, rules.collect_errors(checks)).otherwise(empty),
                       "_l_business": F.when(alive, rules.check_labels(checks)).otherwise(F.lit(""))}).drop(*[f"_check{i}" for i in range(len(checks))])
    flags = ["_dup", *[x for pair in (table_catalogs or {}).values() for x in pair if x]]
    return _outcome(t, names, refine).drop(*flags)


def _outcome(t: DataFrame, names: list[str], refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first step with errors, its errors and labels, and the source row of a reject, in place of the steps' own."""
    schema_ok = F.size("_e_schema") == 0
    transform_bad = F.size("_e_transform") > 0
    step = (F.when(~schema_ok, F.lit(rules.STEP_SCHEMA)).when(transform_bad, F.lit(rules.STEP_TRANSFORM))
            .when(F.size("_e_business") > 0, F.lit(rules.STEP_BUSINESS)))
    errors = F.when(~schema_ok, F.col("_e_schema")).when(transform_bad, F.col("_e_transform")).otherwise(F.col("_e_business"))
    # rule:field labels of the failing step, without a higher-order function
    labels = (F.when(~schema_ok, F.col("_l_schema")).when(transform_bad, F.get(F.col("_e_transform"), 0)["rule"])
              .otherwise(F.col("_l_business")))
    out = t.withColumns({"_step": step, "errors": errors, "_labels": labels})
    if refine is not None:
        out = refine(out)
    return with_raw(out, names).drop("_e_schema", "_e_transform", "_e_business", "_alive", "_l_schema", "_l_business", "_cells")


def with_raw(t: DataFrame, names: list[str]) -> DataFrame:
    """Add ``_raw``, the source row as JSON, to rows with a ``_step``: other rows need none."""
    cells = F.struct(*[F.col(f"_cells.f{i}").alias(n) for i, n in enumerate(names)]) if names else F.struct(F.lit(None).alias("_"))
    return t.withColumn("_raw", F.when(F.col("_step").isNotNull(), F.to_json(cells)))


def tag_rows(raw: DataFrame, cfg: PipelineConfig, as_of: dt.date,
             table_catalogs: dict[str, tuple[str, str | None]] | None = None,
             catalog_frames: Callable[[DataFrame], DataFrame] | None = None,
             dedup_order: list[str] | None = None, staging: strategy.Staging | None = None,
             near: Sequence[str] = ()) -> DataFrame:
    """All steps over one scan of the source. Output: data columns after
    transformation, ``_row``, ``_step`` (the step a rejected row failed at,
    null if valid), ``errors`` (every error of that step) and, for rejects,
    ``_raw`` (JSON of the source row).

    Rows are never split into branches: each step's errors are computed for
    every row and masked for rows that already failed an earlier step. Where
    a duplicate check or a consolidation reads the transformed rows more than
    once, they are stored once (``staging``), and the source is read once.
    ``catalog_frames`` may join table-backed catalogs onto the transformed
    frame (adding the flag columns named in ``table_catalogs``). The first
    row of a repeated key is the smallest ``(dedup_order..., _row)``.
    ``near`` names columns of the source, beginning with ``_``, in which rows
    of one unique key agree and by which the source's rows are dealt out (by
    a join), if they are not ``dedup.crowded``: duplicates are then told where
    the rows lie, and these are neither stored nor moved for it.
    """
    names = [c for c in raw.columns if not c.startswith("_")]
    t = transform_rows(raw, cfg, as_of)
    if near and consolidation(cfg) is None:
        return business_rows(t, cfg, as_of, names, table_catalogs, catalog_frames, dedup_order, near=near)
    if needs_staging(cfg):
        t, _ = (staging or strategy.Staging(raw.sparkSession)).write(t, "transformed")
    return business_rows(consolidate(t, cfg), cfg, as_of, names, table_catalogs, catalog_frames, dedup_order)


# ------------------------------------------------------------------ runner


@dataclass
class RunResult:
    execution_id: str
    status: str
    read: int = 0
    transformed: int = 0
    rejected: int = 0
    loaded: int = 0
    inserted: int = 0
    updated: int = 0
    skipped: int = 0
    errors: list[str] = field(default_factory=list)
    reports: dict = field(default_factory=dict)
    tagged: DataFrame | None = None
    exception: Exception | None = None
    parent_execution_id: str | None = None
    retry_count: int = 0
    staging: strategy.Staging | None = None

    def close(self) -> None:
        """Remove the run's staged rows."""
        self.tagged = None
        if self.staging is not None:
            self.staging.clear()

    def valid(self) -> DataFrame:
        return self.tagged.filter(F.col("_step").isNull())

    def rejects(self) -> DataFrame:
        return self.tagged.filter(F.col("_step").isNotNull())


STEP_REASONS = {
    rules.STEP_SCHEMA: rules.REASON_SCHEMA,
    rules.STEP_BUSINESS: rules.REASON_BUSINESS,
    "LOAD": "Target constraint violated",
}


def reject_rows(tagged: DataFrame, execution_id: str, rejected_at: dt.datetime) -> DataFrame:
    """Rejects in the run-store layout (row number, step, raw JSON, reason,
    errors JSON)."""
    rej = tagged.filter(F.col("_step").isNotNull())
    replayed = "_first_execution_id" in tagged.columns
    reason = F.when(F.col("_step") == rules.STEP_TRANSFORM, F.col("errors")[0]["message"])
    for step, text_ in STEP_REASONS.items():
        reason = reason.when(F.col("_step") == step, F.lit(text_))
    reason = F.when(F.exists("errors", lambda e: e["rule"] == rules.MANDATORY_COLUMN_MISSING),
                    F.lit(rules.REASON_MISSING)).otherwise(reason)
    return rej.select(
        F.lit(execution_id).alias("execution_id"),
        F.col("_row").cast("long").alias("source_row_number"),
        F.col("_step").alias("step"),
        F.col("_raw").alias("raw_data"),
        reason.alias("reason"),
        F.to_json("errors").alias("errors"),
        F.lit(rejected_at).cast("timestamp").alias("rejected_at"),
        (F.col("_source") if "_source" in tagged.columns else F.lit(None)).cast("string").alias("source_file"),
        (F.col("_first_execution_id") if replayed else F.lit(execution_id)).alias("first_execution_id"),
        (F.col("_attempt") + 1 if replayed else F.lit(1)).cast("int").alias("attempt"),
    )


def run_pipeline(
    spark: SparkSession,
    cfg: PipelineConfig,
    raw: DataFrame,
    target: load.BucketedTable | None = None,
    as_of: dt.date | None = None,
    execution_id: str | None = None,
    run_store=None,
    table_catalogs=None,
    catalog_frames=None,
    parent_execution_id: str | None = None,
    retry_count: int = 0,
    sink: str | None = None,
) -> RunResult:
    """Run every step, gate, load and record; returns counters and status.

    Rejects are stored before the load, and the run, its steps, its errors
    and an audit row always, also where a step raises: the run is then
    FAILED, with the exception in the result. A load that fails after its
    commit is rolled back if the target's rollback strategy says so. A retry
    names the run that it repeats and its number. ``sink`` names a registered
    loader (``sinks.register_sink``) that gets the rows in place of ``target``.

    The staged rows of the run (``result.tagged``) stay until
    ``result.close()``.
    """
    execution_id = execution_id or str(uuid.uuid4())
    as_of = as_of or dt.datetime.now(dt.timezone.utc).date()
    result = RunResult(execution_id, "RUNNING", parent_execution_id=parent_execution_id, retry_count=retry_count,
                       staging=strategy.Staging(spark, "run"))
    log = _RunLog(run_store, cfg, result)
    try:
        _run_steps(cfg, raw, target, as_of, log, table_catalogs, catalog_frames, sink)
    except quality.QualityGateBreached as exc:
        log.failed(str(exc))
    except load.StagingCheckFailed as exc:
        log.failed(*exc.details)
    except Exception as exc:  # noqa: BLE001 - recorded, and returned to the caller
        result.exception = exc
        log.failed(f"{type(exc).__name__}: {str(exc).strip().splitlines()[0] if str(exc).strip() else ''}")
        if target is not None and log.step == "LOAD" and cfg.target.rollback_strategy == "DELETE_BY_EXECUTION":
            log.rolled_back(target)
    finally:
        log.close()
    return result


class _RunLog:
    """What a run leaves in the run store: its steps as they end, then errors, execution and audit rows.

    Steps that one job runs together, row by row, begin together; each ends
    when its own outcome is known.
    """

    ORDER = {name: i + 1 for i, name in enumerate(STEP_NAMES)}

    def __init__(self, store, cfg: PipelineConfig, result: RunResult):
        self.store, self.cfg, self.result = store, cfg, result
        self.started = _now()
        self.open: dict[str, dt.datetime] = {}
        self.steps: list[dict] = []
        self.problems: list[tuple[str, str]] = []
        self.rejects: DataFrame | None = None

    @property
    def step(self) -> str | None:
        """The step under way: the first that has begun and not ended."""
        return min(self.open, key=self.ORDER.__getitem__, default=None)

    def begin(self, *steps: str) -> None:
        self.open |= dict.fromkeys(steps, _now())

    def end(self, step: str, processed: int | None, status: str = "SUCCESS") -> None:
        self.steps.append({
            "execution_id": self.result.execution_id, "step_name": step, "step_order": self.ORDER[step],
            "status": status, "started_at": self.open.pop(step), "finished_at": _now(), "records_processed": processed,
        })

    def failed(self, *messages: str) -> None:
        self.result.status = "FAILED"
        self.result.errors.extend(messages)
        self.problems.extend((self.step or "CLOSE", m) for m in messages)

    def rolled_back(self, target: load.BucketedTable) -> None:
        try:
            target.rollback(self.result.execution_id)
        except Exception as exc:  # noqa: BLE001 - the first failure stays the run's outcome
            self.failed(f"Rollback failed: {type(exc).__name__}")

    def save_rejects(self) -> None:
        if self.store is not None and self.rejects is not None:
            self.store.append("rejects", self.rejects)
        self.rejects = None

    def close(self) -> None:
        r = self.result
        if self.step:
            # steps of the same job that come after the failed one have no outcome
            self.end(self.step, None, "FAILED")
            self.open.clear()
        if self.store is None:
            return
        try:
            self.begin("AUDIT")
            self.save_rejects()
        except Exception as exc:  # noqa: BLE001 - the run is recorded without its rejects
            self.failed(f"Rejects not stored: {type(exc).__name__}")
            self.end("AUDIT", None, "FAILED")
        else:
            self.end("AUDIT", r.loaded)
        finished = _now()
        messages = [message for _, message in self.problems]
        self.store.append("steps", self.steps)
        self.store.append("errors", [{
            "execution_id": r.execution_id, "step_name": step, "error_type": "TECHNICAL", "severity": "CRITICAL",
            "message": message, "created_at": finished,
        } for step, message in self.problems])
        self.store.append("executions", [{
            "execution_id": r.execution_id, "pipeline_id": self.cfg.id, "status": r.status,
            "trigger_type": "RETRY" if r.parent_execution_id else "MANUAL", "started_at": self.started, "finished_at": finished,
            "total_read": r.read, "total_transformed": r.transformed, "total_rejected": r.rejected,
            "total_loaded": r.loaded, "error_summary": "; ".join(messages) or None, "retry_count": r.retry_count,
            "parent_execution_id": r.parent_execution_id, "created_at": self.started,
        }])
        self.store.append("audit", [{
            "execution_id": r.execution_id, "pipeline_id": self.cfg.id, "action": "PIPELINE_EXECUTION",
            "status": r.status,
            "details": f"read={r.read}, transformed={r.transformed}, rejected={r.rejected}, loaded={r.loaded}"
                       + (f", failureReason={messages[0]}" if messages else ""),
            "created_at": finished,
        }])


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _run_steps(cfg: PipelineConfig, raw: DataFrame, target: load.BucketedTable | None, as_of: dt.date, log: _RunLog,
               table_catalogs, catalog_frames, sink: str | None) -> None:
    """The steps of a run. The transformed rows are stored once where they are read more than once, the business step's
    rows always; both writes count what they write."""
    result, started = log.result, log.started
    execution_id, pct, abort = result.execution_id, cfg.validation.error_threshold_percent, cfg.validation.abort_on_threshold_breach
    names = [c for c in raw.columns if not c.startswith("_")]
    log.begin("EXTRACT", "VALIDATE_SCHEMA", "TRANSFORM")
    t = transform_rows(raw, cfg, as_of)
    staged_first = needs_staging(cfg)
    c: dict = {}

    def transformed(seen: dict) -> None:
        c.update(seen)
        result.read = c["rows"]
        log.end("EXTRACT", result.read)
        result.reports["schema"] = quality.evaluate(result.read, c["schema_rej"], pct)
        quality.gate(result.reports["schema"], abort, "schema")
        log.end("VALIDATE_SCHEMA", result.read - c["schema_rej"])
        log.end("TRANSFORM", result.read - c["schema_rej"] - c["transform_rej"])

    if staged_first:
        t, seen = result.staging.write(t, "transformed", transform_metrics())
        # what is rejected if the schema gate ends the run here
        early = t.where("not _alive").withColumns({"_e_business": F.array().cast(rules.ERRORS_TYPE), "_l_business": F.lit("")})
        log.rejects = reject_rows(_outcome(early, names), execution_id, started)
        result.rejected = seen["schema_rej"] + seen["transform_rej"]
        transformed(seen)
        t = consolidate(t, cfg)
    log.begin("VALIDATE_BUSINESS")
    metrics = {
        "business_rej": F.count_if(F.col("_step") == rules.STEP_BUSINESS),
        "refused": F.count_if(F.col("_step") == "LOAD"),
        "valid": F.count_if(F.col("_step").isNull()),
    }
    if not staged_first:
        metrics |= {"rows": F.count(F.lit(1)), "schema_rej": F.count_if(F.col("_step") == rules.STEP_SCHEMA),
                    "transform_rej": F.count_if(F.col("_step") == rules.STEP_TRANSFORM)}
    business = business_rows(t, cfg, as_of, names, table_catalogs, catalog_frames, refine=lambda d: _with_constraints(cfg, d))
    tagged, seen = result.staging.write(business, "tagged", metrics)
    result.tagged = tagged
    log.rejects = reject_rows(tagged, execution_id, started)
    if staged_first:
        c.update(seen)
    else:
        result.rejected = seen["schema_rej"] + seen["transform_rej"]
        transformed(seen)
    passed = c["valid"] + c["refused"]
    result.transformed = passed + c["business_rej"]
    result.rejected += c["business_rej"]
    result.reports["business"] = quality.evaluate(result.transformed, c["business_rej"], pct)
    if cfg.validation.threshold_scope == "cumulative":
        result.reports["cumulative"] = quality.evaluate(result.read, result.rejected, pct)
    for step in ("business", "cumulative"):
        if step in result.reports:
            quality.gate(result.reports[step], abort, step)
    log.end("VALIDATE_BUSINESS", passed)
    log.begin("LOAD")
    result.rejected += c["refused"]
    if c["refused"] and cfg.target.fail_fast_on_chunk_error:
        raise load.StagingCheckFailed([f"{c['refused']} rows violate target constraints"])
    log.save_rejects()
    valid = tagged.filter(F.col("_step").isNull()).drop("_step", "errors", "_raw", "_labels")
    run = load.RunContext(execution_id=execution_id, pipeline_id=cfg.id, pipeline_version=cfg.version,
                          source_file=cfg.source.location, load_timestamp=started, as_of=as_of)
    staged = load.add_trace_columns(valid, run).drop("_source", "_extracted_at", "_src_rows", "_first_execution_id", "_attempt")
    if sink is not None:
        result.inserted = sinks.deliver(staged.drop("_row"), sink, execution_id, cfg)
    elif target is not None:
        _load(cfg, target, staged, c["valid"], result)
    else:
        result.inserted = c["valid"]
    result.loaded = result.inserted + result.updated
    log.end("LOAD", result.loaded)
    log.begin("CLOSE")
    # row rejects are data outcomes: they make a run PARTIAL, never FAILED
    result.status = "PARTIAL" if result.rejected > 0 else "SUCCESS"
    log.end("CLOSE", result.loaded)


def _with_constraints(cfg: PipelineConfig, tagged: DataFrame) -> DataFrame:
    """Rows the target would refuse are rejected one by one (step LOAD)."""
    tc = cfg.target
    constraints = load.constraint_checks(tagged, [c for c in tc.not_null_columns if c in tagged.columns],
                                         [c for c in tc.non_negative_columns if c in tagged.columns],
                                         {k: v for k, v in tc.max_lengths.items() if k in tagged.columns},
                                         {k: v for k, v in tc.decimal_types.items() if k in tagged.columns})
    if not constraints:
        return tagged
    hit = F.col("_step").isNull() & (F.size("_le") > 0)
    checked = tagged.withColumn("_le", rules.collect_errors(constraints))
    return checked.withColumns({
        "_step": F.when(hit, F.lit("LOAD")).otherwise(F.col("_step")),
        "errors": F.when(hit, F.col("_le")).otherwise(F.col("errors")),
    }).drop("_le")


def _load(cfg: PipelineConfig, target: load.BucketedTable, staged: DataFrame, expected: int, result: RunResult) -> None:
    tc = cfg.target
    check = load.staging_check_frame(staged, tc.business_key if tc.load_strategy == "UPSERT" else [],
                                     tc.not_null_columns).first()
    details = load.staging_check_details(check, expected, tc.not_null_columns)
    if details:
        raise load.StagingCheckFailed(details)
    rows = staged.drop("_row")
    if not target.exists():
        target.create(rows.limit(0))
    if tc.load_strategy == "UPSERT":
        guard = tc.closed_flag_column if tc.closed_record_guard_enabled else None
        by = target.upsert(rows, guard, tc.closed_flag_value, tc.immutable_columns)
    elif tc.load_strategy == "INSERT":
        by = target.insert(staged, "_row" if "_row" in staged.columns else None)
    else:
        by = target.replace(rows)
    result.inserted = by.get(load.INSERTED, 0)
    result.updated = by.get(load.UPDATED, 0)
    result.skipped = by.get(load.SKIPPED, 0)
    if tc.load_strategy == "INSERT":
        result.rejected += expected - result.inserted
