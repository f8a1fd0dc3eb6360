"""Validation rules as Column expressions.

Each rule is a ``Column`` that evaluates to an error struct when the row
breaks the rule and to null otherwise. ``attach_errors`` gathers all rules of
a step into one ``errors`` array (in check order), so every reason a row
is rejected is kept, all rules are evaluated in a single projection, and the
valid/reject split is a filter on ``size(errors)``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import dates, money, text
from sluice.plans.config import ValidationConfig

ERROR_TYPE = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)
ERRORS_TYPE = T.ArrayType(ERROR_TYPE)

# Rule codes, messages and severities.
MANDATORY_COLUMN_MISSING = "MANDATORY_COLUMN_MISSING"
NOT_NULL_OR_EMPTY = "NOT_NULL_OR_EMPTY"
TYPE_COMPATIBILITY = "TYPE_COMPATIBILITY"
PATTERN_MISMATCH = "PATTERN_MISMATCH"
NON_NEGATIVE_AMOUNT = "NON_NEGATIVE_AMOUNT"
RANGE_CHECK = "RANGE_CHECK"
FUTURE_DATE = "FUTURE_DATE"
CATALOG_LOOKUP = "CATALOG_LOOKUP"
ACTIVE_REFERENCE = "ACTIVE_REFERENCE"
UNIQUE_BUSINESS_KEY = "UNIQUE_BUSINESS_KEY"
TRANSFORM_ERROR = "TRANSFORM_ERROR"
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")

STEP_SCHEMA = "VALIDATE_SCHEMA"
STEP_TRANSFORM = "TRANSFORM"
STEP_BUSINESS = "VALIDATE_BUSINESS"
REASON_SCHEMA = "Schema validation failed"
REASON_MISSING = "Mandatory columns missing from source header"
REASON_BUSINESS = "Business validation failed"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def error(field, value, rule: str, message, severity: str = "CRITICAL") -> Column:
    """An error struct; ``field``/``value``/``message`` may be str or Column."""

    def lit(x):
        if x is None:
            return F.lit(None).cast("string")
        return x.cast("string") if isinstance(x, Column) else F.lit(str(x))

    return F.struct(
        lit(field).alias("field"),
        lit(value).alias("value"),
        F.lit(rule).alias("rule"),
        lit(message).alias("message"),
        F.lit(severity).alias("severity"),
    )


def check(failed: Column, field, value, rule: str, message, severity: str = "CRITICAL") -> Column:
    """Error struct when ``failed`` is true; null when false or null."""
    return F.when(failed, error(field, value, rule, message, severity))


def collect_errors(checks: Sequence[Column]) -> Column:
    """Array of the failing checks' errors, in check order.

    Built as ``concat`` of one-element-or-empty arrays rather than
    ``array_compact``/``filter``: higher-order functions have no generated
    code, and one of them would push the whole projection (every regex and
    cast of every rule) out of whole-stage codegen.
    """
    empty = F.array().cast(ERRORS_TYPE)
    if not checks:
        return empty
    parts = [F.when(c.isNotNull(), F.array(c)).otherwise(empty) for c in checks]
    return F.concat(*parts).cast(ERRORS_TYPE) if len(parts) > 1 else parts[0].cast(ERRORS_TYPE)


def attach_errors(df: DataFrame, checks: Sequence[Column], name: str = "errors", labels: str | None = None) -> DataFrame:
    """Add the error array; with ``labels`` also a ``rule:field|...`` text
    column. The checks are columns of their own first, so that each is
    evaluated once a row, however often its outcome is asked for."""
    df, held = hold_checks(df, checks)
    cols = {name: collect_errors(held)}
    if labels:
        cols[labels] = check_labels(held)
    return df.withColumns(cols).drop(*[f"_check{i}" for i in range(len(held))])


def hold_checks(df: DataFrame, checks: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """``df`` with the checks as columns ``_check0``, ``_check1``, ..., and those columns."""
    names = [f"_check{i}" for i in range(len(checks))]
    return df.withColumns(dict(zip(names, checks))) if names else df, [F.col(n) for n in names]


def check_labels(checks: Sequence[Column], sep: str = "|") -> Column:
    """``rule:field`` of every failing check, in check order."""
    if not checks:
        return F.lit("")
    return F.concat_ws(sep, *[F.when(c.isNotNull(), F.concat_ws(":", c["rule"], c["field"])) for c in checks])


# --------------------------------------------------------------------- schema


def missing_mandatory(df: DataFrame, cfg: ValidationConfig) -> list[str]:
    """Mandatory columns absent from the dataset (plan time, no job)."""
    present = set(df.columns)
    return [c for c in cfg.mandatory_columns if c not in present]


def schema_checks(df: DataFrame, cfg: ValidationConfig) -> list[Column]:
    """Per-row schema rules: mandatory values, type compatibility, patterns.

    When a mandatory column is absent from the whole dataset every row gets
    one ``MANDATORY_COLUMN_MISSING`` error per absent column and nothing
    else is checked.
    """
    missing = missing_mandatory(df, cfg)
    if missing:
        return [
            error(c, None, MANDATORY_COLUMN_MISSING, f"Mandatory column is absent from dataset: {c}")
            for c in missing
        ]
    present = set(df.columns)
    out: list[Column] = []
    for c in cfg.mandatory_columns:
        v = _col(c)
        out.append(check(text.is_blank(v), c, v, NOT_NULL_OR_EMPTY, "Mandatory field is null or empty"))
    for c, typ in cfg.column_types.items():
        if c not in present:
            continue
        v = _col(c)
        s = v.cast("string")
        typ = typ.upper()
        if typ == "INTEGER":
            ok = money.is_int32_text(s)
        elif typ == "LONG":
            ok = money.is_int64_text(s)
        elif typ == "DECIMAL":
            ok = money.is_decimal_text(s)
        elif typ == "DATE":
            ok = dates.schema_date_ok(s, cfg.date_format, cfg.accept_iso8601_fallback)
        elif typ == "BOOLEAN":
            ok = F.lower(s).isin("true", "false")
        else:
            continue
        out.append(
            check(v.isNotNull() & ~F.coalesce(ok, F.lit(False)), c, v, TYPE_COMPATIBILITY,
                  f"Value is incompatible with expected type {typ}")
        )
    for c, regex in cfg.column_patterns.items():
        if c not in present:
            continue
        v = _col(c)
        out.append(
            check(v.isNotNull() & ~v.cast("string").rlike(f"^(?:{regex})$"), c, v, PATTERN_MISMATCH,
                  "Value does not match configured regex", "ERROR")
        )
    return out


def validate_schema(df: DataFrame, cfg: ValidationConfig, name: str = "errors", labels: str | None = None) -> DataFrame:
    return attach_errors(df, schema_checks(df, cfg), name, labels)


# ------------------------------------------------------------------- business


def allowed_future_days(cfg: ValidationConfig, field: str) -> Column:
    rule = cfg.future_date_rules.get(field)
    if rule is None:
        return F.lit(0)
    if not rule.condition_field:
        return F.lit(rule.allowed_days_in_future)
    if not rule.allowed_values:
        return F.lit(rule.allowed_days_in_future)
    cond = _col(rule.condition_field).cast("string").isin(rule.allowed_values)
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(rule.allowed_days_in_future)).otherwise(F.lit(0))


def business_checks(
    df: DataFrame,
    cfg: ValidationConfig,
    as_of: _dt.date,
    catalog_flags: dict[str, tuple[str, str | None]] | None = None,
) -> list[Column]:
    """Row rules of the business step (amounts, ranges, future dates,
    catalogs). Duplicate keys are flagged separately by ``dedup``.

    ``catalog_flags`` maps a field to ``(in_catalog_col, active_col)`` for
    table-backed catalogs joined beforehand (see ``lookup.catalog_flags``);
    other catalog fields use the inline value lists of the config.
    """
    present = set(df.columns)
    catalog_flags = catalog_flags or {}
    out: list[Column] = []
    for c in cfg.amount_fields:
        if c not in present:
            continue
        v = _col(c)
        amt = money.to_amount(v, "decimal(38,10)") if not isinstance(df.schema[c].dataType, T.NumericType) else v
        out.append(check(v.isNotNull() & amt.isNull(), c, v, TYPE_COMPATIBILITY, "Value is not a valid decimal"))
        if not cfg.allow_negative_amounts:
            out.append(check(amt < 0, c, v, NON_NEGATIVE_AMOUNT, "Negative amount is not allowed"))
    for c, rule in cfg.range_rules.items():
        if c not in present:
            continue
        v = _col(c)
        num = money.to_amount(v, "decimal(38,10)") if not isinstance(df.schema[c].dataType, T.NumericType) else v
        lo, hi = F.lit(rule.min).cast("decimal(38,10)"), F.lit(rule.max).cast("decimal(38,10)")
        bad = (num < lo) | (num > hi) if rule.inclusive else (num <= lo) | (num >= hi)
        out.append(check(v.isNotNull() & num.isNull(), c, v, TYPE_COMPATIBILITY, "Value is not a valid decimal"))
        out.append(check(bad, c, v, RANGE_CHECK, "Value is outside configured range"))
    as_of_lit = F.lit(as_of).cast("date")
    for c in cfg.future_date_fields:
        if c not in present:
            continue
        v = _col(c)
        d = dates.utc_date(v, isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType)))
        out.append(check(v.isNotNull() & d.isNull(), c, v, TYPE_COMPATIBILITY, "Value is not a valid date"))
        out.append(check(d > F.date_add(as_of_lit, allowed_future_days(cfg, c)), c, v, FUTURE_DATE,
                         "Future dates are not allowed"))
    for c, values in cfg.catalog_values.items():
        if c in catalog_flags:
            continue
        if c not in present:
            continue
        v = _col(c)
        out.append(check(v.isNotNull() & ~v.cast("string").isin(values), c, v, CATALOG_LOOKUP,
                         "Value is not present in configured catalog"))
    for c, values in cfg.active_catalog_values.items():
        if c in catalog_flags:
            continue
        if c not in present:
            continue
        v = _col(c)
        out.append(check(v.isNotNull() & ~v.cast("string").isin(values), c, v, ACTIVE_REFERENCE,
                         "Reference is not active"))
    for c, (in_col, active_col) in catalog_flags.items():
        v = _col(c)
        if in_col:
            out.append(check(v.isNotNull() & ~F.col(in_col), c, v, CATALOG_LOOKUP,
                             "Value is not present in configured catalog"))
        if active_col:
            out.append(check(v.isNotNull() & ~F.col(active_col), c, v, ACTIVE_REFERENCE, "Reference is not active"))
    return out


def duplicate_error(keys: Sequence[str], flag_col: str, row_col: str = "_row") -> Column:
    value = F.col(row_col) if row_col else None
    return check(F.col(flag_col), ",".join(keys), value, UNIQUE_BUSINESS_KEY, "Duplicate business key within batch")


# ---------------------------------------------------------------------- split


def split(df: DataFrame, name: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) by the size of the error array."""
    return df.filter(F.size(name) == 0), df.filter(F.size(name) > 0)


def error_level_counts(name: str = "errors") -> tuple[Column, Column]:
    """(critical count, non-critical count) of a row's errors."""
    crit = F.size(F.filter(F.col(name), lambda e: e["severity"] == "CRITICAL"))
    return crit, F.size(F.col(name)) - crit


def rule_list(name: str = "errors", sep: str = "|") -> Column:
    """``rule:field`` labels of a row's errors, in evaluation order."""
    return F.array_join(
        F.transform(F.col(name), lambda e: F.concat_ws(":", e["rule"], e["field"])), sep
    )


# ------------------------------------------------- documented extra rules


def max_age_check(col_name: str, as_of: _dt.date, max_days: int) -> Column:
    """Date older than ``as_of - max_days`` (rule ``MAX_AGE``)."""
    d = dates.utc_date(_col(col_name))
    return check(d < F.date_sub(F.lit(as_of), max_days), col_name, _col(col_name), "MAX_AGE",
                 f"Date is older than {max_days} days")


def blocked_domain_check(col_name: str, domains: Sequence[str]) -> Column:
    """E-mail whose domain is blocked (rule ``BLOCKED_DOMAIN``)."""
    dom = F.lower(F.substring_index(_col(col_name).cast("string"), "@", -1))
    return check(_col(col_name).contains("@") & dom.isin([d.lower() for d in domains]), col_name, _col(col_name),
                 "BLOCKED_DOMAIN", "E-mail domain is blocked")


def document_format_check(type_col: str, number_col: str, patterns: dict[str, str]) -> Column:
    """Document number must match the pattern of its document type
    (rule ``DOCUMENT_FORMAT``); types without a pattern pass."""
    t = F.upper(_col(type_col).cast("string"))
    n = _col(number_col).cast("string")
    bad = None
    for typ, rx in patterns.items():
        c = (t == typ.upper()) & ~n.rlike(f"^(?:{rx})$")
        bad = c if bad is None else (bad | c)
    if bad is None:
        return F.lit(None)
    return check(n.isNotNull() & bad, number_col, n, "DOCUMENT_FORMAT", "Document number does not match its type")


def near_duplicate_key(col) -> Column:
    """Grouping key for near-copies of text: ASCII-lower-cased, runs of
    whitespace collapsed, trimmed, then SHA-256 over the whole text."""
    c = F.col(col) if isinstance(col, str) else col
    lowered = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.trim(F.regexp_replace(lowered, "[ \\t\\n\\r]+", " "))
    return F.sha2(norm, 256)
