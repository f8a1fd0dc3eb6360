"""Pipeline configuration: dataclasses plus a YAML reader.

Keys follow the reference's YAML layout (kebab-case); ``${VAR:default}``
placeholders are substituted from the environment. Unlike the reference's
reader, code mappings, mapping policies/defaults and derived columns are
accepted from YAML too (they were reachable only from code there).
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import yaml

_PLACEHOLDER = re.compile(r"\$\{([A-Za-z0-9_.]+)(?::([^}]*))?\}")
DUPLICATE_OPTIONS = ("REJECT_EXCEPT_FIRST", "REJECT_ALL", "CONSOLIDATE")
SAFE_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def substitute(text: str, env: dict | None = None) -> str:
    env = os.environ if env is None else env

    def repl(m):
        return env.get(m.group(1), m.group(2) if m.group(2) is not None else "")

    return _PLACEHOLDER.sub(repl, text)


@dataclass
class SourceConfig:
    type: str = "CSV"
    location: str = ""
    encoding: str = "UTF-8"
    delimiter: str = ","
    quote_char: str = '"'
    has_header: bool = True
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class TargetConfig:
    type: str = "DATABASE"
    schema: str = "public"
    staging_table: str = ""
    final_table: str = ""
    load_strategy: str = "UPSERT"  # INSERT | UPSERT | REPLACE
    business_key: list[str] = field(default_factory=list)
    chunk_size: int = 1000
    fail_fast_on_chunk_error: bool = True
    rollback_strategy: str = "DELETE_BY_EXECUTION"  # or NONE
    closed_record_guard_enabled: bool = False
    closed_flag_column: str | None = None
    closed_flag_value: str | None = None
    not_null_columns: list[str] = field(default_factory=list)
    immutable_columns: list[str] = field(default_factory=list)
    non_negative_columns: list[str] = field(default_factory=list)
    max_lengths: dict[str, int] = field(default_factory=dict)
    decimal_types: dict[str, str] = field(default_factory=dict)


@dataclass
class RangeRule:
    min: Decimal
    max: Decimal
    inclusive: bool = True


@dataclass
class FutureDateRule:
    allowed_days_in_future: int = 0
    condition_field: str | None = None
    allowed_values: list[str] = field(default_factory=list)


@dataclass
class ValidationConfig:
    mandatory_columns: list[str] = field(default_factory=list)
    column_types: dict[str, str] = field(default_factory=dict)
    column_patterns: dict[str, str] = field(default_factory=dict)
    date_format: str | None = None
    accept_iso8601_fallback: bool = True
    amount_fields: list[str] = field(default_factory=list)
    allow_negative_amounts: bool = False
    range_rules: dict[str, RangeRule] = field(default_factory=dict)
    future_date_fields: list[str] = field(default_factory=list)
    future_date_rules: dict[str, FutureDateRule] = field(default_factory=dict)
    catalog_values: dict[str, list[str]] = field(default_factory=dict)
    active_catalog_values: dict[str, list[str]] = field(default_factory=dict)
    unique_key_columns: list[str] = field(default_factory=list)
    reject_all_duplicates: bool = False
    duplicates: str = ""  # REJECT_EXCEPT_FIRST, REJECT_ALL or CONSOLIDATE; empty: by reject_all_duplicates
    consolidate_by: str | None = None  # the latest row by this column gives consolidate_latest's values
    consolidate_sum: list[str] = field(default_factory=list)
    consolidate_latest: list[str] = field(default_factory=list)
    error_threshold_percent: float = 5.0
    abort_on_threshold_breach: bool = True
    threshold_scope: str = "step"  # "step" (as coded) or "cumulative"


@dataclass
class TransformationConfig:
    source_timezone: str = "UTC"
    date_format: str | None = None
    currency_field: str = "currency"
    base_currency: str = "USD"
    default_currency: str | None = None
    currency_rates: dict[str, Decimal] = field(default_factory=dict)
    monetary_fields: list[str] = field(default_factory=list)
    null_values: list[str] = field(default_factory=lambda: ["", "NULL", "N/A", "-"])
    date_fields: list[str] = field(default_factory=list)
    rounding_scale: int = 2
    rounding_mode: str = "HALF_UP"
    rounding_fields: list[str] = field(default_factory=list)
    code_mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    mapping_policies: dict[str, str] = field(default_factory=dict)
    mapping_defaults: dict[str, str] = field(default_factory=dict)
    # field: location and format of a table, its key and value columns, policy and default for unknown codes
    code_tables: dict[str, dict[str, str]] = field(default_factory=dict)
    derived_columns: dict[str, str] = field(default_factory=dict)  # insertion order is evaluation order


@dataclass
class RetryPolicy:
    max_retries: int = 0
    retry_delay_ms: int = 0
    retry_on_errors: list[str] = field(default_factory=list)


@dataclass
class ScheduleConfig:
    cron: str | None = None
    timezone: str = "UTC"
    allowed_windows: list[dict] = field(default_factory=list)


@dataclass
class PipelineConfig:
    id: str
    name: str
    version: str = "1.0.0"
    description: str = ""
    status: str = "ACTIVE"
    source: SourceConfig = field(default_factory=SourceConfig)
    target: TargetConfig = field(default_factory=TargetConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    transformation: TransformationConfig = field(default_factory=TransformationConfig)
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    schedule: ScheduleConfig = field(default_factory=ScheduleConfig)


def _g(d: dict, key: str, default=None):
    return d.get(key, default) if d else default


def _dec(v) -> Decimal:
    return Decimal(str(v))


def from_dict(doc: dict) -> PipelineConfig:
    p = doc.get("pipeline", doc)
    sc = p.get("source-config", {}) or {}
    tc = p.get("target-config", {}) or {}
    vc = p.get("validation-config", {}) or {}
    xc = p.get("transformation-config", {}) or {}
    rc = p.get("retry-policy", {}) or {}
    sch = p.get("schedule-config", {}) or {}
    props = {str(k): "" if v is None else str(v) for k, v in (_g(sc, "connection-properties", {}) or {}).items()}
    source = SourceConfig(
        type=str(_g(sc, "type", "CSV")).upper(),
        location=str(_g(sc, "location", "")),
        encoding=str(_g(sc, "encoding", "UTF-8")),
        delimiter=str(_g(sc, "delimiter", ",")),
        quote_char=str(_g(sc, "quote-char", '"')),
        has_header=bool(_g(sc, "has-header", True)),
        properties=props,
    )
    target = TargetConfig(
        type=str(_g(tc, "type", "DATABASE")).upper(),
        schema=str(_g(tc, "schema", "public")),
        staging_table=str(_g(tc, "staging-table", "")),
        final_table=str(_g(tc, "final-table", "")),
        load_strategy=str(_g(tc, "load-strategy", "UPSERT")).upper(),
        business_key=list(_g(tc, "business-key", []) or []),
        chunk_size=int(_g(tc, "chunk-size", 1000)),
        fail_fast_on_chunk_error=bool(_g(tc, "fail-fast-on-chunk-error", True)),
        rollback_strategy=str(_g(tc, "rollback-strategy", "DELETE_BY_EXECUTION")).upper(),
        closed_record_guard_enabled=bool(_g(tc, "closed-record-guard-enabled", False)),
        closed_flag_column=_g(tc, "closed-flag-column"),
        closed_flag_value=_g(tc, "closed-flag-value"),
        not_null_columns=list(_g(tc, "not-null-columns", []) or []),
        immutable_columns=list(_g(tc, "immutable-columns", []) or []),
        non_negative_columns=list(_g(tc, "non-negative-columns", []) or []),
        max_lengths={k: int(v) for k, v in (_g(tc, "max-lengths", {}) or {}).items()},
        decimal_types={k: str(v) for k, v in (_g(tc, "decimal-types", {}) or {}).items()},
    )
    ranges = {
        k: RangeRule(_dec(v["min"]), _dec(v["max"]), bool(v.get("inclusive", True)))
        for k, v in (_g(vc, "range-rules", {}) or {}).items()
    }
    fdr = {
        k: FutureDateRule(
            int(v.get("allowed-days-in-future", 0) or 0),
            v.get("condition-field"),
            [str(x) for x in (v.get("allowed-values") or [])],
        )
        for k, v in (_g(vc, "future-date-rules", {}) or {}).items()
    }
    duplicates = str(_g(vc, "duplicates", "") or "").upper()
    merged = _g(vc, "consolidate", {}) or {}
    if duplicates not in ("", *DUPLICATE_OPTIONS):
        raise ValueError(f"duplicates must be one of {', '.join(DUPLICATE_OPTIONS)}, not {duplicates}")
    if duplicates == "CONSOLIDATE" and not _g(merged, "by"):
        raise ValueError("CONSOLIDATE needs the column that tells the latest row (consolidate: by)")
    validation = ValidationConfig(
        mandatory_columns=list(_g(vc, "mandatory-columns", []) or []),
        column_types={k: str(v).upper() for k, v in (_g(vc, "column-types", {}) or {}).items()},
        column_patterns=dict(_g(vc, "column-patterns", {}) or {}),
        date_format=_g(vc, "date-format", _g(xc, "date-format")),
        accept_iso8601_fallback=bool(_g(vc, "accept-iso8601-fallback", True)),
        amount_fields=list(_g(vc, "amount-fields", []) or []),
        allow_negative_amounts=bool(_g(vc, "allow-negative-amounts", False)),
        range_rules=ranges,
        future_date_fields=list(_g(vc, "future-date-fields", []) or []),
        future_date_rules=fdr,
        catalog_values={k: [str(x) for x in v] for k, v in (_g(vc, "catalog-values", {}) or {}).items()},
        active_catalog_values={k: [str(x) for x in v] for k, v in (_g(vc, "active-catalog-values", {}) or {}).items()},
        unique_key_columns=list(_g(vc, "unique-key-columns", []) or []),
        reject_all_duplicates=duplicates == "REJECT_ALL" if duplicates else bool(_g(vc, "reject-all-duplicates", False)),
        duplicates=duplicates,
        consolidate_by=_g(merged, "by"),
        consolidate_sum=list(_g(merged, "sum", []) or []),
        consolidate_latest=list(_g(merged, "latest", []) or []),
        error_threshold_percent=float(_g(vc, "error-threshold-percent", 5.0)),
        abort_on_threshold_breach=bool(_g(vc, "abort-on-threshold-breach", True)),
        threshold_scope=str(_g(vc, "threshold-scope", "step")),
    )
    transformation = TransformationConfig(
        source_timezone=str(_g(xc, "source-timezone", "UTC")),
        date_format=_g(xc, "date-format"),
        currency_field=str(_g(xc, "currency-field", "currency")),
        base_currency=str(_g(xc, "base-currency", "USD")),
        default_currency=_g(xc, "default-currency"),
        currency_rates={k: _dec(v) for k, v in (_g(xc, "currency-rates", {}) or {}).items()},
        monetary_fields=list(_g(xc, "monetary-fields", []) or []),
        null_values=[str(x) for x in (_g(xc, "null-values", ["", "NULL", "N/A", "-"]) or [])],
        date_fields=list(_g(xc, "date-fields", []) or []),
        rounding_scale=int(_g(xc, "rounding-scale", 2)),
        rounding_mode=str(_g(xc, "rounding-mode", "HALF_UP")).upper(),
        rounding_fields=list(_g(xc, "rounding-fields", []) or []),
        code_mappings={k: {str(a): str(b) for a, b in v.items()} for k, v in (_g(xc, "code-mappings", {}) or {}).items()},
        mapping_policies={k: str(v).upper() for k, v in (_g(xc, "mapping-policies", {}) or {}).items()},
        mapping_defaults={k: v for k, v in (_g(xc, "mapping-defaults", {}) or {}).items()},
        code_tables={k: {str(a): str(b) for a, b in v.items()} for k, v in (_g(xc, "code-tables", {}) or {}).items()},
        derived_columns=dict(_g(xc, "derived-columns", {}) or {}),
    )
    retry = RetryPolicy(
        max_retries=int(_g(rc, "max-retries", 0)),
        retry_delay_ms=int(_g(rc, "retry-delay-ms", 0)),
        retry_on_errors=[str(x).upper() for x in (_g(rc, "retry-on-errors", []) or [])],
    )
    schedule = ScheduleConfig(
        cron=_g(sch, "cron"),
        timezone=str(_g(sch, "timezone", "UTC")),
        allowed_windows=[
            {"start": str(w["start"]), "end": str(w["end"]), "days": [str(d).upper() for d in (w.get("days") or [])]}
            for w in (_g(sch, "allowed-windows", []) or [])
        ],
    )
    return PipelineConfig(
        id=str(p.get("id", p.get("name", ""))),
        name=str(p.get("name", "")),
        version=str(p.get("version", "1.0.0")),
        description=str(p.get("description", "")),
        status=str(p.get("status", "ACTIVE")),
        source=source,
        target=target,
        validation=validation,
        transformation=transformation,
        retry=retry,
        schedule=schedule,
    )


def load_yaml(path_or_text: str, env: dict | None = None) -> PipelineConfig:
    if "\n" not in path_or_text and os.path.exists(path_or_text):
        with open(path_or_text, encoding="utf-8") as fh:
            text = fh.read()
    else:
        text = path_or_text
    return from_dict(yaml.safe_load(substitute(text, env)))


def check_identifier(name: str) -> str:
    """Configured table/column names must be plain identifiers."""
    if not name or not SAFE_IDENTIFIER.fullmatch(name):
        raise ValueError(f"Unsafe SQL identifier: {name}")
    return name


def as_dict(obj: Any) -> Any:
    from dataclasses import asdict

    return asdict(obj)


BUILTIN_DIR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "builtin")


def builtin(name: str, env: dict | None = None) -> PipelineConfig:
    """One of the built-in pipelines: sales, customer, inventory, item."""
    return load_yaml(os.path.join(BUILTIN_DIR, f"{name}.yml"), env)
