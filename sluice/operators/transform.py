"""The common transformation step as one projection.

Order per row: column names and strings, code maps, dates, currency,
derived columns, rounding. A row that fails any step is rejected on its own
with the first failure's message (``TRANSFORM_ERROR``); the other rows carry
on. Everything is a Column expression; nothing is evaluated per row in
Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import dates, money, text
from sluice.operators import lookup, rules
from sluice.plans.config import TransformationConfig

TRANSFORM_ERROR = "TRANSFORM_ERROR"
DERIVED_TYPE = "decimal(22,10)"
ROUNDED_TYPE = "decimal(38,16)"  # no product is formed from a value that is only rounded


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def normalize_strings(df: DataFrame, null_values) -> DataFrame:
    """Trim every string column; blanks and null tokens (any case) to null."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and not f.name.startswith("_"):
            cols.append(text.null_tokens(_q(f.name), null_values, case_sensitive=False).alias(f.name))
        else:
            cols.append(_q(f.name))
    return df.select(*cols)


class Step:
    """Collects a step's new values and failure messages and applies them in
    one projection, so every message sees the values before the step."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.msg_cols: list[str] = []
        self.held: list[str] = []

    def hold(self, name: str, value: Column) -> Column:
        """``value`` as a column until the step ends, so that what is read more than once is evaluated once a row."""
        self.held.append(name)
        self.df = self.df.withColumn(name, value)
        return _q(name)

    def apply(self, values: dict[str, Column], messages: list[Column]) -> DataFrame:
        names = [f"_msg{len(self.msg_cols) + i}" for i in range(len(messages))]
        self.msg_cols.extend(names)
        self.df = self.df.withColumns({**values, **dict(zip(names, messages))})
        return self.df

    def finish(self, rule: str, name: str) -> DataFrame:
        out = with_first_error(self.df, [F.col(c) for c in self.msg_cols], rule, name)
        return out.drop(*self.msg_cols, *self.held)


def with_first_error(df: DataFrame, messages: list[Column], rule: str = TRANSFORM_ERROR, name: str = "errors") -> DataFrame:
    """Set ``name`` to one error struct holding the first non-null message
    (or an empty array). Existing errors in ``name`` are kept in front."""
    msg = F.coalesce(*messages) if messages else F.lit(None).cast("string")
    new = F.when(msg.isNotNull(), F.array(rules.error(None, None, rule, msg))).otherwise(
        F.array().cast(rules.ERRORS_TYPE)
    ).cast(rules.ERRORS_TYPE)
    if name in df.columns:
        new = F.concat(F.col(name), new)
    return df.withColumn(name, new)


def common_transform(df: DataFrame, cfg: TransformationConfig, errors: str = "errors") -> DataFrame:
    """Apply the common rules; rows failing any of them get one
    ``TRANSFORM_ERROR`` in ``errors``. Needs a UTC session time zone."""
    df = text.snake_case_columns(df)
    df = normalize_strings(df, cfg.null_values)
    step = Step(df)
    present = set(df.columns)

    # code maps
    values, msgs = {}, []
    for fld, mapping in cfg.code_mappings.items():
        if fld not in present:
            continue
        policy = cfg.mapping_policies.get(fld, "REJECT")
        value, failed = lookup.map_code(_q(fld), mapping, policy, cfg.mapping_defaults.get(fld))
        msgs.append(F.when(failed, F.concat(F.lit(f"Missing code mapping for field {fld} and value "), _q(fld).cast("string"))))
        values[fld] = value
    step.apply(values, msgs)

    # code tables (D9): joined in, then the policies of code maps
    values, msgs = {}, []
    for fld, spec in cfg.code_tables.items():
        if fld not in present:
            continue
        codes = step.df.sparkSession.read.format(spec.get("format", "parquet")).load(spec["location"])
        codes = codes.select(F.col(spec["key"]).cast("string").alias("code"), F.col(spec["value"]).cast("string").alias("text"))
        step.df = lookup.map_table(step.df, fld, codes, "code", "text", out=f"_code_{fld}")
        value, failed = lookup.by_policy(_q(fld), _q(f"_code_{fld}").cast("string"), spec.get("policy", "REJECT"), spec.get("default"))
        msgs.append(F.when(failed, F.concat(F.lit(f"Missing code mapping for field {fld} and value "), _q(fld).cast("string"))))
        values[fld] = value
    step.apply(values, msgs)
    step.df = step.df.drop(*[f"_code_{fld}" for fld in values])

    # dates -> UTC timestamps
    values, msgs = {}, []
    for fld in cfg.date_fields:
        if fld not in present:
            continue
        dtype = step.df.schema[fld].dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            values[fld] = _q(fld).cast("timestamp")
        else:
            parsed = step.hold(f"_parsed_{fld}", dates.to_utc_timestamp_multi(_q(fld), cfg.source_timezone))
            msgs.append(F.when(_q(fld).isNotNull() & parsed.isNull(),
                               F.concat(F.lit("Cannot parse datetime: "), _q(fld).cast("string"))))
            values[fld] = parsed
    step.apply(values, msgs)

    # currency: the source currency is resolved once per row
    if cfg.monetary_fields:
        values, msgs = {}, []
        cur = _q(cfg.currency_field).cast("string") if cfg.currency_field in present else F.lit(None).cast("string")
        src = money.resolve_currency(cur, cfg.default_currency, cfg.base_currency)
        any_amount = None
        for fld in cfg.monetary_fields:
            if fld not in present:
                continue
            raw = _q(fld)
            numeric = isinstance(step.df.schema[fld].dataType, T.NumericType)
            amt = raw.try_cast(money.AMOUNT_TYPE) if numeric else money.to_amount(raw)
            amt = step.hold(f"_amount_{fld}", amt)
            msgs.append(F.when(raw.isNotNull() & amt.isNull(),
                               F.concat(F.lit(f"Invalid decimal value for field {fld}: "), raw.cast("string"))))
            values[f"{fld}_original"] = F.when(raw.isNotNull(), amt)
            values[fld] = F.when(raw.isNotNull(), money.convert(amt, src, cfg.currency_rates))
            has = raw.isNotNull()
            any_amount = has if any_amount is None else (any_amount | has)
        if any_amount is not None:
            values["currency_original"] = F.when(any_amount, src)
            values[cfg.currency_field] = F.when(any_amount, F.lit(cfg.base_currency)).otherwise(cur)
        step.apply(values, msgs)

    # derived columns, in configured order (later formulas see earlier results)
    for fld, formula in cfg.derived_columns.items():
        try:
            left_t, op, right_t = money.parse_formula(formula)
        except ValueError as exc:
            step.apply({}, [F.lit(str(exc))])
            continue
        cols = set(step.df.columns)
        left = _operand(step.df, left_t, cols)
        right = _operand(step.df, right_t, cols)
        value, msg = money.formula_value(left, op, right)
        step.apply({fld: value.cast(DERIVED_TYPE)}, [F.when(msg.isNotNull(), F.concat(msg, F.lit(f": {formula}")))])

    # rounding, last
    values, msgs = {}, []
    for fld in cfg.rounding_fields:
        if fld not in step.df.columns:
            continue
        c = _q(fld)
        num = c if isinstance(step.df.schema[fld].dataType, T.DecimalType) else money.to_amount(c, ROUNDED_TYPE)
        msgs.append(F.when(c.isNotNull() & num.isNull(), F.lit(f"Invalid decimal value for field {fld}")))
        values[fld] = money.round_decimal(num, cfg.rounding_scale, cfg.rounding_mode).cast(
            f"decimal(38,{cfg.rounding_scale})")
    step.apply(values, msgs)
    return step.finish(TRANSFORM_ERROR, errors)


def _operand(df: DataFrame, token: str, cols: set[str]) -> Column:
    if token in cols:
        dtype = df.schema[token].dataType
        c = _q(token)
        return c.try_cast(DERIVED_TYPE) if isinstance(dtype, T.NumericType) else money.to_amount(c, DERIVED_TYPE)
    return money.formula_operand(token, set()).cast(DERIVED_TYPE)
