"""Decimal parsing, currency conversion, derived formulas and rounding.

Java's BigDecimal is unbounded; Spark decimals hold 38 digits. Amounts are
carried as DECIMAL(20,8) and rates as DECIMAL(17,8), so a product is exact
(DECIMAL(38,16)). Values outside those ranges become null and are rejected by
the calling rule instead of being silently rounded.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


AMOUNT_TYPE = "decimal(20,8)"
RATE_TYPE = "decimal(17,8)"
# BigDecimal(String) grammar: sign, digits with optional point, exponent.
DECIMAL_SYNTAX = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_SYNTAX = "^[+-]?[0-9]+$"
ROUNDING_MODES = ("UP", "DOWN", "CEILING", "FLOOR", "HALF_UP", "HALF_DOWN", "HALF_EVEN", "UNNECESSARY")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_decimal_text(col) -> Column:
    return _c(col).cast("string").rlike(DECIMAL_SYNTAX)


def to_amount(col, dtype: str = AMOUNT_TYPE) -> Column:
    """Parse BigDecimal-syntax text (or a number) to a decimal; null if the
    syntax is wrong or the value does not fit."""
    s = _c(col).cast("string")
    return F.when(s.rlike(DECIMAL_SYNTAX), s.try_cast(dtype))


def is_int32_text(col) -> Column:
    s = _c(col).cast("string")
    return s.rlike(INTEGER_SYNTAX) & s.try_cast("int").isNotNull()


def is_int64_text(col) -> Column:
    s = _c(col).cast("string")
    return s.rlike(INTEGER_SYNTAX) & s.try_cast("long").isNotNull()


def rate_lookup(currency: Column, rates: Mapping[str, object]) -> Column:
    """Rate for a currency code; unknown codes give 1."""
    if not rates:
        return F.lit(1).cast(RATE_TYPE)
    m = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(str(v)).cast(RATE_TYPE))])
    return F.coalesce(F.element_at(m, currency), F.lit(1).cast(RATE_TYPE))


def resolve_currency(currency_col: Column, default_currency: str | None, base_currency: str) -> Column:
    return F.coalesce(currency_col, F.lit(default_currency or base_currency))


def convert(amount: Column, currency: Column, rates: Mapping[str, object]) -> Column:
    return (amount.cast(AMOUNT_TYPE) * rate_lookup(currency, rates)).cast("decimal(38,16)")


def round_decimal(col, scale: int = 2, mode: str = "HALF_UP") -> Column:
    """``BigDecimal.setScale(scale, mode)`` for every ``RoundingMode``."""
    c = _c(col)
    mode = (mode or "HALF_UP").upper()
    if mode == "HALF_UP":
        return F.round(c, scale)
    if mode == "HALF_EVEN":
        return F.bround(c, scale)
    if mode == "FLOOR":
        return F.floor(c, F.lit(scale))
    if mode == "CEILING":
        return F.ceil(c, F.lit(scale))
    if mode == "DOWN":
        return F.when(c >= 0, F.floor(c, F.lit(scale))).otherwise(F.ceil(c, F.lit(scale)))
    if mode == "UP":
        return F.when(c >= 0, F.ceil(c, F.lit(scale))).otherwise(F.floor(c, F.lit(scale)))
    if mode == "HALF_DOWN":
        # round half toward zero: the value a tie would reach going down
        unit = F.lit(10) ** F.lit(-scale)
        down = F.when(c >= 0, F.floor(c, F.lit(scale))).otherwise(F.ceil(c, F.lit(scale)))
        up = F.when(c >= 0, F.ceil(c, F.lit(scale))).otherwise(F.floor(c, F.lit(scale)))
        dist_down = F.abs(c - down)
        return F.when(dist_down * 2 > unit.cast("decimal(38,18)"), up).otherwise(down)
    if mode == "UNNECESSARY":
        r = F.round(c, scale)
        return F.when(r == c, r).otherwise(F.raise_error(F.lit("Rounding necessary")))
    raise ValueError(f"unknown rounding mode {mode}")


def formula_operand(token: str, columns: set[str]) -> Column:
    """A derived-formula token: column reference if such a column exists,
    else a numeric literal (a bad literal makes every row a reject)."""
    if token in columns:
        return to_amount(F.col(f"`{token}`"), "decimal(38,16)")
    return F.lit(token).try_cast("decimal(38,16)") if _is_number(token) else F.lit(None).cast("decimal(38,16)")


def _is_number(token: str) -> bool:
    import re

    return re.fullmatch(DECIMAL_SYNTAX.replace("\\\\", "\\"), token) is not None


def parse_formula(formula: str) -> tuple[str, str, str]:
    tokens = formula.strip().split()
    if len(tokens) != 3:
        raise ValueError(f"Unsupported derived formula: {formula}")
    if tokens[1] not in ("+", "-", "*", "/"):
        raise ValueError(f"Unsupported operator in formula: {formula}")
    return tokens[0], tokens[1], tokens[2]


def formula_value(left: Column, op: str, right: Column) -> tuple[Column, Column]:
    """(value, error_message) for ``left op right``; value is null and the
    message set when an operand is invalid or the divisor is zero."""
    if op == "+":
        v = left + right
    elif op == "-":
        v = left - right
    elif op == "*":
        v = left * right
    else:
        v = F.round(F.try_divide(left, right), 8)
    msg = F.when(left.isNull() | right.isNull(), F.lit("Invalid operand in derived formula"))
    if op == "/":
        msg = msg.when(right == 0, F.lit("Division by zero in formula"))
    return F.when(msg.isNull(), v.cast("decimal(38,16)")), msg


def sales_amounts(amount: Column, quantity: Column, discount_rate: Column, tax_rate: str = "0.19") -> dict[str, Column]:
    """Subtotal, tax and total of a sale line, each HALF_UP to 2 decimals
    from unrounded values.

    subtotal = amount * quantity * (1 - round(discount / 100, 8)),
    tax = subtotal * tax_rate, total = subtotal + tax. Widths are chosen so
    every intermediate is exact in Spark's decimal arithmetic (amount below
    1e14, quantity below 1e7); larger values, and results beyond 16 digits
    before the point, give null (a reject).
    """
    return sales_totals(*sales_terms(amount, quantity, discount_rate), tax_rate)


def sales_terms(amount: Column, quantity: Column, discount_rate: Column) -> tuple[Column, Column]:
    """Discount rate and unrounded subtotal, of which ``sales_totals`` makes the amounts."""
    amt = amount.try_cast("decimal(16,2)")
    qty = quantity.try_cast("decimal(7,0)")
    disc = discount_rate.try_cast("decimal(20,8)")
    mult = (F.lit(1).cast("decimal(1,0)") - F.round(disc / F.lit(100).cast("decimal(3,0)"), 8)).try_cast("decimal(12,8)")
    return disc, (amt * qty * mult).try_cast("decimal(34,10)")


def sales_totals(disc: Column, sub: Column, tax_rate: str = "0.19") -> dict[str, Column]:
    tax = sub * F.lit(tax_rate).cast("decimal(2,2)")
    total = sub * (F.lit(1) + F.lit(tax_rate).cast("decimal(2,2)")).cast("decimal(3,2)")
    return {
        "discount_rate": F.round(disc, 2).try_cast("decimal(18,2)"),
        "subtotal": F.round(sub, 2).try_cast("decimal(18,2)"),
        "tax_amount": F.round(tax, 2).try_cast("decimal(18,2)"),
        "total_amount": F.round(total, 2).try_cast("decimal(18,2)"),
    }
