"""String normalisation as Column builders (JVM-side, codegen friendly).

All functions take and return ``Column`` so they compose inside one
``select`` and never leave the JVM. Java whitespace semantics are kept where
the rules depend on them: ``String.trim`` strips every char <= U+0020 and
``\\s`` is ``[ \\t\\n\\x0B\\f\\r]``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
JAVA_TRIM_CLASS = "[\\x00-\\x20]"
JAVA_SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
EMAIL_PATTERN = "^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"
DEFAULT_NULL_TOKENS = ("", "NULL", "N/A", "-")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))


def trim_ws(col) -> Column:
    """Java ``String.trim``: strip control chars and spaces at both ends."""
    return F.btrim(_c(col), F.lit(JAVA_TRIM_CHARS))


def trim_to_null(col) -> Column:
    t = trim_ws(col)
    return F.when(t != "", t)


def is_blank(col) -> Column:
    """True when null or empty after trimming (never null itself)."""
    return F.coalesce(trim_ws(_c(col).cast("string")) == "", F.lit(True))


def collapse_spaces(col) -> Column:
    return F.regexp_replace(_c(col), f"{JAVA_SPACE_CLASS}+", " ")


def null_tokens(col, tokens: Iterable[str] = DEFAULT_NULL_TOKENS, case_sensitive: bool = False) -> Column:
    """Trim, then map blank values and configured null tokens to null.

    ``case_sensitive=True`` is the CSV-reader flavour (exact token match on
    the raw or trimmed cell); the transformer flavour ignores case.
    """
    raw = _c(col)
    t = trim_ws(raw)
    toks = [x for x in tokens if x is not None]
    if case_sensitive:
        hit = t.isin(toks) if toks else F.lit(False)
        # a raw cell that equals a trimmed token is equal once trimmed, too
        padded = [x for x in toks if x != x.strip(JAVA_TRIM_CHARS)]
        if padded:
            hit = hit | raw.isin(padded)
    else:
        # upper case never has fewer characters: longer cells need not be converted
        upper = [x.upper() for x in toks]
        hit = (F.length(t) <= max(map(len, upper))) & F.upper(t).isin(upper) if toks else F.lit(False)
    return F.when((t == "") | hit, F.lit(None).cast("string")).otherwise(t)


def title_case(col) -> Column:
    """Lower-case, single spaces, first letter of each word upper-cased."""
    t = trim_ws(collapse_spaces(trim_ws(F.lower(_c(col)))))
    return F.when(t == "", _c(col)).otherwise(F.initcap(t))


def upper_code(col) -> Column:
    """Trimmed upper-case code; null when blank (callers reject on null)."""
    return F.upper(trim_to_null(col))


def collapse_text(col) -> Column:
    """Trim to null, then collapse runs of whitespace to one space."""
    return collapse_spaces(trim_to_null(col))


def lower_text(col) -> Column:
    return F.lower(collapse_text(col))


def name_case(col) -> Column:
    """Person-name case: keep letters, spaces, ``-`` and ``'``; capitalise
    the first letter of every word and after every ``-`` or ``'``."""
    cleaned = trim_ws(collapse_spaces(F.regexp_replace(trim_to_null(col), "[^\\p{L}\\s\\-']", " ")))
    pieces = F.split(F.lower(cleaned), "(?<=[ '\\-])")
    capped = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.array_join(capped, "")


def normalize_email(col) -> Column:
    return F.lower(trim_ws(col))


def is_valid_email(col) -> Column:
    """Null-safe: blank or malformed gives False."""
    t = trim_ws(col)
    return F.coalesce(t.rlike(EMAIL_PATTERN) & (t != ""), F.lit(False))


def truncate(col, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def phone_e164(col, country_col, dial_codes: dict[str, str]) -> Column:
    """Digits with a country dial prefix; ``+``-prefixed input kept as is.

    Null when the value has no digits or the country has no dial code.
    """
    v = trim_to_null(col)
    digits = F.when(v.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(F.substring(v, 2, 1 << 30), "\\D", ""))) \
        .otherwise(F.regexp_replace(v, "\\D", ""))
    dial = F.element_at(F.create_map(*[F.lit(x) for kv in dial_codes.items() for x in kv]), _c(country_col)) \
        if dial_codes else F.lit(None).cast("string")
    return (
        F.when((digits == "") | (digits == "+"), F.lit(None).cast("string"))
        .when(digits.startswith("+"), digits)
        .when(dial.isNull(), F.lit(None).cast("string"))
        .when(digits.startswith(dial), F.concat(F.lit("+"), digits))
        .otherwise(F.concat(F.lit("+"), dial, digits))
    )


def normalize_sku(col) -> Column:
    """Upper-case, whitespace to ``-``, squeeze ``-``, drop leading zeros of
    all-digit segments. Null when blank or when a digit segment overflows a
    32-bit int (both are rejects)."""
    t = trim_to_null(col)
    dashed = F.regexp_replace(F.regexp_replace(F.upper(t), f"{JAVA_SPACE_CLASS}+", "-"), "-+", "-")
    segs = F.transform(
        F.split(dashed, "-"),
        lambda s: F.when(s.rlike("^[0-9]+$"), s.try_cast("int").cast("string")).otherwise(s),
    )
    overflow = F.exists(segs, lambda s: s.isNull())
    joined = F.regexp_replace(F.array_join(segs, "-"), "-+$", "")
    return F.when(t.isNull() | overflow, F.lit(None).cast("string")).otherwise(joined)


def snake_case(name: str) -> str:
    """Column-name normalisation (plain Python, runs on ``df.columns``)."""
    s = name.replace(" ", "_").replace("-", "_").replace(".", "_")
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"([a-z])([A-Z])", r"\1_\2", s)
    return s.lower()


def snake_case_columns(df):
    """Rename every column to snake_case; on a name collision the later
    column wins, as when the same key is put twice into an ordered map."""
    target = [snake_case(c) for c in df.columns]
    keep = {}
    for i, name in enumerate(target):
        keep[name] = i
    cols = df.columns
    return df.select(*[F.col(f"`{cols[i]}`").alias(name) for name, i in sorted(keep.items(), key=lambda kv: kv[1])])
