"""Documented transformation kinds: name split/combine, composite split and
the derived-column types (percentage, concatenation, date difference,
conditional, lookup). All are Column builders returning ``(value, failed)``
or plain values; rejects are raised by the caller as rule errors.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import collapse_spaces, title_case, trim_to_null, trim_ws


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalized_name(col) -> Column:
    """Trim, collapse spaces, title case; null when blank."""
    t = trim_to_null(collapse_spaces(trim_ws(_c(col))))
    return F.when(t.isNotNull(), title_case(t))


def split_name(full, single_word: str = "LAST_NAME") -> tuple[Column, Column, Column]:
    """FIRST_SPACE split of a full name: ``(first, last, failed)``.

    Single-word names: ``LAST_NAME`` (whole value is the last name, first
    is null), ``FIRST_NAME`` (the reverse) or ``REJECT``. Blank rejects.
    """
    n = normalized_name(full)
    pos = F.instr(n, " ")
    has_space = pos > 0
    first = F.when(has_space, F.substring_index(n, " ", 1))
    last = F.when(has_space, F.substring(n, pos + 1, 1 << 30))
    mode = single_word.upper()
    if mode == "FIRST_NAME":
        first = F.when(has_space, first).otherwise(n)
    elif mode == "LAST_NAME":
        last = F.when(has_space, last).otherwise(n)
    failed = n.isNull() | (F.lit(mode == "REJECT") & ~has_space)
    return first, last, failed


def combine_name(first, last, separator: str = " ") -> Column:
    """Normalised first and last name joined (null parts skipped)."""
    return F.concat_ws(separator, normalized_name(first), normalized_name(last))


def split_composite(col, delimiter: str, targets: Mapping[int, str], extras: str = "TRUNCATE",
                    default: str | None = None) -> tuple[dict[str, Column], Column]:
    """Positional split of a packed field into target columns.

    Missing positions get ``default`` (null by default); more elements than
    targets are dropped (``TRUNCATE``) or make the row fail (``REJECT``).
    """
    parts = F.split(_c(col), re.escape(delimiter), -1)
    values = {}
    for idx, name in sorted(targets.items()):
        v = trim_to_null(F.get(parts, F.lit(idx)))
        values[name] = F.coalesce(v, F.lit(default)) if default is not None else v
    width = max(targets) + 1 if targets else 0
    failed = F.lit(False)
    if extras.upper() == "REJECT":
        failed = F.coalesce(F.size(parts) > width, F.lit(False))
    return values, failed


def percentage(base, rate, scale: int = 2) -> Column:
    return F.round(_c(base).cast("decimal(22,8)") * _c(rate).cast("decimal(12,6)") / F.lit(100), scale)


def concatenation(parts: Sequence) -> Column:
    """Columns and literal pieces joined; null columns contribute nothing."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def date_diff_days(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later`` (dates or timestamps)."""
    return F.datediff(F.to_date(_c(later)), F.to_date(_c(earlier)))


def conditional(col, equals, then, otherwise) -> Column:
    return F.when(_c(col) == F.lit(equals), F.lit(then)).otherwise(F.lit(otherwise))


def lookup(col, mapping: Mapping[str, str], default: str | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.element_at(m, _c(col).cast("string"))
    return F.coalesce(v, F.lit(default)) if default is not None else v
