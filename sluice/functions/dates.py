"""Date and time parsing as Column builders.

Parsing tries a fixed list of patterns in order (day-first before
month-first), first match wins, exactly as the reference's date helper.
Spark's parser is strict on field width and impossible days; the reference's
lenient SMART resolution (``31/02`` becomes ``28/02``) is not reproduced:
such values are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import trim_ws

# Accepted datetime patterns, then date patterns, in order.
DATETIME_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
)
# Documented extension: ISO date-times with a zone offset or Z, converted to UTC.
OFFSET_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
)
DATE_PATTERNS = (
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "yyyyMMdd",
)
ISO_DATE = "yyyy-MM-dd"
DAY_NAMES = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pattern_shape(pattern: str) -> str:
    """A regex matching the text shapes a datetime pattern can parse.

    Used as a cheap guard before ``try_to_timestamp``: a failed parse costs
    an exception inside Spark, a failed regex match does not. The shape is
    only a pre-filter; the parser still decides.
    """
    out, i = [], 0
    widths = {"y": "4,", "M": "1,2", "d": "1,2", "H": "1,2", "h": "1,2", "m": "1,2", "s": "1,2", "S": "1,9"}
    while i < len(pattern):
        ch = pattern[i]
        if ch == "'":
            j = pattern.index("'", i + 1)
            out.append(re.escape(pattern[i + 1:j]) if j > i + 1 else "'")
            i = j + 1
            continue
        if ch == "[":
            out.append("(?:")
            i += 1
            continue
        if ch == "]":
            out.append(")?")
            i += 1
            continue
        if ch.isalpha():
            j = i
            while j < len(pattern) and pattern[j] == ch:
                j += 1
            n = j - i
            if ch == "y":
                out.append("[0-9]{2}" if n == 2 else "[0-9]{%d,}" % max(n, 1))
            elif ch == "S":
                out.append("[0-9]{1,%d}" % n)
            elif ch in widths:
                out.append("[0-9]{%d}" % n if n >= 2 else "[0-9]{%s}" % widths[ch])
            elif ch == "X":
                out.append("(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)")
            else:
                out.append("[^ ]+")
            i = j
            continue
        out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def _try_parse(col: Column, pattern: str) -> Column:
    return F.when(col.rlike(pattern_shape(pattern)), F.try_to_timestamp(col, F.lit(pattern)))


def _first(col: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[_try_parse(col, p) for p in patterns])


def parse_date(col) -> Column:
    """First matching date pattern, as DATE; null when none matches."""
    return F.to_date(_first(trim_ws(_c(col).cast("string")), DATE_PATTERNS))


def is_valid_date(col) -> Column:
    return F.coalesce(parse_date(col).isNotNull(), F.lit(False))


def to_utc_timestamp_multi(col, source_zone: str = "UTC") -> Column:
    """Wall-clock text in ``source_zone`` to a UTC timestamp.

    Datetime patterns first, then date patterns at start of day. Values that
    are already timestamps (typed sources) pass through unchanged. Requires
    the session time zone to be UTC (set by ``get_session``).
    """
    c = _c(col)
    s = trim_ws(c.cast("string"))
    local = F.coalesce(_first(s, DATETIME_PATTERNS), _first(s, DATE_PATTERNS))
    in_zone = local if source_zone in ("UTC", "Z", "GMT") else F.to_utc_timestamp(local, source_zone)
    # text carrying its own offset is already absolute: no source-zone shift
    return F.coalesce(in_zone, _first(s, OFFSET_PATTERNS))


def schema_date_ok(col, date_format: str | None, iso_fallback: bool = True) -> Column:
    """Type-compatibility test for DATE columns: configured pattern, then ISO
    (if allowed or when no pattern is configured)."""
    s = _c(col).cast("string")
    tries = []
    if date_format:
        tries.append(_try_parse(s, date_format))
        if iso_fallback:
            tries.append(_try_parse(s, ISO_DATE))
    else:
        tries.append(_try_parse(s, ISO_DATE))
    return F.coalesce(*tries).isNotNull()


def utc_date(col, typed: bool = False) -> Column:
    """DATE in UTC of a timestamp, date or ISO text value; ``typed`` where it is known to be no text."""
    c = _c(col)
    if typed:
        return F.to_date(c)
    return F.coalesce(F.to_date(_try_parse(c.cast("string"), ISO_DATE)), F.to_date(c.try_cast("timestamp")))


def whole_years_between(start_date, end_date) -> Column:
    """Whole years from ``start_date`` to ``end_date``, truncated toward zero."""
    return F.floor(F.months_between(_c(end_date), _c(start_date)) / 12).cast("long")


def in_allowed_windows(ts_col, windows: Sequence[dict], zone: str = "UTC") -> Column:
    """Allowed-execution-window predicate on a UTC timestamp column.

    Each window is ``{"start": "HH:mm", "end": "HH:mm", "days": [...]}``;
    empty ``days`` means every day. No windows means always allowed. A
    window whose end is before its start (crossing midnight) never matches.
    """
    if not windows:
        return F.lit(True)
    ts = _c(ts_col).cast("timestamp")
    local = F.from_utc_timestamp(ts, zone) if zone not in ("UTC", "Z") else ts
    micro_of_day = F.unix_micros(local) - F.unix_micros(F.date_trunc("day", local))
    day_name = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.dayofweek(local))
    conds = []
    for w in windows:
        sh, sm = (int(x) for x in w["start"].split(":"))
        eh, em = (int(x) for x in w["end"].split(":"))
        start_us, end_us = (sh * 60 + sm) * 60_000_000, (eh * 60 + em) * 60_000_000
        cond = (micro_of_day >= start_us) & (micro_of_day <= end_us)
        days = [d.upper() for d in (w.get("days") or [])]
        if days:
            cond = cond & day_name.isin(days)
        conds.append(cond)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out
