"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes,
digit cues (two digits in a row or around one separator, a plus before a
digit) and identifier words. Around each anchor a small deterministic parser
walks outwards to the boundary of the value and validates it (label
structure, octet range, Luhn, IBAN check digits, digit counts). Text without
anchors costs the automaton pass only.

Kinds, in the order of the span string: ``email ip card phone`` (the base
kinds), then ``url iban account address``. Base spans are exactly the
leftmost non-overlapping matches of the base patterns that validate; the
other kinds add spans and never remove base ones. Positions are code points,
ends exclusive.

Defined results: a null or empty text has no spans; very long texts are read
whole; repeated rows give the same spans; empty tables give empty tables;
extra columns pass through and clashing ones are replaced.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "address")

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE_INNER = DIGITS | frozenset(" ().-")
URL_STOP = frozenset(string.whitespace + "<>\"'`{}|\\^")
# Schemes, identifier cues and street words looked for.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "routing", "tax id", "licence no")
STREET_WORDS = ("street", "avenue", "road", "lane", "boulevard", "drive", "square", "straße", "strasse", "calle", "rue")
# street words that are written in one word with the name, and those that a name can follow
JOINED = ("straße", "strasse")
NAME_AFTER = ("calle", "rue", "avenue", "boulevard", "square")
JOINING = frozenset(
    "of the on upon in and at de la le les du des el los las del y et en sur sous au aux à der dem den von vom zu zur "
    "zum am an im".split()
)
HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?(?:[-/][0-9]{1,4}[A-Za-z]?)?")
HOUSE_AFTER = re.compile(
    r",? (?:(?:n[º°]|n[or]\.|núm\.|número|nummer) ?)?[0-9]{1,4}[a-z]?(?:[-/][0-9]{1,4}[a-z]?)?(?!\w|[.,:][0-9])", re.I
)
ORDINAL = re.compile(r"[0-9]+(?:st|nd|rd|th)", re.I)
WORD = re.compile(r" ([^\W_]+(?:['’-][^\W_]+)*)")
DIGIT = re.compile(r"[0-9]")
LINE_END = re.compile(r"\n")
SENTENCE_END = re.compile(r"[.!?](?=\s|$)(?!\s+[0-9])")
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Anchor patterns over lower-cased ASCII letters; the value is (anchor type, pattern length)."""
    auto = ahocorasick.Automaton()
    auto.add_word("@", ("at", 1))
    for a in string.digits:
        auto.add_word("+" + a, ("plus", 2))
        for b in string.digits:
            auto.add_word(a + b, ("digits", 2))
            for sep in " -":
                auto.add_word(a + sep + b, ("digits", 3))
            auto.add_word(a + "." + b, ("dotted", 3))
    for scheme in SCHEMES:
        auto.add_word(scheme, ("scheme", len(scheme)))
    for cue in ACCOUNT_CUES:
        auto.add_word(cue, ("cue", len(cue)))
    for word in STREET_WORDS:
        auto.add_word(word, ("street", len(word)))
    for country in IBAN_LENGTHS:
        for digit in string.digits:
            auto.add_word(country.lower() + digit, ("iban", 3))
    auto.make_automaton()
    return auto


def _folded(text: str) -> str:
    """Lower case with one character for each, so that positions stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    free = dict.fromkeys(KINDS, 0)  # per kind, where the next match may start
    found: list[tuple[str, int, int]] = []
    digit, line, sentence = _next(DIGIT, text), _next(LINE_END, text), _next(SENTENCE_END, text)
    wall = [-1]  # the last street word from which no house number was found leftwards

    def add(kind: str, span: tuple[int, int] | None, valid: bool = True) -> None:
        """Record a validated span. A match that fails validation still takes its text, as a scan would."""
        if span is None:
            return
        free[kind] = span[1]
        if valid:
            found.append((kind, *span))

    for end, (anchor, length) in _automaton().iter(_folded(text)):
        start = end + 1 - length
        if anchor == "at":
            add("email", _email(text, start, free["email"]))
        elif anchor == "plus":
            if start >= free["phone"]:
                span = _phone(text, start)
                add("phone", span, span is not None and 8 <= _count_digits(text, *span) <= 15)
        elif anchor == "digits":
            if start >= free["card"]:
                span = _card(text, start)
                add("card", span, _is_card(text, span))
        elif anchor == "dotted":
            if start >= free["ip"]:
                for span in _ips(text, start):
                    add("ip", span, all(int(p) <= 255 for p in _short(text[span[0] : span[1]].split("."))))
                free["ip"] = max(free["ip"], end)
        elif anchor == "scheme":
            if start >= free["url"]:
                add("url", _url(text, start, length))
        elif anchor == "iban":
            if start >= free["iban"]:
                add("iban", _iban(text, start))
        elif anchor == "cue":
            if start >= free["account"]:
                add("account", _account(text, start, length, free["account"], digit, line, sentence))
        elif anchor == "street":
            if start >= free["address"]:
                add("address", _address(text, start, length, free["address"], wall))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (rank[s[0]], s[1]))


def _next(pattern: re.Pattern, text: str) -> Callable[[int], int]:
    """Place of the first match at or after a place; asked in order, all calls read the text once."""
    last = -1

    def find(at: int) -> int:
        nonlocal last
        if last < at:
            m = pattern.search(text, at)
            last = m.start() if m else len(text)
        return last

    return find


def _run(text: str, at: int, chars: frozenset, limit: int | None = None) -> int:
    """End of the run of ``chars`` that starts at ``at``."""
    n = len(text) if limit is None else limit
    while at < n and text[at] in chars:
        at += 1
    return at


def _back(text: str, at: int, chars: frozenset, floor: int) -> int:
    """Start of the run of ``chars`` that ends before ``at``."""
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part leftwards, dotted labels rightwards; two labels at least."""
    if at < floor:
        return None
    start = _back(text, at, LOCAL, floor)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        following = _run(text, end + 1, LABEL)
        if following == end + 1:
            break
        labels, end = labels + 1, following
    return (start, end) if labels >= 2 else None


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """Plus, a digit, then digits and punctuation up to the last digit of the run; one inner character at least."""
    end = _back(text, _run(text, at + 2, PHONE_INNER), PHONE_INNER - DIGITS, at + 2)
    return (at, end) if end >= at + 4 else None


def _count_digits(text: str, start: int, end: int) -> int:
    return sum(c in DIGITS for c in text[start:end])


def _card(text: str, at: int) -> tuple[int, int]:
    """The chain of digits with at most one space or hyphen between neighbours; its first digit is at the anchor."""
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return at, end


def _is_card(text: str, span: tuple[int, int]) -> bool:
    digits = [int(c) for c in text[span[0] : span[1]] if c in DIGITS]
    if not 16 <= len(digits) <= 19:
        return False
    doubled = [d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _ips(text: str, at: int) -> Iterator[tuple[int, int]]:
    """The dotted chain around the anchor, cut into fours from its left end."""
    start = _back(text, at + 1, DIGITS, 0)
    parts, end = [start], _run(text, start, DIGITS)
    ends = [end]
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        parts.append(end + 1)
        end = _run(text, end + 1, DIGITS)
        ends.append(end)
    for i in range(0, len(parts) - 3, 4):
        yield parts[i], ends[i + 3]
    if len(parts) % 4:
        # the rest of the chain is used up: nothing of it can start a match
        return


def _short(parts: list[str]) -> list[str]:
    """Octets without leading zeros, cut to four digits: enough to tell whether they exceed 255."""
    return [p.lstrip("0")[:4] or "0" for p in parts]


def _url(text: str, at: int, length: int) -> tuple[int, int] | None:
    """Scheme to the next white space, bracket or quote, without closing punctuation."""
    if at and text[at - 1] in ALNUM:
        return None
    n = len(text)
    end = at + length
    while end < n and text[end] not in URL_STOP and not text[end].isspace():
        end += 1
    while end > at + length and text[end - 1] in ".,;:!?)]*#$%&":
        end -= 1
    return (at, end) if end > at + length else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """Country code, two check digits and groups of four, to the country's length; ISO 7064 mod 97 must hold."""
    want, got, end, n = IBAN_LENGTHS.get(text[at : at + 2]), [], at, len(text)
    if want is None or (at and text[at - 1] in ALNUM):
        return None
    while end < n and len(got) < want:
        if text[end] in ALNUM:
            got.append(text[end])
        elif text[end] != " " or not got:
            break
        end += 1
    if len(got) != want or (end < n and text[end] in ALNUM):
        return None
    moved = "".join(got[4:] + got[:4]).upper()
    return (at, end) if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else None


def _account(
    text: str,
    at: int,
    length: int,
    floor: int,
    digit: Callable[[int], int],
    line: Callable[[int], int],
    sentence: Callable[[int], int],
) -> tuple[int, int] | None:
    """An identifier of 6 to 34 letters and digits, 5 digits at least, after its cue in the same sentence.

    A dot within 24 characters may belong to an abbreviation and ends nothing; a line's end always does.
    """
    if at and text[at - 1].isalnum():
        return None
    end = at + length
    if end < len(text) and text[end].isalnum():
        return None
    start = digit(end)
    if start >= min(len(text), line(end), max(sentence(end), end + 24)):
        return None
    start = _back(text, start, ALNUM, max(end, floor))
    last = _back(text, _run(text, start, LABEL), frozenset("-"), start)
    value = text[start:last]
    enough = sum(c in DIGITS for c in value) >= 5 and 6 <= sum(c in ALNUM for c in value) <= 34
    return (start, last) if enough else None


def _address(text: str, at: int, length: int, floor: int, wall: list[int]) -> tuple[int, int] | None:
    """House number, name and street word in the order of their language, with an optional postcode after them.

    The forms are ``12 Baker Street``, ``Hauptstraße 12``, ``Calle Mayor 5`` and ``12 rue de la Paix``. Names are
    capitalised words and lower-case joining words, one space apart, so no name leaves its line or sentence.
    """
    end = at + length
    if end < len(text) and text[end].isalnum():
        return None
    cue, start = text[at:end].lower(), at
    if cue in JOINED:
        while start > max(floor, wall[0] + 1) and (text[start - 1].isalpha() or text[start - 1] == "-"):
            start -= 1
        if start == wall[0] + 1 > floor and start > 0:
            wall[0] = at  # a chain of street words
            return None
    if start > floor and text[start - 1].isalnum():
        return None
    span = None
    if cue in JOINED:
        span = _number_after(text, start, at, end, floor)
    elif cue in NAME_AFTER:
        span = _name_after(text, at, end, floor, cue)
    return span or _number_before(text, start, at, end, floor, wall)


def _word_before(text: str, at: int, floor: int) -> int:
    """Start of the word that ends at ``at``."""
    while at > floor and (text[at - 1].isalnum() or text[at - 1] in "-'’"):
        at -= 1
    return at


def _number_before(text: str, start: int, at: int, end: int, floor: int, wall: list[int]) -> tuple[int, int] | None:
    """House number, name, street word: leftwards from the street word to the number."""
    named = start < at or text[at].isupper()
    # a walk that reaches an earlier street word would end as that one's did
    while start > max(floor, wall[0]) and text[start - 1] == " ":
        word = _word_before(text, start - 1, floor)
        token = text[word : start - 1]
        if HOUSE.fullmatch(token):
            if named and (word == 0 or text[word - 1].isspace() or text[word - 1] == "("):
                return word, _postcode(text, end)
            break
        named = token[:1].isupper() or ORDINAL.fullmatch(token) is not None
        if not named and token not in JOINING:
            break
        start = word
    wall[0] = at
    return None


def _number_after(text: str, start: int, at: int, end: int, floor: int) -> tuple[int, int] | None:
    """Name and street word in one word, or capitalised words before the street word, then the number."""
    house = HOUSE_AFTER.match(text, end)
    if house is None:
        return None
    joined = start < at
    while not joined and start > floor and text[start - 1] == " ":
        word = _word_before(text, start - 1, floor)
        if not text[word].isupper():
            break
        start = word
    return (start, _postcode(text, house.end())) if start < at else None


def _name_after(text: str, at: int, end: int, floor: int, cue: str) -> tuple[int, int] | None:
    """Street word, then the name; the number is before the street word or after the name."""
    before = at - 1 if at > floor and text[at - 1] == " " else floor
    if before > floor and text[before - 1] == ",":
        before -= 1
    word = _word_before(text, before, floor)
    if text[word:before] in ("bis", "ter") and word > floor and text[word - 1] == " ":
        before = word - 1
        word = _word_before(text, before, floor)
    token = text[word:before]
    numbered = HOUSE.fullmatch(token) and (word == 0 or text[word - 1].isspace() or text[word - 1] == "(")
    stop = here = end
    while m := WORD.match(text, here):
        bare = re.split("['’]", m[1])[-1]
        if m[1].lower() in STREET_WORDS:
            break
        if bare[:1].isupper():
            stop = m.end()
        elif m[1] not in JOINING and not (numbered and m[1].isdigit()):
            break
        here = m.end()
    if numbered:
        return (word, _postcode(text, stop)) if stop > end else None
    if cue not in ("calle", "rue") and token[:1].isupper():
        return None  # its name is before it
    house = HOUSE_AFTER.match(text, stop)
    if house and (stop > end or (cue == "calle" and text[at].isupper())):
        return at, _postcode(text, house.end())
    return None


def _postcode(text: str, at: int) -> int:
    """End of ``, <city> <4 to 6 digits>`` right after a street, else the street's own end."""
    if text[at : at + 2] != ", ":
        return at
    stop = min(len(text), at + 40)
    digit = at + 2
    while digit < stop and text[digit] not in DIGITS:
        if text[digit] in "\n.@":
            return at
        digit += 1
    end = _run(text, digit, DIGITS)
    return end if 4 <= end - digit <= 6 else at


def span_string(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def with_spans(docs: DataFrame, out: str = "pii") -> DataFrame:
    """Add an array of ``struct(kind, start, end)``, ordered by kind, then start."""

    small_batches(docs)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts])

    return docs.withColumn(out, spans(F.col("text")))


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first kind listed."""
    if not text:
        return text
    spans = find_spans(text)
    if not spans:
        return text
    merged: list[list] = []
    rank = {k: i for i, k in enumerate(KINDS)}
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
            merged[-1][0] = min(merged[-1][0], kind, key=rank.__getitem__)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """Documents with personal data replaced in ``column``; nulls stay null."""

    small_batches(docs)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact_text(t) for t in texts], dtype=object)

    return docs.withColumn(column, clean(F.col(column)))
