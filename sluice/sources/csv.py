"""CSV scan with null tokens, header mapping and source row numbers.

The format is read from the source configuration once (``CsvFormat``). Files
are read as lines by splittable scans; row numbers are physical line numbers
(header = line 1), found from per-split line counts without a global sort. A
quoted cell may hold line breaks: whether a line ends inside a quoted cell
depends on how it began, so a line is a function of that one bit. Every split
composes its lines' functions, a scan over the small table of splits fixes the
bit at each split's start, and only the lines at which the bit changes say
where records open and close. Records over several lines are joined, also
where they span splits; all other lines stay where they were read, and a source
without such lines needs none of this. A quote within an unquoted cell
(``5" pipe``) is text. A quote that never closes is an error, as a reader of
the whole file would report it.

UTF-8 and all one-byte encodings that extend ASCII are read this way. Other
encodings go through Spark's multi-line reader, a task per file, and are
numbered by record.

Nothing is cut: rows longer than the header keep their cells as
``column_N``, the width being the longest record of all files, and a file
whose header differs from the others' is an error.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import strategy
from sluice.plans.config import SourceConfig

MAPPING_PREFIX = "headerMapping."
# Cells that mean null unless the source names its own.
NULL_TOKENS = ("", "NULL", "null", "N/A", "-")


class HeaderMismatch(ValueError):
    """Files of one source have different headers."""


class UnclosedQuote(ValueError):
    """A quoted cell does not end before its file does."""


@dataclass(frozen=True)
class CsvFormat:
    """Typed view of a source's CSV settings."""

    separator: str = ","
    quote: str = '"'
    escape: str = '"'
    encoding: str = "UTF-8"
    header: bool = True
    tokens: tuple[str, ...] = NULL_TOKENS
    renames: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, cfg: SourceConfig) -> CsvFormat:
        props = {k: v for k, v in cfg.properties.items() if v is not None and str(v).strip()}
        quote = (props.get("quoteChar") or cfg.quote_char or '"')[0]
        listed = props.get("nullValues")
        return cls(
            separator=cfg.delimiter or ",",
            quote=quote,
            escape=props.get("escapeChar", quote),
            encoding=cfg.encoding or "UTF-8",
            header=cfg.has_header,
            tokens=NULL_TOKENS if listed is None else tuple(dict.fromkeys(t.strip() for t in listed.split(","))),
            renames=renames_of(props),
        )

    @property
    def is_utf8(self) -> bool:
        return self.encoding.replace("-", "").upper() in ("UTF8", "USASCII", "ASCII")

    def options(self) -> dict[str, str]:
        return {"sep": self.separator, "quote": self.quote, "escape": self.escape}

    def names(self, header: list[str | None], width: int = 0) -> list[str]:
        """Column names of a header row, ``column_N`` for blank or missing ones."""
        cells = [*header, *[None] * (width - len(header))]
        plain = [(c or "").strip() or f"column_{i}" for i, c in enumerate(cells, 1)]
        return [self.renames.get(n, n) for n in plain]

    def cell(self, col: Column) -> Column:
        return text.null_tokens(col, self.tokens, case_sensitive=True)


def renames_of(props: dict) -> dict[str, str]:
    """``headerMapping.<source name>`` properties as source name to column name."""
    pairs = ((k.removeprefix(MAPPING_PREFIX), v) for k, v in props.items() if k.startswith(MAPPING_PREFIX))
    return {k: v for k, v in pairs if k.strip() and v and v.strip()}


def _one_byte(encoding: str) -> str | None:
    """The characters of bytes 128 to 255 in a one-byte encoding that extends ASCII; None for any other encoding."""
    try:
        name = codecs.lookup(encoding).name
        chars = bytes(range(256)).decode(name, "replace")
    except (LookupError, UnicodeError):
        return None
    if len(chars) != 256 or chars[:128] != "".join(map(chr, range(128))):
        return None
    return chars[128:]


def _text_lines(spark: SparkSession, path: str | list[str], fmt: CsvFormat) -> DataFrame:
    """Lines of all files with ``_file``, ``_blk`` (start of the split) and ``_mid`` (order within it)."""
    value = F.col("value")
    if not fmt.is_utf8:
        # the scan keeps a line's bytes; as Latin-1 every byte is the character of its number
        latin = "".join(map(chr, range(128, 256)))
        value = F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), latin, _one_byte(fmt.encoding))
    return spark.read.text(path).select(
        value.alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
    )


@dataclass(frozen=True)
class Quoting:
    """Whether a line that begins outside or inside a quoted cell ends inside one."""

    opens: Column
    stays: Column
    holds: Column

    @classmethod
    def of(cls, line: Column, fmt: CsvFormat) -> Quoting:
        q, s = re.escape(fmt.quote), re.escape(fmt.separator)
        if fmt.escape == fmt.quote:
            inside = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
        else:
            e = re.escape(fmt.escape)
            inside = f"[^{q}{e}]*+(?:{e}(?s:.)?+[^{q}{e}]*+)*+"
        rest = f"[^{s}]*+" if len(fmt.separator) == 1 else f"(?:(?!{s}).)*+"
        # possessive all through: cells are matched in one pass, however many a line has
        cells = f"(?:(?:{q}{inside}{q}{rest}|(?!{q}){rest}){s})*+"
        holds = line.contains(fmt.quote)
        opens = line.rlike(f"^{cells}{q}{inside}$")
        stays = line.rlike(f"^{inside}$") | line.rlike(f"^{inside}{q}{rest}{s}{cells}{q}{inside}$")
        return cls(holds & opens, ~holds | stays, holds)


def _splits(lines: DataFrame, fmt: CsvFormat) -> DataFrame:
    """Per split: lines before it in its file, its first line's place, and counts of opening lines and separators."""
    width = len(fmt.separator)
    cells = (F.length("value") - F.length(F.replace("value", F.lit(fmt.separator), F.lit("")))) / width + 1
    counted = lines.groupBy("_file", "_blk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_mid").alias("_first"),
        F.count_if(Quoting.of(F.col("value"), fmt).opens).alias("_opens"),
        F.max(cells).cast("int").alias("_cells"),
    )
    w = Window.partitionBy("_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def line_numbers(lines: DataFrame, splits: DataFrame, small: bool) -> DataFrame:
    """Exact 1-based ``_line`` for every line of a scan, distributed (no global sort, no single-task window)."""
    joined = lines.join(strategy.hint_broadcast(splits.select("_file", "_blk", "_first", "_offset"), small), ["_file", "_blk"])
    return joined.select("value", "_file", "_blk", "_mid", (F.col("_offset") + (F.col("_mid") - F.col("_first")) + 1).alias("_line"))


def _latest(column: Column, order: Window) -> Column:
    return F.last(column, ignorenulls=True).over(order)


def _composed(df: DataFrame, order: Window, name: str) -> DataFrame:
    """Compose functions of one bit in order. A row's ``_opens, _stays`` are the function's values for 0 and 1; the
    composition of all up to and with the row is ``{name}_fixed`` (a constant) and ``{name}_bit`` (the constant, or
    whether the bit is turned)."""
    constant = F.col("_opens") == F.col("_stays")
    turns = F.sum(F.when(F.col("_opens") & ~F.col("_stays"), 1).otherwise(0)).over(order)
    out = df.withColumns({"_turns": turns, "_const": F.when(constant, F.col("_opens").cast("int"))})
    out = out.withColumns({"_base": _latest(F.col("_const"), order),
                           "_since": _latest(F.when(constant, F.col("_turns")), order)})
    parity = F.coalesce("_base", F.lit(0)) + F.col("_turns") - F.coalesce("_since", F.lit(0))
    return out.withColumns({f"{name}_fixed": F.col("_base").isNotNull(), f"{name}_bit": parity % 2 == 1}) \
        .drop("_turns", "_const", "_base", "_since")


def broken_records(numbered: DataFrame, fmt: CsvFormat) -> DataFrame:
    """``_file, _open, _close`` of every record over several lines.

    Only lines with a quote can change the bit; of those, the place and two
    bits go through one exchange by split. The splits' own functions are
    composed per file, a row per split.
    """
    quoting = Quoting.of(F.col("value"), fmt)
    marks = numbered.where(quoting.holds).select(
        "_file", "_blk", "_line", quoting.opens.alias("_opens"), quoting.stays.alias("_stays"))
    within = Window.partitionBy("_file", "_blk").orderBy("_line")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = strategy.materialize(_composed(marks, upto, "_l").withColumn(
        "_is_last", F.lead("_line").over(within).isNull()))
    # the function of a split is that of its last line
    ends = lines.where("_is_last").select(
        "_file", "_blk", F.col("_l_bit").alias("_opens"), F.when(F.col("_l_fixed"), F.col("_l_bit")).otherwise(~F.col("_l_bit")).alias("_stays"))
    by_file = Window.partitionBy("_file").orderBy("_blk")
    whole = _composed(ends, by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow), "_s")
    # files begin outside of a cell, so the bit after a split is its composition's bit
    starts = whole.select("_file", "_blk", F.coalesce(F.lag("_s_bit").over(by_file), F.lit(False)).alias("_start"))
    starts, small = strategy.small_or_none(starts)
    known = lines.join(strategy.hint_broadcast(starts, small), ["_file", "_blk"])
    after = known.withColumn("_after", F.when(F.col("_l_fixed"), F.col("_l_bit")).otherwise(F.col("_start") != F.col("_l_bit")))
    turned = after.withColumn("_before", F.coalesce(F.lag("_after").over(within), F.col("_start"))).where("_before <> _after")
    # changes alternate between opening and closing: the n-th of a file belongs to record (n + 1) / 2
    changes = strategy.materialize(turned.select("_file", "_blk", "_line", F.row_number().over(within).alias("_n")))
    earlier = changes.groupBy("_file", "_blk").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_prior", F.coalesce(F.sum("_c").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier, small = strategy.small_or_none(earlier.drop("_c"))
    ranked = changes.join(strategy.hint_broadcast(earlier, small), ["_file", "_blk"])
    pair = F.floor((F.col("_n") + F.col("_prior") - 1) / 2)
    spans = strategy.materialize(ranked.groupBy("_file", pair.alias("_pair")).agg(
        F.min("_line").alias("_open"), F.max("_line").alias("_close"), F.count(F.lit(1)).alias("_ends")))
    unclosed = spans.where("_ends = 1").orderBy("_file").limit(1).collect()
    if unclosed:
        raise UnclosedQuote(f"quoted cell opened in line {unclosed[0]['_open']} of {unclosed[0]['_file']} is not closed")
    return spans.select("_file", "_open", "_close")


def joined_records(numbered: DataFrame, spans: DataFrame) -> DataFrame:
    """``value, _file, _line`` per record: lines of one record joined by line feeds, under its first line's number."""
    members = spans.select("_file", F.explode(F.sequence("_open", "_close")).alias("_line"), F.col("_open").alias("_record"))
    members, small = strategy.small_or_none(members)
    told = numbered.join(strategy.hint_broadcast(members, small), ["_file", "_line"], "left")
    single = told.where(F.col("_record").isNull()).select("value", "_file", "_line")
    pieces = told.where(F.col("_record").isNotNull()).groupBy("_file", F.col("_record").alias("_line")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_line").alias("at"), "value"))).alias("_pieces"))
    whole = pieces.select(F.array_join(F.col("_pieces.value"), "\n").alias("value"), "_file", "_line")
    return single.unionByName(whole)


def _positions(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def _cut(lines: DataFrame, fmt: CsvFormat) -> tuple[DataFrame, int]:
    """Records of a frame of lines, and the most cells that one of them can have (its separators and one)."""
    splits, small = strategy.small_or_none(_splits(lines, fmt))
    told = splits.agg(F.sum("_opens").alias("opens"), F.max("_cells").alias("cells")).first()
    records = line_numbers(lines, splits, small)
    if not told["opens"]:
        return records, told["cells"] or 0
    records = joined_records(records, broken_records(records, fmt))
    separators = F.length("value") - F.length(F.replace("value", F.lit(fmt.separator), F.lit("")))
    return records, records.agg(F.max(separators / len(fmt.separator) + 1).cast("int")).first()[0] or 0


def _records_by_line(spark: SparkSession, path: str | list[str], fmt: CsvFormat, least: int) -> tuple[DataFrame, int]:
    """Cells ``c0..`` per record with ``_row`` (number of its first line) and ``_source``, and how many cells."""
    records, bound = _cut(_text_lines(spark, path, fmt), fmt)
    bound = max(bound, least)
    ddl = ", ".join(f"{p} STRING" for p in _positions(bound))
    parsed = records.select(F.from_csv("value", F.lit(ddl), fmt.options()).alias("r"), "_file", "_line")
    return parsed.select(
        *[F.col(f"r.{p}").alias(p) for p in _positions(bound)],
        F.col("_line").cast("long").alias("_row"),
        F.col("_file").alias("_source"),
    ), bound


def _records_by_file(spark: SparkSession, path: str | list[str], fmt: CsvFormat, least: int) -> tuple[DataFrame, int]:
    """The same for encodings that lines cannot be cut in; ``_row`` is the record's number in its file."""
    options = {**fmt.options(), "encoding": fmt.encoding, "header": "false", "multiLine": "true", "mode": "PERMISSIVE"}
    # once as lines, a cell each, for the width; blank lines are skipped, which have no separators
    lines = spark.read.options(**{**options, "sep": "\u0001", "quote": ""}).schema("value STRING").csv(path)
    _, bound = _cut(lines.where(F.col("value").isNotNull()).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid")), fmt)
    bound = max(bound, least)
    schema = ", ".join(f"{p} STRING" for p in _positions(bound))
    df = spark.read.options(**options).schema(schema).csv(path)
    tagged = df.select("*", F.col("_metadata.file_path").alias("_source"), F.monotonically_increasing_id().alias("_mid"))
    # a file is one split, so its records are numbered in order from its first
    firsts = tagged.groupBy(F.col("_source").alias("_file")).agg(F.min("_mid").alias("_first"))
    firsts, small = strategy.small_or_none(firsts)
    numbered = tagged.join(strategy.hint_broadcast(firsts, small), F.col("_source") == F.col("_file"))
    return numbered.select(*_positions(bound), (F.col("_mid") - F.col("_first") + 1).alias("_row"), "_source"), bound


def _header(records: DataFrame, width: int) -> list[str | None]:
    """The one header of all files; they must agree."""
    rows = records.where(F.col("_row") == 1).select(*_positions(width)).distinct().limit(2).collect()
    if len(rows) > 1:
        raise HeaderMismatch(f"files with different headers: {[list(filter(None, r)) for r in rows]}")
    cells = list(rows[0]) if rows else []
    while cells and cells[-1] is None:
        cells.pop()
    return cells


def _longest(records: DataFrame, width: int, known: int) -> int:
    """Cells of the longest row, counting from the last one that is not empty."""
    if width <= known:
        return known
    reach = F.greatest(F.lit(known), *[F.when(F.col(p).isNotNull(), F.lit(i + 1)) for i, p in enumerate(_positions(width)) if i >= known], F.lit(known))
    return records.agg(F.max(reach)).first()[0] or known


def read_csv(spark: SparkSession, path: str | list[str], cfg: SourceConfig, extracted_at=None, width: int | None = None) -> DataFrame:
    """All-string CSV frame with ``_row``, ``_source`` and ``_extracted_at``.

    Short rows are padded with nulls; ``width`` asks for at least so many
    columns.
    """
    fmt = CsvFormat.of(cfg)
    lined = fmt.is_utf8 or _one_byte(fmt.encoding) is not None
    records, bound = (_records_by_line if lined else _records_by_file)(spark, path, fmt, max(width or 0, 1))
    header = _header(records, bound) if fmt.header else []
    if fmt.header:
        records = records.where(F.col("_row") > 1)
    n = max(_longest(records, bound, len(header)), width or 0)
    names = fmt.names(header, n)
    cells = [fmt.cell(F.col(p)).alias(name) for p, name in zip(_positions(n), names)]
    df = drop_empty_rows(records.select(*cells, "_row", "_source"), names)
    at = F.lit(extracted_at).cast("timestamp") if extracted_at is not None else F.current_timestamp()
    return df.withColumn("_extracted_at", at)


def drop_empty_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop rows whose every cell is null (row numbers keep advancing)."""
    if not names:
        return df
    return df.filter(F.coalesce(*[F.col(f"`{c}`") for c in names]).isNotNull())


def preview(df: DataFrame, n: int = 10) -> tuple[list[str], int]:
    """First ``n`` rows as JSON strings plus the total row count."""
    data_cols = [c for c in df.columns if not c.startswith("_")]
    rows = [r[0] for r in df.orderBy("_row").select(F.to_json(F.struct(*data_cols))).limit(n).collect()] \
        if "_row" in df.columns else [r[0] for r in df.select(F.to_json(F.struct(*data_cols))).limit(n).collect()]
    return rows, df.count()
