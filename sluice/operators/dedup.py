"""Duplicate business keys: keep-first, reject-all and consolidation.

A hash count per key (combined before the shuffle) finds the repeated keys.
Where they are measured small, only their rows are ordered, to find each
key's first row, and the flags come back by a broadcast join on the key: rows
never move. Where they are many, the rows move once, to a window over the
key. A key that holds a third of all rows would put that third into one task:
the rows of keys beyond ``HOT_ROWS`` take the broadcast path, and rows that
are not eligible are spread. The per-key side of a join holds one row per
key, so a row is never multiplied, whatever its identity columns hold. Rows
that lie by columns that the key determines (``near``) need no count and do
not move: the window stands on them as they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import strategy

# rows of one key that a window may hold; no more than one key in so many rows is beyond it
HOT_ROWS = 200_000


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Unique id for rows of a deterministic input (a file scan or a
    materialised table). Not stable after a shuffle: materialise first."""
    return df.withColumn(name, F.monotonically_increasing_id())


def duplicate_flags(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str | Sequence[str] = "_row",
    order_cols: Sequence[str] | None = None,
    reject_all: bool = False,
    flag: str = "_dup",
    where: Column | None = None,
    near: Sequence[str] = (),
) -> DataFrame:
    """Add boolean ``flag``: True for rows rejected as duplicate keys.

    ``row_id`` names the column or columns that tell rows apart: the source
    row number for one source, ``("_source", "_row")`` where several sources
    number their rows alike, or ``with_row_id`` on a scan. "First" is the
    smallest ``(order_cols..., row_id...)``; ``order_cols`` defaults to none.
    keep-first flags every row of a repeated key but the first; reject-all
    flags every row of a repeated key. Null key values group together.
    ``where`` limits the check to eligible rows (others are never flagged).
    ``near`` names columns in which eligible rows of one key agree, and by
    which the rows are dealt out already, none of their values holding very
    many.
    """
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    order = [*(order_cols or []), *[c for c in ids if c not in (order_cols or [])]]
    if where is None:
        eligible = F.lit(True)
    else:
        # a column, not a filter: a pushed-down filter would inline every
        # upstream expression it depends on into the scan-side predicate
        df = df.withColumn("_elig", F.coalesce(where, F.lit(False)))
        eligible = F.col("_elig")
    key_cols = [F.col(f"`{k}`") for k in keys]
    if near:
        return _window_flags(df, keys, order, eligible, reject_all, flag, near)
    place = F.struct(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)])
    counts = df.groupBy(*key_cols).agg(F.count_if(eligible).alias("_cnt")).filter(F.col("_cnt") > 1)
    repeated, small = strategy.small_or_none(counts)
    if small:
        return _joined_flags(df, keys, repeated, place, eligible, reject_all, flag)
    hot = repeated.filter(F.col("_cnt") > HOT_ROWS)
    if hot.isEmpty():
        return _window_flags(df, keys, order, eligible, reject_all, flag)
    h, cond = strategy.null_safe_on(df, hot.drop("_cnt"), keys)
    crowded = df.join(F.broadcast(h), cond, "left_semi")
    others = df.join(F.broadcast(h), cond, "left_anti")
    return _joined_flags(crowded, keys, hot, place, eligible, reject_all, flag).unionByName(
        _window_flags(others, keys, order, eligible, reject_all, flag))


def crowded(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether more than ``HOT_ROWS`` rows agree in the columns, or a row has none."""
    hot = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_cnt"))
    none = F.coalesce(*[F.when(F.col(f"`{c}`").isNull(), F.lit(True)) for c in columns], F.lit(False))
    found = not hot.filter((F.col("_cnt") > HOT_ROWS) | none).isEmpty()
    del hot
    strategy.release(df.sparkSession)
    return found


def _window_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str], eligible: Column, reject_all: bool,
                  flag: str, near: Sequence[str] = ()) -> DataFrame:
    """The flags by one window over the key. Rows that are not eligible go anywhere, not to their key."""
    apart = F.when(~eligible, F.xxhash64(*[F.col(f"`{c}`") for c in order]))
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in (*near, *keys)], apart)
    if reject_all:
        is_dup = F.count(F.lit(1)).over(window) > 1
    else:
        is_dup = F.rank().over(window.orderBy(*[F.col(f"`{c}`") for c in order])) > 1
    return df.withColumn(flag, eligible & is_dup).drop("_elig")


def _joined_flags(df: DataFrame, keys: Sequence[str], repeated: DataFrame, place: Column, eligible: Column,
                  reject_all: bool, flag: str) -> DataFrame:
    """The flags by broadcasts of the few repeated keys and of the first place of each."""
    key_cols = [F.col(f"`{k}`") for k in keys]
    if reject_all:
        firsts = repeated.withColumn("_first", F.lit(None).cast("boolean"))
    else:
        r, cond = strategy.null_safe_on(df, repeated, keys)
        rows = df.join(F.broadcast(r), cond, "left_semi").filter(eligible)
        firsts = strategy.materialize(rows.groupBy(*key_cols).agg(F.min(place).alias("_first")))
        firsts = firsts.withColumn("_cnt", F.lit(2))
    f, cond = strategy.null_safe_on(df, firsts, keys)
    joined = df.join(F.broadcast(f), cond, "left")
    hit = eligible & F.col("_cnt").isNotNull()
    is_dup = hit if reject_all else hit & ~place.eqNullSafe(F.col("_first"))
    return joined.withColumn(flag, F.coalesce(is_dup, F.lit(False))).drop(
        "_cnt", "_first", "_elig", *[f"_r_{k}" for k in keys]
    )


def keep_first(df: DataFrame, keys: Sequence[str], row_id: str = "_row", order_cols=None) -> DataFrame:
    return duplicate_flags(df, keys, row_id, order_cols, reject_all=False)


def reject_all(df: DataFrame, keys: Sequence[str], row_id: str = "_row", order_cols=None) -> DataFrame:
    return duplicate_flags(df, keys, row_id, order_cols, reject_all=True)


def _descending(df: DataFrame, column: str) -> Column:
    """A value that falls as the column rises, for a date, time or number."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.NumericType):
        return -c
    raise ValueError(f"the latest row cannot be told by {column} of type {kind.simpleString()}")


def consolidate_latest(
    df: DataFrame,
    keys: Sequence[str],
    sum_cols: Sequence[str],
    latest_by: str,
    latest_cols: Sequence[str],
    order_cols: Sequence[str] = ("_row",),
    count_col: str | None = "_merged_rows",
) -> DataFrame:
    """One row per key: ``sum_cols`` summed; ``latest_by`` and
    ``latest_cols`` taken from the row with the greatest ``latest_by`` (a
    strictly later value wins, so ties keep the earliest row by
    ``order_cols``); every other column from the key's first row. A null
    ``latest_by`` never beats a non-null one. One aggregate, combined on the
    map side, so hot keys are reduced before the shuffle; its buffers hold
    whole rows, so Spark sorts by key instead of hashing.
    """
    fixed = set(keys) | set(sum_cols) | set(latest_cols) | {latest_by}
    other = [c for c in df.columns if c not in fixed]
    latest_struct = F.struct(*[F.col(f"`{c}`").alias(c) for c in [latest_by, *latest_cols]])
    rank = F.struct(
        F.col(f"`{latest_by}`").isNull().alias("_none"),
        _descending(df, latest_by).alias("_t"),
        *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(order_cols)],
    )
    first_order = F.struct(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order_cols)])
    aggs = [F.sum(F.col(f"`{c}`")).alias(c) for c in sum_cols]
    aggs.append(F.min_by(latest_struct, rank).alias("_latest"))
    if other:
        aggs.append(F.min_by(F.struct(*[F.col(f"`{c}`").alias(c) for c in other]), first_order).alias("_firstrow"))
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    g = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)
    cols = [F.col(f"`{k}`") for k in keys]
    cols += [F.col(f"_firstrow.`{c}`").alias(c) for c in other]
    cols += [F.col(f"`{c}`") for c in sum_cols]
    cols += [F.col(f"_latest.`{c}`").alias(c) for c in [latest_by, *latest_cols]]
    if count_col:
        cols.append(F.col(count_col))
    return g.select(*cols)
