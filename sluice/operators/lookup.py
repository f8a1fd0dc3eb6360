"""Catalog membership and code-table lookups.

Small fixed vocabularies (config lists, code maps) are inlined as literals
(``isin`` / ``create_map``): no join at all. Table-backed catalogs are joined:
the catalog is broadcast when its size is proven under the limit (Parquet
footer row count of the scan, or a count of the materialised keys when the
plan gives no bound). Beside a large catalog the field's distinct values are
joined, which are narrow, and the few that are absent or inactive come back by
a broadcast, so no row moves. Where these are many too, they come back by the
columns that the rows are dealt out by, if there are such (``near``); else the
rows are joined by shuffle (the catalog side is unique per key, and AQE's
skew-join split handles a hot key on the data side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import strategy


def catalog_flags(
    df: DataFrame,
    field: str,
    catalog: DataFrame,
    catalog_key: str,
    active: Column | None = None,
    in_col: str | None = None,
    active_col: str | None = None,
    near: Sequence[str] = (),
) -> tuple[DataFrame, str, str | None]:
    """Left-join a catalog table and add boolean membership flags.

    Returns ``(df, in_catalog_col, active_col)``; flags are null only when
    ``field`` is null. ``active`` is a predicate on the catalog marking the
    active subset (D1: table-backed catalog with an active flag). ``near``
    names columns without nulls by which the rows are dealt out already, none
    of their values holding very many rows.
    """
    in_col = in_col or f"_in_{field}"
    act_col = (active_col or f"_active_{field}") if active is not None else None
    cat = catalog.select(
        F.col(catalog_key).alias("_cat_key"),
        (active if active is not None else F.lit(True)).alias("_cat_active"),
    ).groupBy("_cat_key").agg(F.max("_cat_active").alias("_cat_active"))
    cat, small = _checked(cat)
    if not small:
        bad, few = _unlisted(df, field, cat)
        if few:
            j = df.join(F.broadcast(bad), df[f"`{field}`"] == bad["_bad_key"], "left")
            known = F.col(f"`{field}`").isNotNull()
            j = j.withColumn(in_col, F.when(known, F.coalesce(F.col("_cat_known"), F.lit(True))))
            if act_col:
                j = j.withColumn(act_col, F.when(known, F.col("_bad_key").isNull()))
            return j.drop("_bad_key", "_cat_known"), in_col, act_col
        if near:
            j = _with_bad(df, field, bad, near)
            known, listed = F.col(f"`{field}`").isNotNull(), ~F.array_contains("_absent", F.col(f"`{field}`"))
            j = j.withColumn(in_col, F.when(known, F.coalesce(listed, F.lit(True))))
            if act_col:
                fit = ~F.array_contains("_bad", F.col(f"`{field}`"))
                j = j.withColumn(act_col, F.when(known, F.coalesce(fit, F.lit(True))))
            return j.drop("_bad", "_absent"), in_col, act_col
    # a catalog holds a key once: it is hashed, and the rows need no sort
    side = F.broadcast(cat) if small else cat.hint("shuffle_hash")
    j = df.join(side, df[f"`{field}`"] == cat["_cat_key"], "left")
    present = F.col("_cat_key").isNotNull()
    j = j.withColumn(in_col, F.when(F.col(f"`{field}`").isNotNull(), present))
    if act_col:
        j = j.withColumn(act_col, F.when(F.col(f"`{field}`").isNotNull(), present & F.coalesce(F.col("_cat_active"), F.lit(False))))
    return j.drop("_cat_key", "_cat_active"), in_col, act_col


def _unlisted(df: DataFrame, field: str, cat: DataFrame) -> tuple[DataFrame, bool]:
    """The field's values that the catalog lacks (``_cat_known`` false) or holds as inactive, and whether they are few."""
    values = df.select(F.col(f"`{field}`").alias("_bad_key")).filter("_bad_key is not null").distinct()
    joined = values.join(cat.hint("shuffle_hash"), values["_bad_key"] == cat["_cat_key"], "left")
    bad = joined.filter(~F.coalesce(F.col("_cat_active"), F.lit(False)))
    found = strategy.small_or_none(bad.select("_bad_key", F.col("_cat_key").isNotNull().alias("_cat_known")))
    del values, joined, bad
    strategy.release(df.sparkSession)
    return found


def _with_bad(df: DataFrame, field: str, bad: DataFrame, near: Sequence[str]) -> DataFrame:
    """The rows with the bad values among those that share their ``near`` columns (``_bad``) and those of them that the
    catalog lacks (``_absent``): values move, rows do not."""
    pairs = df.select(*[F.col(f"`{c}`").alias(f"_near{i}") for i, c in enumerate(near)], F.col(f"`{field}`").alias("_value"))
    pairs = pairs.distinct()
    held = pairs.join(bad, pairs["_value"] == bad["_bad_key"]).groupBy(*[f"_near{i}" for i in range(len(near))]).agg(
        F.collect_list("_value").alias("_bad"), F.collect_list(F.when(~F.col("_cat_known"), F.col("_value"))).alias("_absent"))
    held = strategy.materialize(held)
    del pairs
    strategy.release(df.sparkSession)
    cond = None
    for i, c in enumerate(near):
        same = df[f"`{c}`"] == held[f"_near{i}"]
        cond = same if cond is None else cond & same
    return df.join(held, cond, "left").drop(*[f"_near{i}" for i in range(len(near))])


def _checked(side: DataFrame) -> tuple[DataFrame, bool]:
    """Whether a side may be broadcast, by rows and by bytes.

    The footers' row count bounds its rows without a job: a side that may be
    large is not copied just to be measured, a small one is measured whole.
    """
    bound = strategy.row_bound(side)
    if bound is not None and bound > strategy.broadcast_limit(side):
        return side, False
    return strategy.small_or_none(side)


def map_literal(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_code(col: Column, mapping: Mapping[str, str], policy: str = "REJECT", default: str | None = None) -> tuple[Column, Column]:
    """Map a code through a literal table. Returns ``(value, failed)``.

    Policies: REJECT (unmapped non-null value fails), DEFAULT (the field's
    default value), PASS_THROUGH (value unchanged). Null stays null.
    """
    mapped = F.element_at(map_literal(mapping), col.cast("string")) if mapping else F.lit(None).cast("string")
    return by_policy(col, mapped, policy, default)


def by_policy(col: Column, mapped: Column, policy: str = "REJECT", default: str | None = None) -> tuple[Column, Column]:
    """``(value, failed)`` of a code and what a table maps it to."""
    policy = (policy or "REJECT").upper()
    if policy == "DEFAULT":
        value = F.when(col.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(mapped, F.lit(default).cast("string")))
        failed = F.lit(False)
    elif policy == "PASS_THROUGH":
        value = F.when(col.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(mapped, col.cast("string")))
        failed = F.lit(False)
    else:
        value = mapped
        failed = col.isNotNull() & mapped.isNull()
    return value, failed


def map_table(df: DataFrame, field: str, table: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """Code translation through a lookup table (size-checked broadcast); of a repeated code the smallest value counts."""
    t = table.groupBy(F.col(key).alias("_map_k")).agg(F.min(value).alias("_map_v"))
    t, small = _checked(t)
    j = df.join(strategy.hint_broadcast(t, small), df[f"`{field}`"] == t["_map_k"], "left")
    return j.withColumn(out or field, F.col("_map_v")).drop("_map_k", "_map_v")
