"""Staging, staging checks and promotion (insert-ignore, upsert, replace).

The merge logic is pure DataFrame algebra (``*_frame`` functions) so it can
be inspected, tested and registered as queries. ``BucketedTable`` stores a
target as a bucketed and partitioned Parquet table of Spark's: a merge reads
it in its buckets, without an exchange, and rewrites only the partitions that
hold a matched key.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import rules
from sluice.plans.config import check_identifier

TRACE_COLUMNS = ("etl_execution_id", "etl_pipeline_id", "etl_source_file", "etl_load_timestamp", "etl_pipeline_version")
AUDIT_COLUMNS = ("created_at", "updated_at")
ACTION = "_action"
INSERTED, UPDATED, UNCHANGED, SKIPPED = "inserted", "updated", "unchanged", "skipped_closed"


@dataclass
class RunContext:
    execution_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    pipeline_id: str = ""
    pipeline_version: str = "1.0.0"
    source_file: str | None = None
    load_timestamp: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    as_of: dt.date = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).date())


@dataclass
class LoadResult:
    inserted: int = 0
    updated: int = 0
    rejected: int = 0
    skipped: int = 0
    staged: int = 0
    errors: list[str] = field(default_factory=list)

    @property
    def loaded(self) -> int:
        return self.inserted + self.updated


class StagingCheckFailed(RuntimeError):
    def __init__(self, details: list[str]):
        super().__init__("; ".join(details))
        self.details = details


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ------------------------------------------------------------ L2 / L3 / L4


def add_trace_columns(df: DataFrame, run: RunContext) -> DataFrame:
    source = F.coalesce(F.col("_source"), F.lit(run.source_file)) if "_source" in df.columns else F.lit(run.source_file)
    return df.withColumns({
        "etl_execution_id": F.lit(run.execution_id),
        "etl_pipeline_id": F.lit(run.pipeline_id),
        "etl_source_file": source.cast("string"),
        "etl_load_timestamp": F.lit(run.load_timestamp).cast("timestamp"),
        "etl_pipeline_version": F.lit(run.pipeline_version),
    })


def union_for_load(frames: Sequence[DataFrame]) -> DataFrame:
    """Ordered union of all frames' columns; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def checked_columns(names: Sequence[str]) -> list[str]:
    return [check_identifier(n) for n in names]


# -------------------------------------------------------------- L15 (rows)


def constraint_checks(df: DataFrame, not_null: Sequence[str] = (), non_negative: Sequence[str] = (),
                      max_length: dict[str, int] | None = None, decimal_fit: dict[str, str] | None = None) -> list[Column]:
    """Target-table constraints as per-row rules, so a row that the target
    would refuse is rejected alone instead of failing its chunk."""
    out = []
    for c in not_null:
        out.append(rules.check(_q(c).isNull(), c, None, "NOT_NULL_CONSTRAINT", f"Column {c} must not be null"))
    for c in non_negative:
        out.append(rules.check(_q(c) < 0, c, _q(c), "CHECK_CONSTRAINT", f"Column {c} must be >= 0"))
    for c, n in (max_length or {}).items():
        out.append(rules.check(F.length(_q(c).cast("string")) > n, c, _q(c), "LENGTH_CONSTRAINT",
                               f"Column {c} longer than {n}"))
    for c, typ in (decimal_fit or {}).items():
        out.append(rules.check(_q(c).isNotNull() & _q(c).try_cast(typ).isNull(), c, _q(c), "NUMERIC_OVERFLOW",
                               f"Column {c} does not fit {typ}"))
    return out


# -------------------------------------------------------------- L5 - L7


def staging_check_frame(staged: DataFrame, keys: Sequence[str] = (), not_null: Sequence[str] = (),
                        check_duplicates: bool = True) -> DataFrame:
    """One-row summary of the staging checks in a single pass: staged rows,
    null count per NOT NULL column, number of keys staged more than once.
    Grouping by key first makes the duplicate count and the null counts one
    aggregation pipeline (partial aggregation, no window, no cross join)."""
    nn = list(not_null)
    if keys and check_duplicates:
        per_key = staged.groupBy(*[_q(k) for k in keys]).agg(
            F.count(F.lit(1)).alias("_n"), *[F.count_if(_q(c).isNull()).alias(f"_null_{c}") for c in nn])
        return per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("staged_rows"),
            *[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).cast("long").alias(f"nulls_{c}") for c in nn],
            F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        )
    return staged.agg(
        F.count(F.lit(1)).alias("staged_rows"),
        *[F.count_if(_q(c).isNull()).alias(f"nulls_{c}") for c in nn],
        F.lit(0).cast("long").alias("duplicate_keys"),
    )


def staging_check_details(row, expected_rows: int | None, not_null: Sequence[str]) -> list[str]:
    details = []
    if expected_rows is not None and row["staged_rows"] != expected_rows:
        details.append(f"Row count mismatch: expected={expected_rows}, actual={row['staged_rows']}")
    for c in not_null:
        n = row[f"nulls_{c}"]
        if n:
            details.append(f"Mandatory staging column has null values: {c} ({n} rows)")
    if row["duplicate_keys"]:
        details.append(f"Business key duplicates found in staging: {row['duplicate_keys']}")
    return details


# ------------------------------------------------------------- L8 - L12


def merge_frame(target: DataFrame, staging: DataFrame, keys: Sequence[str], guard_column: str | None = None,
                guard_value: str | None = None, immutable: Sequence[str] = ()) -> DataFrame:
    """UPSERT as a full outer join: new keys inserted, existing keys
    updated in every non-key column except ``created_at``/``updated_at`` and
    ``immutable`` ones; with a guard, a target row whose flag equals the
    closed value (null counts as open) is kept as is. Adds ``_action``.
    Output columns are the target's; staging keys are unique (checked)."""
    cols = target.columns
    keep_target = set(keys) | set(AUDIT_COLUMNS) | set(immutable)
    t = target.select(*[_q(c).alias(f"t__{c}") for c in cols], F.lit(True).alias("_t"))
    s = staging.select(*[_q(c).alias(f"s__{c}") for c in cols if c in staging.columns], F.lit(True).alias("_s"))
    cond = reduce(lambda a, b: a & b, [F.col(f"`t__{k}`") == F.col(f"`s__{k}`") for k in keys])
    j = t.join(s, cond, "full_outer")
    in_t, in_s = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    if guard_column:
        closed = F.col(f"`t__{guard_column}`").eqNullSafe(F.lit(guard_value))
    else:
        closed = F.lit(False)
    action = (F.when(in_t & in_s & closed, F.lit(SKIPPED)).when(in_t & in_s, F.lit(UPDATED))
              .when(in_s, F.lit(INSERTED)).otherwise(F.lit(UNCHANGED)))
    j = j.withColumn(ACTION, action)
    out = []
    for c in cols:
        tc = F.col(f"`t__{c}`")
        if c not in staging.columns:
            out.append(tc.alias(c))
            continue
        sc = F.col(f"`s__{c}`")
        if c in keys:
            out.append(F.when(in_t, tc).otherwise(sc).alias(c))
        elif c in keep_target:
            out.append(F.when(F.col(ACTION) == INSERTED, sc).otherwise(tc).alias(c))
        else:
            out.append(F.when(F.col(ACTION).isin(INSERTED, UPDATED), sc).otherwise(tc).alias(c))
    return j.select(*out, F.col(ACTION))


def insert_new_rows(target: DataFrame, staged: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """Staging rows whose key is absent from the target, the first per key by ``order_col`` if staging repeats one;
    without keys all rows. A key with a null is never a conflict, as in SQL."""
    if not keys:
        return staged
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | _q(k).isNull()
    new = staged.join(target.select(*[_q(k) for k in keys]), list(keys), "left_anti")
    keyed = new.where(~has_null)
    if order_col:
        from sluice.operators.dedup import keep_first

        keyed = keep_first(keyed, keys, row_id=order_col).filter(~F.col("_dup")).drop("_dup")
    else:
        keyed = keyed.dropDuplicates(list(keys))
    return keyed.unionByName(new.where(has_null))


def insert_ignore_frame(target: DataFrame, staging: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: the target's rows and the staging rows that insert_new_rows() lets in.
    Adds ``_action``."""
    cols = target.columns
    staged = staging.select(*[(_q(c) if c in staging.columns else F.lit(None).cast(target.schema[c].dataType)).alias(c)
                              for c in cols] + ([_q(order_col)] if order_col and order_col not in cols else []))
    new = insert_new_rows(target, staged, keys, order_col).select(*cols, F.lit(INSERTED).alias(ACTION))
    return target.select(*cols, F.lit(UNCHANGED).alias(ACTION)).unionByName(new)


def replace_frame(staging: DataFrame, columns: Sequence[str]) -> DataFrame:
    return staging.select(*[_q(c) if c in staging.columns else F.lit(None).alias(c) for c in columns],
                          F.lit(INSERTED).alias(ACTION))


def rollback_frame(target: DataFrame, execution_id: str) -> DataFrame:
    """Delete the rows written by one execution (older values of updated
    rows are not restored, as in the reference)."""
    return target.filter(~F.coalesce(F.col("etl_execution_id") == F.lit(execution_id), F.lit(False)))


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy(ACTION).agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------- bucketed storage

PART = "_part"
SPEC = "sluice.table"


class BucketedTable:
    """A target table in Spark's own storage: a Parquet table at ``root``, partitioned by a hash of the business key
    into ``parts`` folders and bucketed by the key within each.

    The buckets spare the target an exchange in every join with a batch: only
    the batch is shuffled, into the table's buckets. The folders are what a
    load replaces: an upsert rewrites those that hold a matched key by a
    dynamic partition overwrite (staged and moved in by Spark's committer) and
    appends to the others, an insert appends only. One writer at a time, as
    runs of a pipeline are. With ``history`` each load first stores the rows
    of the folders that it is about to change, and ``restore`` puts the table
    back to where it was after an earlier load.

    The columns and the layout are kept in an empty Parquet table beside the
    folders, so that any session can open the table by its path.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], num_buckets: int = 64, parts: int = 16,
                 history: bool = False):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.num_buckets, self.parts, self.history = num_buckets, parts, history
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.name = "sluice_" + hashlib.sha256(self.root.encode()).hexdigest()[:24]

    # -- layout

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.root}/_schema/_SUCCESS"))

    def schema(self) -> T.StructType | None:
        """The table's columns; None for a table that was never created."""
        if not self.exists():
            return None
        stored = self.spark.read.parquet(f"{self.root}/_schema").schema
        spec = stored.fields[0].metadata[SPEC]
        if spec["keys"] != self.keys:
            raise ValueError(f"the table at {self.root} is keyed by {spec['keys']}, not by {self.keys}")
        self.num_buckets, self.parts = spec["buckets"], spec["parts"]
        return T.StructType([T.StructField(f.name, f.dataType) for f in stored])

    def _register(self) -> T.StructType:
        """Make the table known to the session's catalog, with all its folders; overwrites then replace single folders."""
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        schema = self.schema()
        if schema is None:
            raise FileNotFoundError(f"no table at {self.root}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        buckets = f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.num_buckets} BUCKETS" if keys else ""
        location = f"{self.root}/data".replace("'", "\\'")
        if not self.spark.catalog.tableExists(self.name):
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}, {PART} INT) USING parquet PARTITIONED BY ({PART}) "
                           f"{buckets} LOCATION '{location}'")
        self._fs.mkdirs(self._path(f"{self.root}/data"))
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(self.name)
        return schema

    def part(self) -> Column:
        """Folder of a row; rows of a table without a key are dealt out in turn."""
        value = F.xxhash64(*[_q(k) for k in self.keys]) if self.keys else F.monotonically_increasing_id()
        return F.pmod(value, F.lit(self.parts)).cast("int")

    def read(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of some folders; joins and aggregates by the key need no exchange of them."""
        schema = self._register()
        rows = self.spark.table(self.name)
        if parts is not None:
            rows = rows.where(F.col(PART).isin([int(p) for p in parts])) if len(parts) else rows.limit(0)
        return rows.select(*[_q(f.name) for f in schema])

    def _parts_of(self, df: DataFrame) -> list[int]:
        """Folders that hold rows of a frame: at most ``parts`` ints."""
        return sorted(r[0] for r in df.select(self.part().alias("p")).distinct().collect())

    def _to_schema(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """A batch in the table's columns and types; columns that the table lacks are an error."""
        unknown = [c for c in df.columns if c not in schema.names and c != ACTION]
        if unknown:
            raise ValueError(f"columns not in the target: {unknown}")
        have = set(df.columns)
        return df.select(*[(_q(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    # -- writes

    def _write(self, rows: DataFrame, overwrite: bool) -> dict[str, int]:
        """Append rows with an ``_action``, or replace the folders they fall in; counts by action come with the write."""
        seen = Observation()
        actions = (INSERTED, UPDATED, UNCHANGED, SKIPPED)
        watched = rows.observe(seen, *[F.count_if(F.col(ACTION) == a).alias(a) for a in actions])
        names = [c for c in rows.columns if c != ACTION]
        watched.select(*[_q(c) for c in names], self.part().alias(PART)).write.mode(
            "overwrite" if overwrite else "append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return {a: n for a, n in seen.get.items() if n}

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows of no known distribution, one task per bucket (a task would write a file for every bucket otherwise)."""
        return rows.repartition(self.num_buckets, *[_q(k) for k in self.keys]) if self.keys else rows

    def _drop(self, parts: Sequence[int]) -> None:
        for p in parts:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART}={int(p)})")
            self._fs.delete(self._path(f"{self.root}/data/{PART}={int(p)}"), True)
        if parts:
            self.spark.catalog.refreshTable(self.name)

    def _present(self) -> list[int]:
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def create(self, df: DataFrame) -> None:
        """A new table with the columns and rows of a frame."""
        if self.exists():
            raise FileExistsError(f"a table exists at {self.root}")
        checked_columns(df.columns)
        spec = {SPEC: {"keys": self.keys, "buckets": self.num_buckets, "parts": self.parts}}
        noted = [_q(f.name).alias(f.name, metadata=spec if i == 0 else {}) for i, f in enumerate(df.schema)]
        df.limit(0).select(*noted).write.parquet(f"{self.root}/_schema")
        self._register()
        self._remember([])
        self._write(self._dealt(df).withColumn(ACTION, F.lit(INSERTED)), overwrite=False)

    def upsert(self, staging: DataFrame, guard_column=None, guard_value=None, immutable=()) -> dict[str, int]:
        """Merge by key; returns the rows by action. Folders that hold a matched key are rewritten, new keys of the
        others are added to them."""
        schema = self._register()
        staging = self._to_schema(staging, schema)
        touched = self._parts_of(staging)
        keys = staging.select(*[_q(k) for k in self.keys]).distinct()
        matched = self._parts_of(self.read(touched).join(keys, list(self.keys), "left_semi"))
        self._remember(touched)
        in_matched = self.part().isin(matched) if matched else F.lit(False)
        counts: dict[str, int] = {}
        if len(matched) < len(touched):
            added = staging.where(~in_matched).withColumn(ACTION, F.lit(INSERTED))
            counts = self._write(self._dealt(added), overwrite=False)
        if matched:
            merged = merge_frame(self.read(matched), staging.where(in_matched), self.keys, guard_column, guard_value, immutable)
            for action, n in self._write(merged, overwrite=True).items():
                counts[action] = counts.get(action, 0) + n
        counts.pop(UNCHANGED, None)
        return counts

    def insert(self, staging: DataFrame, order_col: str | None = None) -> dict[str, int]:
        """Append the rows whose key is not there yet (all rows where the table has no key); nothing is rewritten."""
        schema = self._register()
        order = [order_col] if order_col and order_col not in schema.names else []
        rows = self._to_schema(staging.drop(*order), schema)
        if order:
            named = [(_q(f.name) if f.name in staging.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
            rows = staging.select(*named, _q(order_col))
        touched = self._parts_of(rows) if self.keys else []
        self._remember(touched if self.keys else self._present())
        new = insert_new_rows(self.read(touched), rows, self.keys, order_col).select(*[_q(c) for c in schema.names])
        return self._write(self._dealt(new).withColumn(ACTION, F.lit(INSERTED)), overwrite=False)

    def replace(self, staging: DataFrame) -> dict[str, int]:
        """The batch in place of all rows."""
        schema = self._register()
        rows = self._to_schema(staging, schema).withColumn(ACTION, F.lit(INSERTED))
        before = self._present()
        after = self._parts_of(rows) if self.keys else []
        self._remember(sorted({*before, *after}))
        if not self.keys:
            self._drop(before)
        counts = self._write(self._dealt(rows), overwrite=True)
        self._drop([p for p in before if self.keys and p not in after])
        return counts

    def rollback(self, execution_id: str) -> int:
        """Remove the rows of one execution; returns how many folders were rewritten."""
        schema = self._register()
        if "etl_execution_id" not in schema.names:
            return 0
        stored = self.spark.table(self.name)
        hit = sorted(r[0] for r in stored.where(F.col("etl_execution_id") == execution_id).select(PART).distinct().collect())
        if hit:
            self._remember(hit)
            self._replace_parts(rollback_frame(stored.where(F.col(PART).isin(hit)), execution_id), hit)
        return len(hit)

    def _replace_parts(self, rows: DataFrame, parts: Sequence[int]) -> None:
        """Rows with their ``_part`` in place of some folders; folders without rows go."""
        left = {r[0] for r in rows.select(PART).distinct().collect()}
        names = self.schema().names
        if left:
            dealt = rows.repartition(self.num_buckets, *[_q(k) for k in self.keys]) if self.keys else rows
            dealt.select(*[_q(c) for c in names], PART).write.mode("overwrite").insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)
        self._drop([p for p in parts if p not in left])

    # -- history

    @property
    def version(self) -> int:
        """Number of loads that were remembered."""
        if not self._fs.exists(self._path(f"{self.root}/_loads")):
            return 0
        return self.spark.read.parquet(f"{self.root}/_loads").agg(F.max("load")).first()[0]

    def _remember(self, parts: Sequence[int]) -> None:
        """Store the rows of the folders that the next load changes, under its number."""
        if not self.history:
            return
        load = self.version + 1
        rows = self.spark.table(self.name).where(F.col(PART).isin([int(p) for p in parts]) if parts else F.lit(False))
        rows.withColumnRenamed(PART, "part").write.parquet(f"{self.root}/_before/load={load}")
        changed = self.spark.createDataFrame([(int(p),) for p in parts] or [(-1,)], "part int")
        changed.coalesce(1).write.parquet(f"{self.root}/_loads/load={load}")

    def restore(self, version: int) -> None:
        """The table as it was after load ``version``: every folder that a later load changed gets its rows from before
        the first such load. Itself a load."""
        schema = self._register()
        if not self.history or not 1 <= version <= self.version:
            raise FileNotFoundError(f"no version {version} at {self.root}")
        later = self.spark.read.parquet(f"{self.root}/_loads").where((F.col("load") > version) & (F.col("part") >= 0))
        first = {r["part"]: r["load"] for r in later.groupBy("part").agg(F.min("load").alias("load")).collect()}
        if not first:
            return
        self._remember(sorted(first))
        kept = None
        for load in sorted(set(first.values())):
            parts = [p for p, n in first.items() if n == load]
            rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])) \
                .parquet(f"{self.root}/_before/load={load}").where(F.col("part").isin(parts)).withColumnRenamed("part", PART)
            kept = rows if kept is None else kept.unionByName(rows)
        self._replace_parts(kept, sorted(first))
