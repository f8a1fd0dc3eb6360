"""Physical-strategy helpers: checked broadcasts and lineage cuts.

A side is broadcast only after its row count has been measured on
materialised data and found under ``BROADCAST_ROW_LIMIT``; otherwise the
join stays a shuffle join (AQE may still split skewed partitions).
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import checkpoint_dir, scratch_path

BROADCAST_ROW_LIMIT = 1_000_000
BROADCAST_CONF = "sluice.broadcast.rowLimit"
BROADCAST_BYTE_LIMIT = 256 * 1024 * 1024
BROADCAST_BYTES_CONF = "sluice.broadcast.byteLimit"


def broadcast_limit(df: DataFrame) -> int:
    try:
        return int(df.sparkSession.conf.get(BROADCAST_CONF, str(BROADCAST_ROW_LIMIT)))
    except Exception:
        return BROADCAST_ROW_LIMIT


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared ``spark.checkpoint.dir``:
    cuts lineage and survives executor loss (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Staging:
    """Parquet tables of one run under ``spark.checkpoint.dir``: columnar, so later steps read the columns they use,
    shared, so a lost executor costs its tasks only, and gone after ``clear``."""

    def __init__(self, spark: SparkSession, label: str = "staging"):
        self.spark, self.root = spark, scratch_path(spark, f"{label}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str, metrics: Mapping[str, Column] | None = None) -> tuple[DataFrame, dict]:
        """Store a frame; returns the stored rows, and aggregates over them that were observed by the write itself."""
        path, seen = f"{self.root}/{name}", Observation()
        watched = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df
        # stored by position: source names may differ in case only, or hold anything; a column of nulls has no type
        flat = watched.select(*[
            (F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`")).alias(f"c{i}")
            for i, f in enumerate(df.schema)
        ])
        flat.write.parquet(path)
        stored = self.spark.read.schema(flat.schema).parquet(path)
        back = stored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
        return back, dict(seen.get) if metrics else {}

    def clear(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Materialise ``df`` once and return it with its row count."""
    m = materialize(df)
    return m, m.count()


def release(spark: SparkSession) -> None:
    """Let Spark remove the exchange files of finished queries now: it acts on what the driver's collector finds
    unreachable, which on a quiet driver comes late."""
    for _ in range(2):  # the second collection finds what the first one's finalizers let go
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _width(dt) -> int:
    """Bytes of a fixed-width value in Spark's row format (complex types are
    counted generously)."""
    if isinstance(dt, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dt, (T.ShortType,)):
        return 2
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dt, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
        return 8
    if isinstance(dt, T.DecimalType):
        return 8 if dt.precision <= 18 else 16
    if isinstance(dt, T.StructType):
        return sum(_width(f.dataType) for f in dt.fields) + 8
    return 256


def small_or_none(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """Materialise a (usually small) side and say whether it may be broadcast:
    its row count and its measured size (fixed-width fields by type, string
    and binary fields by their actual bytes) must both be under the limits."""
    m = materialize(df)
    var = [f.name for f in m.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = sum(_width(f.dataType) for f in m.schema.fields if f.name not in var) + 16
    stats = m.agg(F.count(F.lit(1)).alias("n"),
                  *[F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)).alias(f"_b{i}") for i, c in enumerate(var)]
                  ).first()
    n = stats["n"]
    size = n * fixed + sum(stats[f"_b{i}"] for i in range(len(var)))
    try:
        byte_limit = int(df.sparkSession.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTE_LIMIT)))
    except Exception:  # noqa: BLE001
        byte_limit = BROADCAST_BYTE_LIMIT
    return m, n <= (broadcast_limit(df) if limit is None else limit) and size <= byte_limit


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str], rprefix: str = "_r_") -> tuple[DataFrame, Column]:
    """Rename the right side's keys and build a null-safe equi-join condition."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, rprefix + k)
    cond = None
    for k in keys:
        c = left[f"`{k}`"].eqNullSafe(r[f"`{rprefix + k}`"])
        cond = c if cond is None else cond & c
    return r, cond


def hint_broadcast(df: DataFrame, ok: bool) -> DataFrame:
    return F.broadcast(df) if ok else df


def sequential_ids(df: DataFrame, name: str = "_row", start: int = 1) -> DataFrame:
    """Dense ids ``start, start+1, ...`` in partition order without a global
    window: per-partition counts (one small row per partition) get
    cumulative offsets that are joined back. ``df`` must be deterministic
    (a scan or a materialised table)."""
    from pyspark.sql import Window

    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright(F.col("_mid"), 33)
    parts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    parts, small = small_or_none(parts)
    j = tagged.withColumn("_pid", pid).join(hint_broadcast(parts, small), "_pid")
    return j.withColumn(name, F.col("_offset") + (F.col("_mid") - F.col("_first")) + F.lit(start)) \
        .drop("_mid", "_pid", "_first", "_offset")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when ``df`` has fewer partitions than the
    cluster has cores (e.g. a file with one row group is one task).

    A no-op for large inputs, whose scans already have many more splits than
    cores. Assign source row ids before spreading: ids taken after a
    shuffle are not tied to the input order.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


# plan nodes that never produce more rows than their child
_ROW_NON_INCREASING = {"Project", "Filter", "Aggregate", "Deduplicate", "Distinct", "Sort", "GlobalLimit",
                       "LocalLimit", "SubqueryAlias", "Repartition", "RepartitionByExpression", "Sample",
                       "ResolvedHint", "WithMetadata"}


def row_bound(df: DataFrame) -> int | None:
    """A proven upper bound on the rows of ``df`` without evaluating it.

    When the optimised plan is a chain of row-non-increasing operators over
    one Parquet scan, the scan's row count (read from the file footers, no
    data pages) bounds the result. ``None`` when no such bound is known.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while True:
        name = node.nodeName()
        children = node.children()
        if children.size() == 0:
            break
        if name not in _ROW_NON_INCREASING or children.size() != 1:
            return None
        node = children.apply(0)
    if node.nodeName() != "LogicalRelation" or "parquet" not in node.toString().lower():
        return None
    files = df.inputFiles()
    if not files:
        return 0
    return df.sparkSession.read.parquet(*files).count()


def broadcastable(df: DataFrame, limit: int | None = None) -> bool:
    """True only when ``df`` has a proven row bound under the limit."""
    bound = row_bound(df)
    return bound is not None and bound <= (broadcast_limit(df) if limit is None else limit)
