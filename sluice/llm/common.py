"""Helpers shared by the text operators: words, let-bindings, shared scratch tables, components, checked broadcasts."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import scratch_path

# ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"
BROADCAST_ROWS = 1_000_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: lambda variables are not re-expanded by the optimiser."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (maximal runs without ASCII white space); empty array when there is none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that clashes with none of ``taken`` (names compare without case, as in Spark)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows per Arrow batch: rows hold whole texts, and a worker holds a batch more than once."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_CONF, "10000")) > rows:
        conf.set(BATCH_CONF, str(rows))


class Scratch:
    """Parquet tables of one operator call under the folder named by ``spark.checkpoint.dir``.

    A written table cuts lineage and survives lost executors, since the
    folder is shared. ``drop`` removes a table that later steps no longer
    read; tables behind a returned DataFrame stay until the caller has stored
    its rows and clears them (``clear_since``), or the folder's own retention
    removes them.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        Scratch.opened.append(self)
        self.spark = spark
        self.root = scratch_path(spark, f"{label}-{uuid.uuid4().hex}")
        self._n = 0

    def write(
        self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None, options: dict | None = None
    ) -> DataFrame:
        """Store a frame and read it back; the exchanges of what was stored are no longer needed after that."""
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        writer = df.write.mode("error").options(**options or {})
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_table = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df.scratch_table)

    def clear(self) -> None:
        self._delete(self.root)
        if self in Scratch.opened:
            Scratch.opened.remove(self)

    @classmethod
    def clear_since(cls, mark: int) -> None:
        """Clear what was opened after ``len(Scratch.opened)`` was ``mark``."""
        for scratch in cls.opened[mark:]:
            scratch.clear()

    def release(self) -> None:
        """Let Spark remove the exchange files of finished queries now: its cleaner acts on what the driver's collector
        finds unreachable, which on a quiet driver comes late."""
        for _ in range(2):  # the second collection finds what the first one's finalizers let go
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.7)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the (stored, narrow) table is counted below ``limit`` rows; else leave a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Union-find over an edge table by alternating large-star and small-star steps.

    ``edges`` has columns ``a`` and ``b`` (same orderable type); self-links
    and repeats are allowed. Returns ``node, component`` for every node that
    has a link, ``component`` being the smallest node reachable. Each round
    is two keyed minima and two joins with the edge table. The minima are
    stored first, so both join sides are plain exchanges and a hub with very
    many links is split by the adaptive skew join. No part is collected.
    """
    current = scratch.write(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(current)
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # neighbours above the node point to the smallest neighbour
        large = scratch.write(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low2, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        following = scratch.write(small, "edges")
        after = _state(following)
        for old in (current, low, large, low2):
            scratch.drop(old)
        current = following
        if after == state:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = after
    raise RuntimeError("connected components did not settle")


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table, to see whether a round changed it."""
    row = edges.agg(
        F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    ).first()
    return tuple(row)
