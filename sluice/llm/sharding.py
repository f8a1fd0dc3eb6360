"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Every record hashes into one of ``slots`` virtual slots (thousands, fixed for
the life of a data set). Sizes are summed per slot, and a small map assigns
slots to shards so that shard sizes come out near equal. The map is a
versioned table: rebalancing or adding shards writes a new version that moves
as few slots as the tolerance allows, and records never change their slot.

The hash covers the record's id and text, so a hot id or source does not fill
one slot; rows equal in both stay together. Defined results: a null text has
no bytes, a null id hashes like any value, empty tables give empty tables,
repeated rows each take a place of their own, extra columns pass through and
clashing ones are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import text_of

SLOTS = 4096
ROW_OVERHEAD = 8
MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("virtual_slot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("bytes", T.LongType(), False),
    ]
)


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Add ``size`` (UTF-8 bytes plus the row overhead), ``text_crc32`` and ``virtual_slot``."""
    text = text_of(F.col("text"))
    return docs.withColumns(
        {
            "size": F.octet_length(text).cast("long") + ROW_OVERHEAD,
            "text_crc32": F.crc32(text.cast("binary")),
            "virtual_slot": F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(slots)).cast("int"),
        }
    )


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """Bytes and rows per slot: at most one row per slot and task before the shuffle."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def assign(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first to the least loaded shard. Works on the slot table only, whose length is fixed."""
    loads = [(0, shard) for shard in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + sizes.get(slot, 0), shard))
    return out


def rebalance(current: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """Edit a map for new sizes or more shards: move slots off shards above the mean by more than ``tolerance``.

    From the fullest shard the largest slot that still fits goes to the
    emptiest one, until all are within the tolerance or no move helps; all
    other slots stay where they are.
    """
    out = dict(current)
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    homeless = [s for s, shard in out.items() if shard >= shards]
    for slot, shard in out.items():
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
            held[shard].add(slot)
    mean = sum(sizes.values()) / shards
    for slot in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
        to = min(range(shards), key=lambda i: (load[i], i))
        out[slot] = to
        held[to].add(slot)
        load[to] += sizes.get(slot, 0)
    for _ in range(len(out)):
        high = max(range(shards), key=lambda i: (load[i], -i))
        low = min(range(shards), key=lambda i: (load[i], i))
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        room = (load[high] - load[low]) / 2
        fits = [s for s in held[high] if 0 < sizes.get(s, 0) <= room]
        if not fits:
            break
        slot = max(fits, key=lambda s: (sizes.get(s, 0), -s))
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
        out[slot] = low
    return out


class SlotMap:
    """The stored map: one folder ``version=N`` per version, never rewritten; the highest version is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("v")) for n in done)

    def write(self, mapping: dict[int, int], sizes: dict[int, int]) -> int:
        version = max(self.versions(), default=0) + 1
        rows = [(version, slot, shard, int(sizes.get(slot, 0))) for slot, shard in sorted(mapping.items())]
        table = self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
        table.write.mode("error").parquet(f"{self.path}/v{version}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        at = max(self.versions()) if version is None else version
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{at}")

    def mapping(self, version: int | None = None) -> dict[int, int]:
        return {r["virtual_slot"]: r["shard"] for r in self.read(version).collect()}


def shard(docs: DataFrame, path: str, shards: int = 24, slots: int = SLOTS, tolerance: float = 0.02) -> DataFrame:
    """Place every record on a shard by the map at ``path``; writes a new map version where the stored one is off balance.

    Adds ``size``, ``text_crc32``, ``virtual_slot``, ``map_version``,
    ``shard`` and ``slot``, the record's place in its shard, gapless from 0.
    Places count on from slot to slot by the slots' row counts, so numbering
    needs no task larger than one virtual slot.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, slots)
    # one row per virtual slot: a fixed number, whatever the data
    totals = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in slot_bytes(slotted).collect()}
    sizes = {s: b for s, (b, _) in totals.items()}
    stored = SlotMap(spark, path)
    if stored.versions():
        old = stored.mapping()
        new = rebalance(old, sizes, shards, tolerance)
        version = stored.write(new, sizes) if new != old else max(stored.versions())
    else:
        new = assign(sizes, shards, slots)
        version = stored.write(new, sizes)
    first: dict[int, int] = {}
    placed = [0] * shards
    for s in sorted(totals):
        first[s] = placed[new[s]]
        placed[new[s]] += totals[s][1]
    starts = spark.createDataFrame(
        [(s, new[s], first[s]) for s in sorted(totals)], "virtual_slot int, shard int, first_place long"
    )
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.drop("shard", "slot", "first_place", "map_version")
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.col("first_place") + F.row_number().over(place) - 1)
        .withColumn("map_version", F.lit(version))
        .drop("first_place")
    )


def law() -> Column:
    """The law this placement keeps: shard sizes in bytes near equal."""
    return F.lit("bytes")
