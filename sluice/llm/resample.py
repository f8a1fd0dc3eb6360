"""Importance resampling towards a target distribution.

Words and runs of words are hashed into buckets. The log ratio of the target's
and the corpus's share of a bucket is the bucket's gain; a document's weight is
the sum of its gains, read from one array. With Gumbel noise of the document's
own hash added, the best scores are a weighted draw without replacement. The
cutoff of the draw is found by weighted median-of-medians selection: each
partition reports the median of its keys that are still in question and how
many those are, the weighted median of the medians is the pivot, and as half of
the partitions (by weight) have half of their keys on either side of it, every
round discards at least a quarter of the keys; counts on both sides of the
pivot decide which. The driver holds one row per partition. The winners are
sorted by range exchange, and their ranks are places within a partition plus
the sizes of the partitions before it.

Keys are (score descending, document id, stored row number), so they are
unique and the draw is exact. Defined results: a null text has no words; a
document without features weighs 0; documents with fewer than the least number
of words are never drawn and have no rank; equal scores go to the smaller id; a
null id is hashed as an empty string and ranks last among equal scores; rows
that repeat an id count and are drawn one by one; very long texts are read
whole; empty tables give empty tables, and an empty target leaves the gains to
the corpus's counts; extra columns pass through, and a column that clashes with
an added one is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, fresh, let, text_of

# what lies between words once A-Z is lowered: ASCII without digits and small letters
BETWEEN = r"[\x00-/:-`{-\x7f]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ["n_features", "weight", "score", "rank"]
LAST = (1 << 63) - 1
SIDE = "side int, keys long, neg long, id long, rid long"
SIDE_ARROW = pa.schema([("side", pa.int32()), *[(n, pa.int64()) for n in ("keys", "neg", "id", "rid")]])

Key = tuple[int, int, int]


@dataclass(frozen=True)
class Draw:
    """Feature runs of 1 to ``longest`` words in ``buckets``; ``percent`` of the documents with ``min_words`` are drawn."""

    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    min_words: int = 20
    # this many keys in question are sorted by one task, instead of further rounds
    last_sort: int = 10_000


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII only can take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucketed(text: Column, draw: Draw) -> Column:
    """``n_words`` and the bucket of every feature of a whole text, repeats included."""
    words = F.array_remove(F.split(lowered(text), BETWEEN), "")

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % draw.buckets).cast("int")

    def runs(ws: Column, n: int) -> Column:
        if n == 1:
            return F.transform(ws, bucket)
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1)))
        each = F.transform(starts, lambda i: bucket(F.array_join(F.slice(ws, i, n), " ")))
        return F.coalesce(each, F.array().cast("array<int>"))

    def features(ws: Column) -> Column:
        every = [runs(ws, n) for n in range(1, draw.longest + 1)]
        return F.struct(
            F.size(ws).alias("n_words"), (every[0] if len(every) == 1 else F.concat(*every)).alias("buckets")
        )

    return let(words, features)


def bucket_counts(buckets: DataFrame) -> dict[int, int]:
    """Features per bucket of a column ``buckets``, combined before the shuffle: one row per bucket."""
    rows = buckets.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares, rounded down, for every bucket."""
    s_all, t_all = float(sum(corpus.values())), float(sum(target.values()))
    return [
        math.floor(
            1000
            * math.log(
                (target.get(b, 0) + 1.0) * (s_all + buckets) / ((corpus.get(b, 0) + 1.0) * (t_all + buckets))
            )
        )
        for b in range(buckets)
    ]


def _long_array(values: list[int]) -> Column:
    """One literal array, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scores(docs: DataFrame, target: DataFrame, draw: Draw, scratch: Scratch, names: list[str]) -> DataFrame:
    """``rid, record, n_features, weight, score, n_words`` per row, stored; ``record`` holds the columns ``names``."""
    made = scratch.write(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.struct(*names).alias("record"),
            bucketed(text_of(F.col("text")), draw).alias("f"),
        ),
        "features",
    )
    wanted = target.select(bucketed(text_of(F.col("text")), draw).alias("f")).select("f.buckets")
    gain = gains(bucket_counts(made.select("f.buckets")), bucket_counts(wanted), draw.buckets)
    weight = F.aggregate("f.buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(_long_array(gain), b))
    name = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    out = scratch.write(
        made.select(
            "rid",
            "doc_id",
            "record",
            F.col("f.n_words").alias("n_words"),
            F.size("f.buckets").cast("long").alias("n_features"),
            weight.alias("weight"),
            noise.alias("noise"),
        ).select("*", (F.col("weight") + F.col("noise")).alias("score")),
        "scores",
    )
    scratch.drop(made)
    return out


def _beyond(key: Key, after: bool) -> Column:
    """Keys after (or before) ``key`` in drawing order; the first condition alone reaches the scan."""
    neg, i, rid = key
    if after:
        return (F.col("neg") >= neg) & (
            (F.col("neg") > neg) | (F.col("id") > i) | ((F.col("id") == i) & (F.col("rid") > rid))
        )
    return (F.col("neg") <= neg) & (
        (F.col("neg") < neg) | (F.col("id") < i) | ((F.col("id") == i) & (F.col("rid") < rid))
    )


def _medians(pivot: Key | None):
    """Per partition: keys on either side of the pivot, and the median of each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (neg, id, rid) of the partition's keys in question, fixed 24 bytes each
        parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if not parts:
            return
        keys = np.concatenate(parts, axis=1)
        if pivot is None:
            sides = {0: keys}
        else:
            (neg, i, rid), (p, q, r) = keys, pivot
            after = (neg > p) | ((neg == p) & ((i > q) | ((i == q) & (rid > r))))
            same = (neg == p) & (i == q) & (rid == r)
            sides = {0: keys[:, ~after & ~same], 1: keys[:, after]}
        rows = []
        for side, of in sides.items():
            if of.shape[1]:
                middle = np.lexsort(of[::-1])[(of.shape[1] - 1) // 2]
                rows.append((side, of.shape[1], *map(int, of[:, middle])))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in SIDE_ARROW]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SIDE_ARROW, strict=True)], SIDE_ARROW)

    return run


def weighted_median(medians: list[tuple[int, Key]]) -> Key:
    """The median at which half of the weight is reached."""
    half, total = sum(n for n, _ in medians) / 2, 0
    for n, key in sorted(medians, key=lambda x: x[1]):
        total += n
        if total >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int, last_sort: int) -> tuple[Key, int]:
    """The ``k``-th key (1 is the first) of ``neg, id, rid``, and the rounds that it took.

    Each round is one pass over the keys in question: it counts both sides
    of the last pivot and takes the medians of both, of which the side that
    holds the ``k``-th key is used.
    """
    rest, pivot, rounds = keys, None, 0
    while True:
        rounds += 1
        told = rest.mapInArrow(_medians(pivot), SIDE).collect()
        sides = [[(r["keys"], (r["neg"], r["id"], r["rid"])) for r in told if r["side"] == s] for s in (0, 1)]
        if pivot is not None:
            before = sum(n for n, _ in sides[0])
            if k == before + 1:
                return pivot, rounds
            rest = rest.where(_beyond(pivot, after=k > before))
            if k > before:
                k, sides = k - before - 1, sides[::-1]
        if sum(n for n, _ in sides[0]) <= last_sort:
            row = rest.orderBy("neg", "id", "rid").limit(k).agg(F.max(F.struct("neg", "id", "rid"))).first()[0]
            return tuple(row), rounds
        pivot = weighted_median(sides[0])


def ranked(winners: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``rank`` (1, 2, ...) in the order of ``neg, id, rid``: a range exchange, no window over all rows."""
    place = F.monotonically_increasing_id()
    placed = scratch.write(winners.orderBy("neg", "id", "rid").withColumn("place", place), "winners")
    # the upper bits are the partition, the lower 33 the place in it
    part = F.shiftright("place", 33)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    local = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    rank = F.get(_long_array(before or [0]), part.cast("int")) + local + 1
    return placed.withColumn("rank", rank.cast("long")).drop("place")


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), carry: list[str] | None = None) -> DataFrame:
    """All documents with ``n_features, weight, score`` and, for those drawn, ``rank``; ``carry`` names the columns to return."""
    scratch = Scratch(docs.sparkSession, "resample")
    names = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    scored = scores(docs, target, draw, scratch, names)
    able = F.col("n_words") >= draw.min_words
    keyed = scored.select(
        "*", (-F.col("score")).alias("neg"), F.coalesce("doc_id", F.lit(LAST)).alias("id"), able.alias("able")
    )
    k = scored.where(able).count() * draw.percent // 100
    out = ["record", "n_features", "weight", "score", "rank"]
    if k == 0:
        drawn = keyed.withColumn("rank", F.lit(None).cast("long")).select(*out)
    else:
        last, _ = cutoff(keyed.where("able").select("neg", "id", "rid"), k, draw.last_sort)
        wins = F.col("able") & ~_beyond(last, after=True)
        firsts = ranked(keyed.where(wins), scratch)
        drawn = firsts.select(*out).unionByName(
            keyed.where(~wins).withColumn("rank", F.lit(None).cast("long")).select(*out)
        )
    return drawn.select("record.*", *out[1:])
