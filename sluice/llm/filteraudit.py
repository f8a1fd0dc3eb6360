"""Filter interaction audit from sorted posting lists.

Every part (``source``) keeps, per filter, the sorted list of the documents
that fail it, cut into ranges of ids; the labels are lists of the same kind.
The audit merges lists: the union of every set of filters that can stand before
a filter, built list by list, and the difference between a filter's list and
that union, both by galloping (doubling steps, then halving, for all entries of
the shorter list at once). A range gives the sizes of 80 such differences; they
are added up per part, and the 120 orders of five filters read them.

Documents go to ranges by (part, id) in a range exchange, so a part with most
of the documents is many ranges, and a task holds one Arrow batch of documents
at a time. The first document of each text is found by hash of the text,
combined before the shuffle; texts with very many copies (at most 100,000 can
hold more than a hundred-thousandth of the rows each) are looked up by
broadcast, the others by a shuffle join.

Defined results: a null text is an empty text; a null part is the part with the
empty name; documents are rows, so a repeated row counts again (it repeats no
smaller id, and fails the copy filter only if another row with a smaller id has
its text); a null id is smaller than no id and has no label; labels that repeat
an id are good (toxic) if one of them is; very long texts are read whole; an
empty table has no parts and gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, let, maybe_broadcast, text_of, words_of

FILTERS = "ABCDE"
# a text is hot if it holds more than this share of all rows: at most HOT_TEXTS texts can be
HOT_TEXTS = 100_000
LISTS = [*FILTERS, "good", "toxic"]
POSTINGS = "part string, ids array<bigint>, " + ", ".join(f"{n} array<int>" for n in LISTS)
POSTINGS_ARROW = pa.schema(
    [("part", pa.string()), ("ids", pa.list_(pa.int64())), *[(n, pa.list_(pa.int32())) for n in LISTS]]
)
COUNTS = ["rows", "failing", "removed", "good_lost", "toxic_lost"]
SIZES = "part string, filter int, before int, " + ", ".join(f"{c} long" for c in COUNTS)
SIZES_ARROW = pa.schema(
    [("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), *[(c, pa.int64()) for c in COUNTS]]
)


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A, B, C, D of a whole text."""

    def by_words(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0)

    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (
        let(words_of(text), by_words)
        + F.when(100 * capitals > 2 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    )


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``part, doc_id, bits`` per document: failed filters, then 32 for good and 64 for toxic documents. Texts are read once."""
    text = text_of(F.col("text"))
    rows = scratch.write(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("source", F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            text_failures(text).alias("bits"),
        ),
        "rows",
    )
    firsts = scratch.write(
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("copies"))
        .where("first < last")
        .select("digest", "first", "copies"),
        "firsts",
    )
    hot_from = rows.count() // HOT_TEXTS
    hot = firsts.where(F.col("copies") > hot_from).select("digest", F.col("first").alias("hot_first"))
    rest = firsts.where(F.col("copies") <= hot_from).select("digest", "first", F.lit(0).cast("long").alias("salt"))
    # documents of hot texts are done, and spread over the tasks of the second join
    salt = F.when(F.col("hot_first").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("doc_id"))
    known = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt)
    known = known.join(rest, ["digest", "salt"], "left")
    repeats = F.coalesce(F.col("doc_id") > F.coalesce("hot_first", "first"), F.lit(False))
    flagged = known.select("part", "doc_id", (F.col("bits") + F.when(repeats, 16).otherwise(0)).alias("bits"), "digest")
    told = scratch.write(
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            (
                F.max(F.when(F.col("quality") == 1, 32).otherwise(0))
                + F.max(F.when(F.col("toxic") == 1, 64).otherwise(0))
            ).alias("label")
        )
        .where("label > 0")
        .withColumn("salt", F.lit(0).cast("long")),
        "labels",
    )
    # documents without an id meet no label; their salt keeps them out of one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    marked = flagged.withColumn("salt", spread).join(maybe_broadcast(told), ["doc_id", "salt"], "left")
    return marked.select("part", "doc_id", (F.col("bits") + F.coalesce("label", F.lit(0))).cast("int").alias("bits"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part and range: the range's sorted ids, and per list the places in it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part, bits = batch.column(0), batch.column(2).to_numpy()
        codes = part.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        ranges = list(zip(cuts, cuts[1:], strict=False))
        columns: list[pa.Array] = [
            part.take(pa.array(cuts[:-1])),
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(1)),
        ]
        for i in range(len(LISTS)):
            places = [np.flatnonzero(bits[low:high] >> i & 1).astype(np.int32) for low, high in ranges]
            columns.append(pa.array(places, pa.list_(pa.int32())))
        yield pa.record_batch(columns, POSTINGS_ARROW)


def postings(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The posting lists, stored: per part and id range the sorted ``ids`` and, per filter and label, the places in them."""
    marked = scratch.write(failures(docs, labels, scratch), "marked")
    # rows that repeat an id can be many: the hash cuts between them
    dealt = marked.repartitionByRange("part", "doc_id", F.xxhash64("bits", "doc_id"))
    return scratch.write(dealt.sortWithinPartitions("part", "doc_id").mapInArrow(_lists, POSTINGS), "postings")


def gallop(hay: np.ndarray, needles: np.ndarray) -> np.ndarray:
    """Place in the sorted ``hay`` of the first entry not below each needle: doubling steps, then halving."""
    low = np.full(len(needles), -1, dtype=np.int64)
    high = np.zeros(len(needles), dtype=np.int64)
    ahead = np.arange(len(needles))
    while len(ahead):
        ahead = ahead[high[ahead] < len(hay)]
        ahead = ahead[hay[high[ahead]] < needles[ahead]]
        low[ahead] = high[ahead]
        high[ahead] = 2 * high[ahead] + 1
    np.minimum(high, len(hay), out=high)
    while len(open_ := np.flatnonzero(high - low > 1)):
        middle = (low[open_] + high[open_]) >> 1
        below = hay[middle] < needles[open_]
        low[open_[below]] = middle[below]
        high[open_[~below]] = middle[~below]
    return high


def _held(hay: np.ndarray, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each needle belongs in ``hay``, and whether it is there."""
    at = gallop(hay, needles)
    there = np.zeros(len(needles), dtype=bool)
    inside = at < len(hay)
    there[inside] = hay[at[inside]] == needles[inside]
    return at, there


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists without repeats: the shorter one gallops through the longer."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    at, there = _held(long, short)
    return np.insert(long, at[~there], short[~there])


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entries of ``a`` that ``b`` lacks."""
    if len(a) <= len(b):
        return a[~_held(b, a)[1]]
    at, there = _held(a, b)
    return np.delete(a, at[there])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return int(_held(long, short)[1].sum())


def audit_range(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, ...]]:
    """For every filter and every set of other filters before it: filter, set, failing, removed, good and toxic removed."""
    n = len(lists)
    unions = [np.empty(0, dtype=np.int64)]
    for chosen in range(1, 1 << n):
        top = chosen.bit_length() - 1
        unions.append(merged(unions[chosen ^ 1 << top], lists[top]))
    for f in range(n):
        for before in range(1 << n):
            if not before >> f & 1:
                gone = without(lists[f], unions[before])
                yield f, before, len(lists[f]), len(gone), shared(gone, good), shared(gone, toxic)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes per filter and set before it, added up over the ranges of a batch."""
    for batch in batches:
        total: dict[tuple, np.ndarray] = {}
        for i in range(batch.num_rows):
            part, rows = batch.column(0)[i].as_py(), len(batch.column(1)[i])
            lists = [batch.column(j)[i].values.to_numpy().astype(np.int64) for j in range(2, 2 + len(LISTS))]
            for f, before, *counts in audit_range(lists[: len(FILTERS)], *lists[len(FILTERS) :]):
                sums = total.setdefault((part, f, before), np.zeros(len(COUNTS), dtype=np.int64))
                sums += (rows, *counts)
        rows_out = [(*key, *map(int, sums)) for key, sums in total.items()]
        columns = list(zip(*rows_out, strict=True)) if rows_out else [[] for _ in SIZES_ARROW]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SIZES_ARROW, strict=True)], SIZES_ARROW)


def _orders(spark: SparkSession) -> DataFrame:
    """``filter_order, step, filter, before, prefix`` for all orders: 600 rows."""
    steps = [
        ("".join(FILTERS[f] for f in order), i + 1, f, sum(1 << g for g in order[:i]))
        for order in permutations(range(len(FILTERS)))
        for i, f in enumerate(order)
    ]
    text = ";".join(f"{name},{step},{f},{before}" for name, step, f, before in steps)
    lines = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("line"))
    cut = lines.select(F.split("line", ",").alias("x"))
    numbers = [F.col("x")[i].cast("int").alias(n) for i, n in enumerate(("step", "filter", "before"), 1)]
    return cut.select(F.col("x")[0].alias("filter_order"), *numbers)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    lists = postings(docs, labels, scratch)
    sizes = scratch.write(
        lists.mapInArrow(_sizes, SIZES).groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in COUNTS]),
        "sizes",
    )
    n = len(FILTERS)
    others = F.bit_count("before")
    # orders in which exactly the filters of ``before`` stand before the filter
    ways = F.get(F.array(*[F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n)]), others)
    alone = F.max(F.when(others == n - 1, F.col("removed"))).alias("unique_fails")
    totals = sizes.groupBy("part", "filter").agg(alone, F.sum(F.col("removed") * ways).alias("shapley"))
    # what a set removes is what its filters remove one after the other, in any order: here by letter
    letters = F.explode(F.array(*[F.lit(f) for f in range(n)]))
    links = (
        spark.range(1, 1 << n)
        .select(F.col("id").cast("int").alias("chosen"), letters.alias("filter"))
        .where(F.expr("chosen & shiftleft(1, filter)") > 0)
        .withColumn("before", F.expr("chosen & (shiftleft(1, filter) - 1)"))
    )
    gone = sizes.join(F.broadcast(links), ["filter", "before"]).groupBy("part", "chosen").agg(F.sum("removed").alias("gone"))
    step = sizes.withColumn("chosen", F.expr("before | shiftleft(1, filter)"))
    known = step.join(gone, ["part", "chosen"]).join(totals, ["part", "filter"])
    return known.join(F.broadcast(_orders(spark)), ["filter", "before"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - F.col("gone")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )
