"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint is the 64-bit majority of the XXH64 hashes of its
word shingles. Two fingerprints within ``2 * half`` bits share a value within
``half`` bits of both, so every distinct fingerprint emits all values within
``half`` bits (65 for ``half = 1``); fingerprints meet on equal values. At
most 65 distinct fingerprints can meet on one value, so groups are bounded
whatever the data. All of a group lie within the radius of each other, so
linking each to the smallest, verified by its bit distance, loses no
component. Copies share a fingerprint and are folded before the shuffle.

Defined results: a null or wordless text has fingerprint zero and links like
any other; a null id is never the smallest id of a group unless all ids are
null; repeated rows have the same fingerprint and group; empty tables give
empty tables; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, connected_components, fresh, maybe_broadcast, small_batches

SEED = 42
CHUNK = 1 << 16
ROWS_PER_TASK = 20_000


def fingerprint_of(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned fingerprint of one text; shingles are hashed in chunks, so a very long text needs bounded memory."""
    # bytes.lower() folds A-Z only and bytes.split() splits on ASCII white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array(
            [
                xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words]), SEED)
                for i in range(at, min(n, at + CHUNK))
            ],
            dtype=">u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprint(docs: DataFrame, out: str = "fingerprint", shingle_words: int = 3) -> DataFrame:
    """Add the fingerprint of ``text`` as a signed 64-bit column (the same bits)."""

    small_batches(docs)

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_signed(fingerprint_of(t, shingle_words)) for t in texts], dtype="int64")

    return docs.withColumn(out, fingerprints(F.col("text")))


def ball(half: int = 1) -> list[int]:
    """Masks of all values within ``half`` bits, as signed 64-bit numbers."""
    return [_signed(sum(1 << b for b in bits)) for k in range(half + 1) for bits in combinations(range(64), k)]


def links(fingerprints: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` whose components are those of all distinct ``fp`` pairs within ``radius`` bits (an even number)."""
    if radius % 2:
        raise ValueError("the radius is split in two equal halves and must be even")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    # fingerprints are few bytes, so a scan has few tasks; each row becomes 65
    spread = fingerprints.select("fp").repartition(max(1, fingerprints.count() // ROWS_PER_TASK + 1), "fp")
    variants = spread.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    # most variants have one fingerprint: only the others are looked at again
    met = scratch.write(
        variants.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").select("variant", "a"),
        "met",
    )
    scratch.release()
    members = variants.join(maybe_broadcast(met), "variant").where("fp <> a")
    pairs = members.select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(prints: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """``fp, group`` for every distinct value of the column ``fp``; the group is named by its smallest fingerprint."""
    distinct = scratch.write(prints.select("fp").distinct(), "prints")
    found = connected_components(links(distinct, scratch, radius), scratch)
    return (
        distinct.join(found, distinct["fp"] == found["node"], "left")
        .select("fp", F.coalesce("component", "fp").alias("group"))
    )


def group(
    docs: DataFrame, shingle_words: int = 3, radius: int = 2, carry: list[str] | None = None
) -> DataFrame:
    """Every document with ``fingerprint`` (signed) and ``component_id``, the smallest id of its group.

    ``carry`` names the input columns to return (default all). The rows are
    stored with their fingerprint once; only fingerprints and ids are
    shuffled after that.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("fingerprint", "component_id")]
    fp, key = fresh("fp", names), fresh("_fp", names)
    stored = scratch.write(with_fingerprint(docs, fp, shingle_words).select(*names, fp), "docs")
    groups = components(stored.select(F.col(fp).alias("fp")), scratch, radius)
    lowest = stored.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("lowest"))
    named = scratch.write(groups.join(lowest, "fp"), "groups")
    of_group = scratch.write(named.groupBy("group").agg(F.min("lowest").alias("component_id")), "ids")
    by_print = scratch.write(
        named.join(of_group, "group").select(F.col("fp").alias(key), "component_id"), "by_print"
    )
    return stored.join(by_print, stored[fp] == by_print[key]).drop(key).withColumnRenamed(fp, "fingerprint")


def keep_one(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """The documents that stay: one of each group, the one with the smallest id (of repeated ids, one row).

    Stored rows carry a number of their own, so that a repeated or null id
    still leaves exactly one row.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    taken = docs.columns
    fp, rid = fresh("fp", taken), fresh("rid", taken)
    stored = scratch.write(
        with_fingerprint(docs, fp, shingle_words).withColumn(rid, F.monotonically_increasing_id()), "docs"
    )
    # of each fingerprint: the smallest id, then the smallest row number holding it
    slim = stored.select(F.col(fp).alias("fp"), F.col("doc_id").alias("id"), F.col(rid).alias("rid"))
    lowest = scratch.write(slim.groupBy("fp").agg(F.min("id").alias("id")), "lowest")
    groups = components(lowest, scratch, radius)
    named = scratch.write(groups.join(lowest, "fp"), "groups")
    first = scratch.write(named.groupBy("group").agg(F.min("id").alias("first_id")), "first")
    best = scratch.write(
        named.join(first, "group")
        .where(F.col("id").eqNullSafe(F.col("first_id")))
        .select("fp", "group", F.col("first_id").alias("id")),
        "best",
    )
    rows = slim.join(best.withColumnsRenamed({"fp": "best_fp", "id": "best_id"}), F.col("fp") == F.col("best_fp"))
    keep = rows.where(F.col("id").eqNullSafe(F.col("best_id"))).groupBy("group").agg(F.min("rid").alias("keep_rid"))
    keep = scratch.write(keep.select("keep_rid"), "keep")
    # whole documents do not move while the list of those that stay is small
    return stored.join(maybe_broadcast(keep), stored[rid] == keep["keep_rid"], "left_semi").select(*taken)
