"""Near-duplicate text (D3): MinHash LSH finds pairs of similar values, exact Jaccard similarity decides them.

Values are compared after ``normalized``: equal values are folded first, so
copies cost one row. A value's shingles (runs of characters) go through
``pyspark.ml.feature.MinHashLSH``; its hashes are cut into bands, and values
that agree on a whole band are candidates. Within a band only values that also
share one of their rarest shingles are paired: of two sets with a Jaccard
similarity of at least ``t``, each has a shingle of the other among its first
``n - ceil(t * n) + 1`` in any common order, so ordering by how often a shingle
occurs loses no pair, and a template shared by very many values, whose
shingles are the frequent ones, pairs none of them. Every pair is then decided
by its exact similarity.

Null values are never flagged. Only rows after the first of a group of similar
rows are flagged, with the first similar row's id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import rules, strategy

NEAR_DUPLICATE = "NEAR_DUPLICATE"
FEATURES = 1 << 20


@dataclass(frozen=True)
class Similarity:
    """Least Jaccard similarity of the ``shingle``-character sets; ``bands`` bands of ``rows`` hashes find the candidates.

    A pair of similarity ``s`` shares a band with probability
    ``1 - (1 - s ** rows) ** bands``: over 0.9999 at 0.8.
    """

    least: float = 0.8
    shingle: int = 3
    bands: int = 20
    rows: int = 3
    seed: int = 17


def normalized(col: Column) -> Column:
    """ASCII letters in lower case, runs of white space as one space, trimmed."""
    lowered = F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, "[ \\t\\n\\r]+", " "))


def shingles(value: Column, n: int) -> Column:
    """The set of runs of ``n`` characters; a shorter value is one shingle."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(value) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, F.lit(n))))


def _banded(sets: DataFrame, how: Similarity) -> DataFrame:
    """``vid, band`` for every value: the hashes of MinHashLSH, ``rows`` at a time."""
    vectors = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="vector").transform(sets)
    lsh = MinHashLSH(inputCol="vector", outputCol="hashes", numHashTables=how.bands * how.rows, seed=how.seed)
    hashed = lsh.fit(vectors).transform(vectors).select("vid", F.col("hashes"))
    flat = hashed.select("vid", *[vector_to_array(F.col("hashes")[i])[0].alias(f"h{i}") for i in range(how.bands * how.rows)])
    bands = [F.xxhash64(F.lit(b), *[f"h{b * how.rows + r}" for r in range(how.rows)]) for b in range(how.bands)]
    return flat.select("vid", F.explode(F.array(*bands)).alias("band"))


def _decided(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("vid").alias("a"), F.col("grams").alias("ga")), "a").join(
        sets.select(F.col("vid").alias("b"), F.col("grams").alias("gb")), "b"
    )
    common = F.size(F.array_intersect("ga", "gb"))
    sizes = both.select("a", "b", common.alias("n"), (F.size("ga") + F.size("gb")).alias("sum"))
    return sizes.where(F.col("n") >= least * (F.col("sum") - F.col("n")) - 1e-9).select("a", "b")


def earliest_similar(values: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``vid, earliest`` for distinct ``vid, value`` rows: the smallest id of a similar value, where it is smaller than ``vid``.

    In a group (one band, one rare shingle) every value meets the smallest
    id first. Where it is similar to that, no other pair of the group can
    give a smaller id, so a crowd of copies costs its size; only the others
    meet the rest of their group.
    """
    sets = strategy.materialize(values.select("vid", shingles(F.col("value"), how.shingle).alias("grams")))
    bands = strategy.materialize(_banded(sets, how))
    members = bands.join(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band")
    # each value's rarest shingles, by occurrences in all values
    grams = sets.select("vid", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = (
        grams.join(often, "gram")
        .groupBy("vid", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("ranked"))
    )
    keep = F.col("n") - F.ceil(F.col("n") * how.least - F.lit(1e-9)).cast("int") + 1
    rare = ranked.select("vid", F.explode(F.slice("ranked", 1, keep)).alias("r")).select("vid", "r.gram")
    keyed = members.join(rare, "vid").select("band", "gram", "vid")
    hubs = keyed.groupBy("band", "gram").agg(F.min("vid").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    grouped = strategy.materialize(keyed.join(hubs, ["band", "gram"]))
    stars = grouped.where("vid > hub").select(F.col("hub").alias("a"), F.col("vid").alias("b")).distinct()
    linked = strategy.materialize(_decided(stars, sets, how.least))
    others = grouped.where("vid > hub").join(
        linked.select(F.col("a").alias("hub"), F.col("b").alias("vid")), ["hub", "vid"], "left_anti"
    )
    pairs = (
        others.select("band", "gram", "hub", F.col("vid").alias("b"))
        .join(grouped.select("band", "gram", F.col("vid").alias("a")), ["band", "gram"])
        .where("a < b and a <> hub")
        .select("a", "b")
        .distinct()
    )
    every = linked.unionByName(_decided(pairs, sets, how.least))
    return every.groupBy(F.col("b").alias("vid")).agg(F.min("a").alias("earliest"))


def flag_similar(df: DataFrame, column: str, row_id: str, how: Similarity = Similarity(), out: str = "similar_to") -> DataFrame:
    """Add ``out``: the smallest ``row_id`` of an earlier row with an equal or similar value, null where there is none."""
    value = normalized(F.col(f"`{column}`").cast("string"))
    keyed = df.withColumn("_value", value)
    firsts = strategy.materialize(
        keyed.where(F.col("_value").isNotNull()).groupBy("_value").agg(F.min(f"`{row_id}`").alias("_first"))
    )
    # a distinct value's first row is its id
    values = firsts.select(F.col("_first").alias("vid"), F.col("_value").alias("value"))
    earliest = earliest_similar(values, how).select(F.col("vid").alias("_first"), F.col("earliest").alias("_earlier"))
    told, small = strategy.small_or_none(
        firsts.join(earliest, "_first", "left").select("_value", F.least("_first", "_earlier").alias("_head"))
    )
    joined = keyed.join(strategy.hint_broadcast(told, small), "_value", "left")
    head = F.when(F.col("_head") < F.col(f"`{row_id}`"), F.col("_head"))
    return joined.withColumn(out, head).drop("_value", "_head")


def warnings(df: DataFrame, column: str, out: str = "similar_to") -> Column:
    """The flagged rows' error entry, of severity WARNING: it is reported and rejects no row."""
    entry = rules.check(F.col(out).isNotNull(), column, F.col(f"`{column}`"), NEAR_DUPLICATE, "Similar to an earlier row", "WARNING")
    return rules.collect_errors([entry])
