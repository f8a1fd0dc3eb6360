"""Fuzzy line deduplication over a whole corpus.

Lines are compared in lower case and trimmed. Equal lines are folded first.
A distinct line's signature holds minima of the hashes of all its character
shingles, one per bin of equal width (one-permutation MinHash; an empty bin
takes the minimum of another, drawn in the bin's own random order), by one
rule for all lines, so the bands see the similarity that is verified. The signature is cut into bands. Lines that share a band are
compared by the exact Jaccard similarity of all their shingles: every line of
a band with its hub (the line with most copies) first, and after a first
union-find all pairs of a band whose ends are still apart, each in the first
band that it shares. So a band of near copies costs its size, and no pair that
shares a band is left undecided; a band of many lines that are alike but not
similar enough costs its pairs. Union-find over the links names the
components; the first line of each, by document id and line number, stays.

All steps are DataFrame operations. A line's hashes are sorted together with
the starts of the bins, so that a bin's minimum stands behind its start.

Hashes are 64-bit. Defined results: blank lines are never compared and always
stay; a null or empty text has no lines to compare; lines shorter than a
shingle are one shingle; very long lines and texts are read whole; a null id
ranks last; rows that repeat an id have the same places, and each keeps a
line whose place is first; empty tables give empty tables; extra columns pass
through.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACES, Scratch, connected_components, fresh, let, maybe_broadcast, text_of

SEED = 7

# 64-bit words of a line's map of shingles
WORDS = 32


@dataclass(frozen=True)
class LinePlan:
    """Similarity and shape: shingles of ``shingle`` characters, ``bands`` bands of ``rows`` minima.

    A pair shares a band with probability 1 - (1 - s ** rows) ** bands, s
    being its exact similarity: 0.99 at 0.8.
    """

    similarity: float = 0.8
    shingle: int = 8
    bands: int = 12
    rows: int = 5

    def starts(self) -> list[int]:
        """Where each minimum's bin of 64-bit hashes starts: even numbers."""
        n = self.bands * self.rows
        return [-(1 << 63) + (i << 63) // n * 2 for i in range(n)]

    def orders(self) -> list[list[int]]:
        """Per bin itself, then all bins in random order."""
        rng, n = random.Random(SEED), self.bands * self.rows
        return [[i, *rng.sample(range(n), n)] for i in range(n)]


def lines_of(docs: DataFrame) -> DataFrame:
    """``row, doc_id, line_no, line, key`` for every line that is not blank; ``row`` tells rows with other ids or texts apart."""
    # hashed below the explode, or every line would hash its whole text anew
    rows = docs.select(
        F.xxhash64("doc_id", "text").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.split(text_of(F.col("text")), "\n").alias("raws"),
    )
    # the filter looks at the line's start only, and need not make the line a second time; a split is never empty, and
    # the outer explode keeps Spark from splitting every text once more to see whether it is
    cut = rows.select("row", "doc_id", F.posexplode_outer("raws").alias("line_no", "raw")).where(
        F.ltrim("raw", F.lit(SPACES)) != ""
    )
    # a trim walks the whole line, and most lines have nothing to trim
    raw = F.col("raw")
    spaced = reduce(or_, [end(F.lit(x)) for x in SPACES for end in (raw.startswith, raw.endswith)])
    line = F.lower(F.when(spaced, F.btrim(raw, F.lit(SPACES))).otherwise(raw))
    return cut.select("row", "doc_id", "line_no", line.alias("line")).withColumn("key", F.xxhash64("line"))


def _codes(line: Column) -> Column:
    """Four bytes per character, so that a shingle is a fixed slice at any place."""
    return F.encode(line, "UTF-32")


def _ordered(line: Column, plan: LinePlan) -> Column:
    """Odd hashes of all shingles, sorted together with the even numbers where bins start."""
    last = F.greatest(F.length(line) - plan.shingle, F.lit(0))
    hashes = let(
        _codes(line),
        lambda codes: F.transform(
            F.sequence(F.lit(1), last * 4 + 1, F.lit(4)),
            lambda at: F.xxhash64(F.substring(codes, at, F.lit(plan.shingle * 4))).bitwiseOR(F.lit(1)),
        ),
    )
    return F.sort_array(F.concat(hashes, F.lit(plan.starts())))


def _odd(number: Column) -> Column:
    return number.bitwiseAND(F.lit(1)) == 1


def _behind(ordered: Column) -> Column:
    """Per bin what stands behind its start: its smallest hash, or, in an empty bin, the next start or nothing."""
    return F.filter(ordered, lambda _, i: ~_odd(F.get(ordered, i - 1)))


def _filled(behind: Column, plan: LinePlan) -> Column:
    """The bins' minima; an empty bin takes that of the first bin that has one, in the bin's own random order."""

    def minima(bins: Column) -> Column:
        def minimum(order: Column) -> Column:
            # most bins are met at once, and only the others need the search
            soon = [F.get(bins, F.get(order, F.lit(i))) for i in range(4)]
            full = F.filter(order, lambda i: F.get(bins, i).isNotNull())
            return F.coalesce(*soon, F.get(bins, F.get(full, F.lit(0))))

        return F.transform(F.lit(plan.orders()), minimum)

    # a line without an empty bin has its minima already
    full = (F.size(behind) == plan.bands * plan.rows) & F.forall(behind, _odd)
    return F.when(full, behind).otherwise(let(F.transform(behind, lambda x: F.when(_odd(x), x)), minima))


def signatures(lines: DataFrame, plan: LinePlan) -> DataFrame:
    """``key, line, copies, bands`` per distinct line. The lines move once, folded; all else happens where they land."""
    distinct = lines.groupBy("key", "line").agg(F.count("*").alias("copies"))
    ordered = distinct.select("key", "line", "copies", _ordered(F.col("line"), plan).alias("ordered"))
    bins = ordered.select("key", "line", "copies", _behind(F.col("ordered")).alias("bins"))
    minima = bins.select("key", "line", "copies", _filled(F.col("bins"), plan).alias("minima"))
    # the place of the band is part of its hash
    bands = [
        F.xxhash64(F.lit(b), *[F.get("minima", F.lit(b * plan.rows + r)) for r in range(plan.rows)]) for b in range(plan.bands)
    ]
    return minima.select("key", "line", "copies", F.array(*bands).alias("bands"))


def _shingles(line: Column, plan: LinePlan) -> Column:
    """Hashes of all shingles, each once."""
    last = F.greatest(F.length(line) - plan.shingle, F.lit(0))
    return let(
        _codes(line),
        lambda codes: F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda at: F.xxhash64(F.substring(codes, at * 4 + F.lit(1), F.lit(plan.shingle * 4))),
            )
        ),
    )


def _scored(pairs: DataFrame, signed: DataFrame, scratch: Scratch, plan: LinePlan) -> DataFrame:
    """``a, b, similarity``: exact Jaccard similarity of the sets of all shingles of each pair's lines."""

    def side(table: DataFrame, column: str, name: str) -> DataFrame:
        return table.select(F.col("key").alias(name), F.col(column).alias(f"{column}_{name}"))

    pairs = scratch.write(pairs.select("a", "b").distinct(), "pairs")
    keys = scratch.write(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "keys")
    texts = scratch.write(
        signed.select("key", "line").join(maybe_broadcast(keys), "key", "left_semi"), "texts"
    )
    both = pairs.join(side(texts, "line", "a"), "a").join(side(texts, "line", "b"), "b")
    sets = both.select("a", "b", _shingles(F.col("line_a"), plan).alias("sa"), _shingles(F.col("line_b"), plan).alias("sb"))
    sizes = sets.select(
        "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n")
    )
    scored = scratch.write(
        sizes.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("similarity")), "scored"
    )
    for table in (pairs, keys, texts):
        scratch.drop(table)
    return scored


def components(signed: DataFrame, scratch: Scratch, plan: LinePlan) -> DataFrame:
    """``node, component`` for every distinct line that is linked to another."""
    met = scratch.write(
        signed.select("key", F.explode("bands").alias("band"))
        .groupBy("band")
        .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        .where("n > 1"),
        "met",
    )
    scratch.release()
    couples = met.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    crowds = scratch.write(met.where("n > 2").select("band"), "crowds")
    bands = signed.select("key", "copies", F.explode("bands").alias("band"))
    members = scratch.write(bands.join(maybe_broadcast(crowds), "band"), "members")
    # the hub is the line with most copies: variants of a line lie closer to it than to each other
    rank = F.shiftleft(F.least("copies", F.lit((1 << 31) - 1)), 32).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64("key", "band"), 32)
    )
    hubs = scratch.write(members.groupBy("band").agg(F.max_by("key", rank).alias("hub")), "hubs")
    crowded = members.select("band", "key").join(maybe_broadcast(hubs), "band")
    pair = [F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")]
    stars = crowded.where("key <> hub").select(*pair)
    scored = _scored(couples.unionByName(stars), signed, scratch, plan)
    scratch.release()
    alike = F.col("similarity") >= plan.similarity - 1e-12
    found = scratch.write(connected_components(scored.where(alike), scratch), "found")
    # every line of a crowd with its distance from the hub, and whether the star joined the two
    placed = crowded.select("band", "key", "hub", *pair).join(scored, ["a", "b"], "left")
    placed = placed.select("band", "key", "hub", (1 - F.coalesce("similarity", F.lit(1.0))).alias("distance"))
    named = scratch.write(
        placed.join(found, placed["key"] == found["node"], "left").select(
            "band", "key", "hub", "distance", F.coalesce("component", "key").alias("component")
        ),
        "named",
    )
    scratch.drop(scored)
    mains = scratch.write(named.where("key = hub").select("band", F.col("component").alias("main")), "mains")
    outside = scratch.write(
        named.join(maybe_broadcast(mains), "band")
        .where("component <> main")
        .select("band", F.col("key").alias("a"), F.col("component").alias("ca"), F.col("distance").alias("da")),
        "outside",
    )
    asked = scratch.write(outside.select("band").distinct(), "asked")
    others = scratch.write(
        named.where("key <> hub")
        .join(maybe_broadcast(asked), "band")
        .join(maybe_broadcast(mains), "band")
        .select(
            "band",
            F.col("key").alias("b"),
            F.col("component").alias("cb"),
            F.col("distance").alias("db"),
            (F.col("component") != F.col("main")).alias("asks"),
        ),
        "others",
    )
    maps = scratch.write(_bitmaps(signed, others.select(F.col("b").alias("key")).distinct(), plan), "maps")

    def mapped(table: DataFrame, side: str) -> DataFrame:
        named_maps = maps.select(
            F.col("key").alias(side),
            F.col("n").alias(f"n{side}"),
            F.col("bands").alias(f"bands_{side}"),
            *[F.col(f"w{i}").alias(f"{side}{i}") for i in range(WORDS)],
        )
        return table.join(named_maps, side)

    # one minus the similarity is a metric: lines whose distances from the hub differ by more than the bound are
    # further apart than the bound
    within = F.abs(F.col("da") - F.col("db")) <= 1 - plan.similarity + 1e-9
    # each bit that only one line sets is a shingle that only it has
    own = {x: sum((F.bit_count(F.expr(f"{x}{i} & ~{y}{i}")) for i in range(1, WORDS)), F.bit_count(F.expr(f"{x}0 & ~{y}0"))) for x, y in ("ab", "ba")}
    common = F.least(F.col("na") - own["a"], F.col("nb") - own["b"])
    enough = common >= plan.similarity / (1 + plan.similarity) * (F.col("na") + F.col("nb")) - 1e-9
    # two lines that are both apart from the hub meet once, and in the first band that they share: where that is
    # another band than this one, it holds them as a couple, as a star or as two lines apart, and decides them there
    same = [F.when(F.col("bands_a")[i] == F.col("bands_b")[i], F.col("bands_a")[i]) for i in range(plan.bands)]
    once = (~F.col("asks") | (F.col("a") < F.col("b"))) & (F.col("band") == F.coalesce(*same))
    left, right = mapped(outside, "a"), mapped(others, "b").withColumnRenamed("band", "other_band")
    apart = left.join(right, (F.col("band") == F.col("other_band")) & (F.col("ca") != F.col("cb")) & once & within & enough)
    rest = _scored(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), signed, scratch, plan)
    more = rest.where(alike).select("a", "b")
    for table in (met, crowds, members, hubs, named, mains, outside, asked, others, maps):
        scratch.drop(table)
    if more.isEmpty():
        return found
    # the components so far stand for their links
    joined = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return connected_components(joined.unionByName(more), scratch)


def _bitmaps(signed: DataFrame, keys: DataFrame, plan: LinePlan) -> DataFrame:
    """``key, bands, n, w0..`` per line: its bands, its number of shingles, and a map with the bit of every shingle's hash set."""
    texts = signed.select("key", "line").join(maybe_broadcast(keys), "key", "left_semi")
    grams = texts.select("key", F.explode(_shingles(F.col("line"), plan)).alias("gram"))
    slot = F.pmod("gram", F.lit(64 * WORDS)).cast("int")
    bits = grams.select("key", slot.alias("slot")).select(
        "key", F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("bit")
    )
    words = [F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
    # the bands of these lines only: the join would move those of all lines
    bands = signed.select("key", "bands").join(maybe_broadcast(keys), "key", "left_semi")
    return bits.groupBy("key").agg(F.count("*").alias("n"), *words).join(bands, "key")


def verdicts(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """Every line that is not blank: ``row, doc_id, line_no, key, first_doc, first_line, kept``.

    ``first_doc, first_line`` is the place of the line that stays for it.
    The places of all lines and the distinct lines are stored; no step
    stores or moves the copies of a line's text.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    places = scratch.write(lines_of(docs).drop("line"), "places")
    signed = scratch.write(signatures(lines_of(docs).select("key", "line"), plan), "signed")
    scratch.release()
    linked = components(signed, scratch, plan)
    repeated = signed.where("copies > 1").select("key").distinct()
    roots = scratch.write(
        repeated.join(linked.withColumnRenamed("node", "key"), "key", "full_outer").select(
            "key", F.coalesce("component", "key").alias("root")
        ),
        "roots",
    )
    n = roots.count()
    # document id and line number as one ordered number, which hash aggregation can update in place
    place = (
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
        + F.col("line_no").cast("decimal(10,0)")
    ).cast("decimal(38,0)")
    ranked = scratch.write(
        places.join(maybe_broadcast(roots, n), "key").select("root", place.alias("place")), "ranked"
    )
    firsts = scratch.write(ranked.groupBy("root").agg(F.min("place").alias("first")), "firsts")
    heads = scratch.write(roots.join(firsts, "root").select("key", "first"), "heads")
    out = places.join(maybe_broadcast(heads, n), "key", "left").withColumn("place", place)
    first = F.coalesce("first", "place")
    base = F.lit(1 << 31).cast("decimal(38,0)")
    return out.select(
        "row",
        "doc_id",
        "line_no",
        "key",
        F.floor(first / base).cast("long").alias("first_doc"),
        (first % base).cast("int").alias("first_line"),
        (F.col("place") == first).alias("kept"),
    )


def dedup(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """Documents without the lines seen before; a document left without any line goes, as a copy of others.

    ``text`` and, if there, ``n_chars`` are changed; all else passes through.
    """
    gone = (
        verdicts(docs, plan).where("not kept").groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    )
    names = docs.columns
    row, key = fresh("row", names), fresh("row_key", names)
    drop = fresh("gone", names)
    cut = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(
        gone.select(F.col("row").alias(key), F.col("gone").alias(drop)), F.col(row) == F.col(key), "left"
    )
    lines = F.split(F.col("text"), "\n")

    def rest(all_lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(drop))
        return F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")

    out = cut.withColumn("text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(let(lines, rest)))
    out = out.where(F.col(drop).isNull() | (F.btrim("text", F.lit(SPACES)) != ""))
    if "n_chars" in names:
        out = out.withColumn(
            "n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
        )
    return out.select(*names)
