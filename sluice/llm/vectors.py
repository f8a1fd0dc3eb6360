"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors are projected on random directions. Two vectors collide on a
projection when one lies in the window centred on the other; a pair with
enough collisions is verified by its cosine in double precision. The window
is set from the distance that the wanted cosine allows, and the count from
the binomial law, so that a pair at the threshold passes with probability
0.998 or more (``recall``).

The projections are sorted into cells in tuples of ``width``. A pair that
misses at most ``tuples - 1`` projections collides on a whole tuple, so only
vectors that meet in the window's cells of some tuple are counted: nothing
that passes the count is lost, and each pair is handled in its first such
tuple only. Cells with very many rows are dealt out in tiles. Equal vectors
are folded first; a tile returns one row per vector (links and a spanning
link), never its pairs.

Defined results: vectors that are null, zero or hold null or non-finite
components, and vectors with a null label, link with nothing and form groups
of their own; vectors of different lengths never link; repeated rows link
when valid; empty tables give empty tables; extra columns pass through and
clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, connected_components, fresh, maybe_broadcast

SEED = 20


@dataclass(frozen=True)
class Collisions:
    """``tuples`` tuples of ``width`` projections; windows of ``window`` standard deviations; cells of ``cell`` windows."""

    cosine: float = 0.98
    tuples: int = 3
    width: int = 4
    window: float = 2.4
    cell: float = 4.0
    tile: int = 4000

    @property
    def projections(self) -> int:
        return self.tuples * self.width

    @property
    def needed(self) -> int:
        """Collisions a pair must have: all but ``tuples - 1``."""
        return self.projections - self.tuples + 1

    @property
    def half_window(self) -> float:
        """A normal direction spreads two unit vectors at this cosine by their distance, as standard deviation."""
        return self.window * sqrt(2 - 2 * self.cosine)

    @property
    def recall(self) -> float:
        """Probability that a pair exactly at the threshold has the needed collisions."""
        p = erf(self.window / sqrt(2))
        m = self.projections
        return sum(comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(self.needed, m + 1))


@lru_cache(maxsize=8)
def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, count))


def _cells(frames: Iterator[pd.DataFrame], plan: Collisions) -> Iterator[pd.DataFrame]:
    """Per tuple: a vector's own cell (home) and the other cells that its window touches."""
    size, half = plan.cell * plan.half_window, plan.half_window
    for frame in frames:
        for dim, part in frame.groupby("dim"):
            vectors = np.array(part["vector"].tolist(), dtype=np.float64)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            spots = unit @ directions(int(dim), plan.projections)
            own = np.floor(spots / size).astype(np.int64)
            low, high = (np.floor((spots + s) / size).astype(np.int64) for s in (-half, half))
            packed = [v.astype("<f4").tobytes() for v in vectors]
            rows: list[tuple] = []
            for i, (rid, label, copies) in enumerate(zip(part["rid"], part["label"], part["copies"], strict=True)):
                for t in range(plan.tuples):
                    span = range(t * plan.width, (t + 1) * plan.width)
                    home = tuple(own[i, j] for j in span)
                    for cell in product(*(range(low[i, j], high[i, j] + 1) for j in span)):
                        rows.append((label, dim, t, ",".join(map(str, cell)), cell == home, rid, copies, packed[i]))
            yield pd.DataFrame(rows, columns=["label", "dim", "t", "cell", "home", "rid", "copies", "vector"])


CELL_SCHEMA = "label long, dim int, t int, cell string, home boolean, rid long, copies long, vector binary"


def _tile_links(tile: pd.DataFrame, plan: Collisions) -> pd.DataFrame:
    """Links found in one tile: per vector the rows it links to and the smallest vector joined to it here."""
    nothing = pd.DataFrame({"rid": [], "root": [], "links": []}).astype("int64")
    dim, t = int(tile["dim"].iloc[0]), int(tile["t"].iloc[0])
    home = tile["home"].to_numpy()
    if len(tile) < 2 or not home.any():
        return nothing
    vectors = np.frombuffer(b"".join(tile["vector"]), dtype="<f4").reshape(len(tile), dim).astype(np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    spots = (unit @ directions(dim, plan.projections)).astype(np.float32)
    rid, copies = tile["rid"].to_numpy(), tile["copies"].to_numpy()
    half = np.float32(plan.half_window + 1e-5)
    homes = np.flatnonzero(home)
    # queries in the order of one projection, so that a window is a slice
    lead = t * plan.width
    windows = np.flatnonzero(tile["window"].to_numpy())
    order = windows[np.argsort(spots[windows, lead], kind="stable")]
    sorted_lead = spots[order, lead]
    starts = np.searchsorted(sorted_lead, spots[homes, lead] - half, "left")
    ends = np.searchsorted(sorted_lead, spots[homes, lead] + half, "right")
    links: dict[int, int] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for h, start, end in zip(homes, starts, ends, strict=True):
        others = order[start:end]
        others = others[rid[others] > rid[h]]
        for j in range(lead + 1, lead + plan.width):
            if not len(others):
                break
            others = others[np.abs(spots[others, j] - spots[h, j]) <= half]
        if not len(others):
            continue
        hit = np.abs(spots[others] - spots[h]) <= half
        whole = hit.reshape(len(others), plan.tuples, plan.width).all(axis=2)
        # counted here only if no earlier tuple holds the pair
        others = others[(hit.sum(axis=1) >= plan.needed) & (whole.argmax(axis=1) == t)]
        others = others[unit[others] @ unit[h] >= plan.cosine]
        for o in others:
            a, b = int(rid[h]), int(rid[o])
            links[a] = links.get(a, 0) + int(copies[o])
            links[b] = links.get(b, 0) + int(copies[h])
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    if not links:
        return nothing
    return pd.DataFrame([(a, root(a), n) for a, n in links.items()], columns=["rid", "root", "links"])


def tiles(cells: DataFrame, scratch: Scratch, plan: Collisions) -> DataFrame:
    """Deal each cell with more than ``tile`` rows out to tiles of home part by window part."""
    key = ["label", "dim", "t", "cell"]
    counts = cells.groupBy(*key).agg(F.count("*").alias("rows"))
    busy = scratch.write(
        counts.where(F.col("rows") > plan.tile).withColumn(
            "parts", F.ceil(F.col("rows") / plan.tile).cast("int")
        ),
        "busy",
    )
    parts = F.coalesce(F.col("parts"), F.lit(1))
    mine = F.pmod(F.xxhash64("rid"), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    joined = cells.join(maybe_broadcast(busy.select(*key, "parts")), key, "left")
    # a home row goes to all tiles of its row, a window row to all tiles of its column; a home row is both
    others = [c for c in cells.columns if c != "home"]
    whole = joined.where(parts == 1).select(
        *cells.columns, F.lit(True).alias("window"), F.lit(0).alias("i"), F.lit(0).alias("j")
    )
    as_home = joined.where((parts > 1) & F.col("home")).select(
        *cells.columns, F.lit(False).alias("window"), mine.alias("i"), F.explode(every).alias("j")
    )
    as_window = joined.where(parts > 1).select(
        *others,
        F.lit(False).alias("home"),
        F.lit(True).alias("window"),
        F.explode(every).alias("i"),
        mine.alias("j"),
    )
    return whole.unionByName(as_home).unionByName(as_window)


def group(
    table: DataFrame, vector: str = "embedding", plan: Collisions = Collisions(), carry: list[str] | None = None
) -> DataFrame:
    """Every row with ``n_links``, ``component_id`` (smallest ``vec_id`` reachable) and ``kept``."""
    scratch = Scratch(table.sparkSession, "vectors")
    names = [c for c in (table.columns if carry is None else carry) if c not in ("n_links", "component_id", "kept")]
    values = F.col(vector).cast("array<double>")
    usable = (
        F.col("label").isNotNull()
        & (F.size(vector) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    shape = [F.col("label").cast("long").alias("label"), F.col(vector).cast("array<float>").alias("vector")]
    reps = scratch.write(
        table.where(F.coalesce(usable, F.lit(False)))
        .select("vec_id", *shape)
        .groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("lowest"))
        .select(F.monotonically_increasing_id().alias("rid"), F.size("vector").alias("dim"), "*"),
        "reps",
    )

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _cells(frames, plan)

    def to_links(tile: pd.DataFrame) -> pd.DataFrame:
        return _tile_links(tile, plan)

    cells = scratch.write(
        reps.select("rid", "label", "dim", "copies", "vector").mapInPandas(to_cells, CELL_SCHEMA), "cells"
    )
    found = scratch.write(
        tiles(cells, scratch, plan)
        .groupBy("label", "dim", "t", "cell", "i", "j")
        .applyInPandas(to_links, "rid long, root long, links long"),
        "links",
    )
    scratch.drop(cells)
    sums = found.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), scratch)
    named = scratch.write(
        reps.select("rid", "copies", "lowest")
        .join(sums, "rid", "left")
        .join(joined.withColumnRenamed("node", "rid"), "rid", "left")
        .select(
            "rid",
            F.coalesce("component", "rid").alias("component"),
            "lowest",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "named",
    )
    smallest = scratch.write(named.groupBy("component").agg(F.min("lowest").alias("component_id")), "smallest")
    # wide vectors are needed once more only to hand the result to their copies
    result = scratch.write(
        named.join(smallest, "component")
        .select("rid", "n_links", "component_id")
        .join(reps.select("rid", F.col("label").alias("_l"), F.col("vector").alias("_v")), "rid")
        .drop("rid"),
        "result",
    )
    held = [fresh(c, names) for c in ("_label", "_vector")]
    rows = table.select(
        *names,
        F.when(usable, shape[0]).alias(held[0]),
        F.when(usable, shape[1]).alias(held[1]),
        F.col("vec_id").alias(fresh("_id", names)),
    )
    out = rows.join(result, (F.col(held[0]) == F.col("_l")) & (F.col(held[1]) == F.col("_v")), "left")
    own = F.col(fresh("_id", names))
    component = F.when(F.col("_l").isNull(), own).otherwise(F.col("component_id"))
    return out.select(
        *names,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        own.eqNullSafe(component).alias("kept"),
    )
