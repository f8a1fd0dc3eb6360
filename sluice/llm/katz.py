"""Katz back-off language model over words, trained and evaluated on Spark.

Bigram and unigram counts are discounted by Good-Turing (counts up to 5; by
absolute discounting where the counts of counts are too irregular), and the
mass taken off is given to lower orders by weights that normalise exactly:

    p(w | h) = d(r) r / (c(h) + 1)         if the bigram was seen r > 0 times
             = alpha(h) p(w)               otherwise, for a seen history h
             = p(w)                        for an unseen history
    p(w)     = d(c) c / N for seen words; the rest is the unknown word's

A history keeps one event for what never followed it, so some mass is left
even where all its counts are above the discounted range. alpha(h) is the
left-over mass of h over one minus p of all words seen after h, so every
distribution sums to one over the seen words and the unknown word.

Layout. Texts are turned once into blocks of some megabytes: local word
numbers per token and the words' 64-bit keys. Each block asks for what it
needs by key: distinct keys and its own training counts, dealt out to parts
by key. A part adds up the counts of all blocks and answers each block in the
order it asked. A key occurs once per block, so the commonest word pair weighs
no more than a rare one, and no text or token row is shuffled. Counts, left
over masses and scores are exchanged the same way, and all stored tables are
partitioned by part or block.

Between the steps numbers are bytes, not arrays: the JVM copies them whole,
the few large rows (a block's tokens) are compressed, counts and totals take
the fewest bytes that hold them, and the stored pages and row groups are
small, so an executor holds a few blocks, whatever the size of a file.

Defined results: a null or empty text is the end token alone; a null id is
hashed as an empty string for the training split and is carried; repeated
rows are counted and scored each; very long texts are blocks of their own;
empty tables give empty tables; extra columns are not carried (the result
has the id and the scores), so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, small_batches

BLOCK_BYTES = 8_000_000
PART_TOKENS = 1_000_000
TOP = 5  # counts above are not discounted
END, START = b"\n", b"\n\n"  # no words: words hold no white space
CODEC = pa.Codec("zstd", 3)

BLOCKS = "block long, ids array<long>, train array<boolean>, sizes array<int>, tokens binary, words binary"
ASK = "part long, block long, keys binary, counts binary"
ANSWER = "part long, block long, kind string, values binary, model array<long>"
SCORED = (
    "block long, ids array<long>, train array<boolean>, n_tokens array<long>, n_known array<long>, "
    "base array<double>, score array<double>, missing binary, histories binary, history_counts binary"
)
BOTH = "part long, need boolean, keys binary, p binary, r binary, " + SCORED
# rows are large: without these, a page and a row group hold a hundred of them at least
SMALL_PAGES = {
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size": str(2 * BLOCK_BYTES),
}
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def key_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit keys of ordered pairs of keys, by multiply-and-shift mixing."""
    x = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the (distinct) keys by part and key, and the non-empty parts as (part, from, to) in that order."""
    part = ((keys.view(np.uint64) >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    found, starts = np.unique(part[order], return_index=True)
    ends = [*starts[1:], len(keys)][: len(found)]
    return order, [(int(p), int(a), int(b)) for p, a, b in zip(found, starts, ends, strict=True)]


# --- blocks ---------------------------------------------------------------


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ctx = TaskContext.get()
    number = (ctx.partitionId() if ctx else 0) << 33

    def start():
        return {"ids": [], "train": [], "sizes": [], "tokens": [], "words": {END: 0}, "bytes": 0}

    def finish(b):
        words = np.array([key_of(w) for w in b["words"]], dtype=np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()),
                "ids": pa.array([b["ids"]], pa.list_(pa.int64())),
                "train": pa.array([b["train"]], pa.list_(pa.bool_())),
                "sizes": pa.array([b["sizes"]], pa.list_(pa.int32())),
                "tokens": pa.array([_packed(np.concatenate(b["tokens"]))], pa.binary()),
                "words": pa.array([words.tobytes()], pa.binary()),
            }
        )

    block = start()
    for batch in batches:
        for doc_id, text, train in zip(*(batch.column(c) for c in ("doc_id", "text", "train")), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            known = block["words"]
            tokens = [known.setdefault(w, len(known)) for w in data]
            tokens.append(0)
            block["ids"].append(doc_id.as_py())
            block["train"].append(train.as_py())
            block["sizes"].append(len(tokens))
            block["tokens"].append(np.array(tokens, dtype=np.int32))
            block["bytes"] += sum(map(len, data)) + len(data)
            if block["bytes"] >= BLOCK_BYTES:
                yield finish(block)
                number += 1
                block = start()
    if block["ids"]:
        yield finish(block)


def _list(values: np.ndarray) -> pa.ListArray:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers compressed, by byte planes: the high ones are nearly all zeros."""
    planes = np.ascontiguousarray(values.astype(np.int32, copy=False).view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + (CODEC.compress(planes, asbytes=True) if len(values) else b"")


def _unpacked(data: pa.Buffer) -> np.ndarray:
    size = int.from_bytes(data[:8].to_pybytes(), "little")
    planes = CODEC.decompress(data[8:], 4 * size) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, size).T).view(np.int32).ravel()


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold all of them."""
    top = int(np.abs(values).max(initial=0))
    return values.astype(next(f"<i{w}" for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))).tobytes()


def _widened(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // size}")


def _cut(values: np.ndarray, ends: Iterable[int]) -> pa.Array:
    """A row of bytes for each stretch of 64-bit values up to an end."""
    offsets = np.array([0, *ends], dtype=np.int32) * np.int32(8)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The 64-bit values of all rows."""
    found = [np.empty(0, kind)]
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            if ends[-1] > ends[0]:
                found.append(np.frombuffer(chunk.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])), kind))
    return np.concatenate(found)


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    """The number of 64-bit values of each row."""
    return pa.compute.binary_length(column).to_numpy().astype(np.int64) // 8


class Block:
    """The arrays of one block row."""

    def __init__(self, row: dict):
        self.number = row["block"].as_py()
        self.ids = row["ids"].as_py()
        self.train = np.array(row["train"].as_py(), dtype=bool)
        self.sizes = row["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.tokens = _unpacked(row["tokens"].as_buffer())
        self.words = np.frombuffer(row["words"].as_buffer(), np.int64)
        self.in_train = np.repeat(self.train, self.sizes)

    @classmethod
    def each(cls, batch: pa.RecordBatch) -> Iterator[Block]:
        for i in range(batch.num_rows):
            yield cls({n: batch.column(n)[i] for n in batch.schema.names})

    def _codes(self) -> np.ndarray:
        """At each token, its bigram as one number: of the history (the number of words stands for the start) and word."""
        codes = np.empty(len(self.tokens), dtype=np.int64)
        codes[1:] = self.tokens[:-1]
        codes[np.cumsum(self.sizes) - self.sizes] = len(self.words)
        codes *= len(self.words) + 1
        codes += self.tokens
        return codes

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams: history and word numbers, and the pair's number at each token."""
        code, place = np.unique(self._codes(), return_inverse=True)
        width = len(self.words) + 1
        return code // width, code % width, place.astype(np.int32)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams in the same order, and their counts in training texts."""
        codes = self._codes()
        codes *= 2
        codes += self.in_train
        codes.sort()
        trained = (codes & 1).astype(np.int32)
        codes >>= 1
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        counts = np.add.reduceat(trained, first)
        codes, width = codes[first], len(self.words) + 1
        return codes // width, codes % width, counts

    def history_keys(self) -> np.ndarray:
        return np.append(self.words, np.int64(key_of(START)))


def _ask(keys: np.ndarray, counts: np.ndarray, block: int, parts: int) -> pa.RecordBatch:
    order, bounds = by_part(keys, parts)
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([p for p, _, _ in bounds], pa.int64()),
            "block": pa.array([block] * len(bounds), pa.int64()),
            "keys": _cut(keys[order], (b for _, _, b in bounds)),
            "counts": pa.array([_narrow(counts[order[a:b]]) for _, a, b in bounds], pa.binary()),
        }
    )


def _answer(table: pa.Table, kind: str, keep: bool) -> pa.Table:
    """Totals over all blocks of one part, in the order each block asked; minus signs mark the block that owns a key.

    The owner is the first block that counts a key in training. Rows of block
    -2 hold the part's sums, as ``model``: tokens, types and types seen 1 to
    TOP + 1 times; rows of block -1 and -3 hold its keys and totals, if kept.
    """
    part = table.column("part")[0].as_py()
    table = table.sort_by("block")
    blocks = table.column("block").to_pylist()
    sizes = _sizes(table.column("keys"))
    ends = np.cumsum(sizes)
    keys = _flat(table.column("keys"), np.int64)
    counts = np.empty(len(keys), dtype=np.int64)
    for data, n, end in zip(table.column("counts").to_pylist(), sizes, ends, strict=True):
        counts[end - n : end] = _widened(data, n)
    distinct, place = np.unique(keys, return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(totals, place, counts)
    out = totals[place]
    counted = np.flatnonzero(counts)
    _, first = np.unique(place[counted], return_index=True)
    out[counted[first]] *= -1
    seen = totals[totals > 0]
    stats = [seen.sum(), len(seen), *(np.count_nonzero(seen == r) for r in range(1, TOP + 2))]
    rows = [(b, _narrow(out[e - n : e]), None) for b, n, e in zip(blocks, sizes, ends, strict=True)]
    rows.append((-2, None, [int(x) for x in stats]))
    if keep:
        rows += [(-1, None, distinct[totals > 0]), (-3, None, seen)]
    return pa.table(
        {
            "part": pa.array([part] * len(rows), pa.int64()),
            "block": pa.array([b for b, _, _ in rows], pa.int64()),
            "kind": pa.array([kind] * len(rows), pa.string()),
            "values": pa.array([v for _, v, _ in rows], pa.binary()),
            "model": pa.array([m for _, _, m in rows], pa.list_(pa.int64())),
        }
    )


def _take(answers: pa.Table, kind: str, keys: np.ndarray, parts: int) -> np.ndarray:
    """A block's answers, back in the order of its own keys."""
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("part")
    order, bounds = by_part(keys, parts)
    out = np.empty(len(keys), dtype=np.int64)
    for (_, a, b), data in zip(bounds, mine.column("values").to_pylist(), strict=True):
        out[order[a:b]] = _widened(data, b - a)
    return out


# --- model ----------------------------------------------------------------


@dataclass(frozen=True)
class Discounts:
    """Tokens, types and the discount factors d(1) to d(TOP) of one order."""

    tokens: int
    types: int
    factors: tuple[float, ...]
    left: float  # mass taken off, as tokens

    @classmethod
    def of(cls, stats: list[int]) -> Discounts:
        tokens, types, *n = [int(x) for x in stats]
        return cls(tokens, types, f := good_turing(n), sum(r * c * (1 - d) for r, (c, d) in enumerate(zip(n, f), 1)))

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *(r * d for r, d in enumerate(self.factors, 1))])
        return np.where(counts <= TOP, table[np.minimum(counts, TOP)], counts)


def good_turing(n: list[int]) -> tuple[float, ...]:
    """Discount factors from the counts of counts n[0] = n_1 to n[TOP] = n_(TOP + 1), by Katz's formula.

    Where it has no value or leaves (0, 1), all factors come from absolute
    discounting, with 1/2 off if nothing was seen once or twice.
    """
    if all(n):
        rest = (TOP + 1) * n[TOP] / n[0]
        out = [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if rest != 1 else 0.0 for r in range(1, TOP + 1)]
        if all(0 < d <= 1 for d in out) and min(out) < 1:
            return tuple(out)
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return tuple((r - off) / r for r in range(1, TOP + 1))


@dataclass(frozen=True)
class Model:
    unigrams: Discounts
    bigrams: Discounts
    train_docs: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """p(w) by the word's training count; count 0 is the unknown word's whole mass."""
        n = self.unigrams.tokens
        if not n:
            return np.ones(len(counts))
        # a corpus without rare words keeps one event for the unknown word
        spare = self.unigrams.left or 1.0
        total = n if self.unigrams.left else n + 1
        return np.where(counts > 0, self.unigrams.discounted(counts), spare) / total

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.unigrams.tokens + 0.5 * (self.unigrams.types + 1)))


def _masses(block: Block, answers: pa.Table, model: Model, parts: int) -> tuple[list, dict]:
    """What one block adds to its histories' masses, and its texts scored but for the back-off weights."""
    counts = np.abs(_take(answers, "word", block.words, parts))
    left, right, place = block.pairs()
    keys = block.history_keys()
    signed = _take(answers, "pair", pair_keys(keys[left], block.words[right]), parts)
    owned, r = signed < 0, np.abs(signed)
    history_counts = np.append(counts, model.train_docs)
    p = model.unigram(counts)
    kept = model.bigrams.discounted(r)
    held = np.unique(left[owned])
    # an empty bincount is of integers
    add_p = np.bincount(left[owned], p[right[owned]], len(keys))[held].astype(np.float64)
    add_r = np.bincount(left[owned], kept[owned], len(keys))[held].astype(np.float64)
    # log10 of each pair's term; a back-off pair's weight is added by _finish
    with np.errstate(divide="ignore"):
        term = np.where(r > 0, np.log10(kept / (history_counts[left] + 1)), np.log10(p[right]))
    starts = np.cumsum(block.sizes) - block.sizes
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
    backs_off = (r == 0) & (history_counts[left] > 0)
    token_backs_off = backs_off[place]
    histories, numbered = np.unique(left[place[token_backs_off]], return_inverse=True)
    # per text and history, how often the weight is needed: (text, history number, times) flat
    code, times = np.unique(doc[token_backs_off] * max(1, len(histories)) + numbered, return_counts=True)
    missing = np.stack([code // max(1, len(histories)), code % max(1, len(histories)), times], axis=1)
    scored = {
        "block": block.number,
        "ids": block.ids,
        "train": block.train.tolist(),
        "n_tokens": block.sizes,
        "n_known": np.add.reduceat((counts[block.tokens] > 0).astype(np.int64), starts),
        "base": np.add.reduceat(model.base(counts)[block.tokens], starts),
        "score": np.add.reduceat(term[place], starts),
        "missing": _packed(missing.ravel()),
        "histories": keys[histories].tobytes(),
        "history_counts": history_counts[histories].tobytes(),
    }
    return [(keys[held], add_p, add_r, False), (keys[histories], None, None, True)], scored


def _mass_batch(block: int, masses: list, parts: int) -> Iterator[pa.RecordBatch]:
    for keys, p, r, need in masses:
        order, bounds = by_part(keys, parts)
        ends = [b for _, _, b in bounds]
        none = pa.nulls(len(bounds), pa.binary())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([x for x, _, _ in bounds], pa.int64()),
                "block": pa.array([block] * len(bounds), pa.int64()),
                "need": pa.array([need] * len(bounds), pa.bool_()),
                "keys": _cut(keys[order], ends),
                "p": none if need else _cut(p[order], ends),
                "r": none if need else _cut(r[order], ends),
            }
        )


def _mass_answer(table: pa.Table) -> pa.Table:
    """Per part: the sums of p and of discounted counts after each history, for the blocks that need them."""
    part = table.column("part")[0].as_py()
    given = table.filter(pa.compute.invert(table.column("need")))
    asked = table.filter(table.column("need")).sort_by("block")
    keys, place = np.unique(_flat(given.column("keys"), np.int64), return_inverse=True)
    p = np.bincount(place, _flat(given.column("p"), np.float64), len(keys)).astype(np.float64)
    r = np.bincount(place, _flat(given.column("r"), np.float64), len(keys)).astype(np.float64)
    wanted = np.searchsorted(keys, _flat(asked.column("keys"), np.int64))
    ends = np.cumsum(_sizes(asked.column("keys")))
    return pa.table(
        {
            "part": pa.array([part] * asked.num_rows, pa.int64()),
            "block": asked.column("block").combine_chunks(),
            "p": _cut(p[wanted], ends),
            "r": _cut(r[wanted], ends),
        }
    )


def _finish(state: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """Add the back-off weights to a block's scores and give a row per text."""
    row = {n: state.column(n)[0] for n in state.schema.names}
    ids, train = row["ids"].as_py(), row["train"].as_py()
    values = {n: row[n].values.to_numpy(zero_copy_only=False) for n in ("n_tokens", "n_known", "base", "score")}
    score = values["score"].copy()
    histories = np.frombuffer(row["histories"].as_buffer(), np.int64)
    if len(histories):
        order, _ = by_part(histories, parts)
        answers = answers.sort_by("part")
        p, r = np.empty(len(histories)), np.empty(len(histories))
        p[order] = _flat(answers.column("p"), np.float64)
        r[order] = _flat(answers.column("r"), np.float64)
        counts = np.frombuffer(row["history_counts"].as_buffer(), np.int64)
        weight = np.log10((1 - r / (counts + 1)) / (1 - p))
        text, history, times = _unpacked(row["missing"].as_buffer()).reshape(-1, 3).T
        score += np.bincount(text, weight[history] * times, len(ids))
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array([not t for t in train], pa.bool_()),
            "n_tokens": pa.array(values["n_tokens"]),
            "n_known": pa.array(values["n_known"]),
            "base_score": pa.array(values["base"]),
            "score": pa.array(score),
        }
    )


def _list_row(scored: dict) -> pa.RecordBatch:
    kinds = {"ids": pa.int64(), "train": pa.bool_()}
    out = {"block": pa.array([scored["block"]], pa.int64())}
    for name, values in scored.items():
        if name in kinds:
            out[name] = pa.array([values], pa.list_(kinds[name]))
        elif isinstance(values, bytes):
            out[name] = pa.array([values], pa.binary())
        elif name != "block":
            out[name] = _list(values)
    return pa.RecordBatch.from_pydict(out)


def score(docs: DataFrame, modulus: int = 5, held_out: int = 1, keep_model: str | None = None) -> DataFrame:
    """Train on the documents whose crc32(id) mod ``modulus`` is not ``held_out``; score all documents.

    ``keep_model`` names a folder for the count tables (part, order, keys and
    counts), to be kept beyond the call.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    small_batches(docs)
    split = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (split != held_out).alias("train"))
    blocks = scratch.write(rows.mapInArrow(_make_blocks, BLOCKS), "blocks", options=SMALL_PAGES)
    add = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    trained = F.size(F.filter("train", lambda t: t))
    size = blocks.agg(F.sum(add).alias("tokens"), F.sum(trained).alias("train_docs")).first()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * shuffle, (size["tokens"] or 0) // PART_TOKENS)

    def ask_words(batches):
        for batch in batches:
            for b in Block.each(batch):
                counts = np.bincount(b.tokens[b.in_train], minlength=len(b.words))
                yield _ask(b.words, counts, b.number, parts)

    def ask_pairs(batches):
        for batch in batches:
            for b in Block.each(batch):
                left, right, counts = b.pair_counts()
                yield _ask(pair_keys(b.history_keys()[left], b.words[right]), counts, b.number, parts)

    def answers_to(ask, kind: str) -> DataFrame:
        def answer(table: pa.Table) -> pa.Table:
            return _answer(table, kind, keep_model is not None)

        asked = blocks.mapInArrow(ask, ASK)
        answered = scratch.write(asked.groupBy("part").applyInArrow(answer, ANSWER), kind, options=SMALL_PAGES)
        scratch.release()
        return answered

    def stats(answers: DataFrame) -> Discounts:
        places = range(TOP + 3)
        row = answers.where("block = -2").agg(*[F.sum(F.get("model", F.lit(i))).alias(f"s{i}") for i in places]).first()
        return Discounts.of([row[i] or 0 for i in places])

    words, pairs = answers_to(ask_words, "word"), answers_to(ask_pairs, "pair")
    model = Model(stats(words), stats(pairs), size["train_docs"] or 0)
    if keep_model:
        tables = words.unionByName(pairs).where("block in (-1, -3)")
        field = F.when(F.col("block") == -1, "key").otherwise("count").alias("field")
        tables.select("part", "kind", F.col("model").alias("values"), field).write.mode("error").partitionBy(
            "kind"
        ).parquet(keep_model)

    def masses(left: pa.Table, right: pa.Table) -> pa.Table:
        found, scored = [], []
        for batch in left.to_batches():
            for b in Block.each(batch):
                mass, row = _masses(b, right, model, parts)
                found += _mass_batch(b.number, mass, parts)
                scored.append(_list_row(row))
        return _both(found, scored)

    answers = words.unionByName(pairs).where("block >= 0").drop("model")
    both = scratch.write(
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(masses, BOTH),
        "masses",
        options=SMALL_PAGES,
    )
    for table in (blocks, words, pairs):
        scratch.drop(table)
    scratch.release()
    asked = both.where("part is not null").select("part", "block", "need", "keys", "p", "r")
    mass_answers = asked.groupBy("part").applyInArrow(
        _mass_answer, "part long, block long, p binary, r binary"
    )
    state = both.where("part is null").select(*[c.split()[0] for c in SCORED.split(", ")])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return _finish(left, right, parts)

    done = state.groupBy("block").cogroup(mass_answers.groupBy("block")).applyInArrow(finish, RESULT)
    return done.withColumn("train_tokens", F.lit(model.unigrams.tokens).cast("long"))


def _both(found: list[pa.RecordBatch], scored: list[pa.RecordBatch]) -> pa.Table:
    """Mass rows and scored rows as one table: a scored row has no part."""
    tables = [pa.Table.from_batches([b]) for b in (*found, *scored)]
    merged = pa.concat_tables(tables, promote_options="default")
    return merged.select([c.split()[0] for c in BOTH.split(", ")])
