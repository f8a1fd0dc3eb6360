"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string, every prefix has exactly one valid last token: the token
that ends it in the prefix's own encoding. A token fits as the last one when
the rest's last token and it stay apart under the merge ranks, so the table
of last tokens grows one byte at a time and the whole encoding is read off
backwards. Appending bytes extends the table; editing keeps the table before
the edit and recomputes from there.

``encode`` and ``decode`` add columns to a DataFrame. Text is first split by
the vocabulary's pattern, each match is encoded by itself, and the table of a
match is looked up in a bounded cache of matches seen by the worker.

Defined results: a null or empty text has no ids and decodes to no bytes;
very long texts and matches are encoded whole; repeated rows give the same
ids; empty tables give empty tables; extra columns pass through and clashing
ones are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import small_batches

CACHE_MATCHES = 300_000
SLICE_CHARS = 4_000_000
RUN_BYTES = 64
NEVER = 1 << 30
START = -1  # stands before the first token and fits any


class Ranks:
    """A rank vocabulary (token bytes to id, the id being the merge rank) with its derived merge trees."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.length_of = {i: len(t) for t, i in ranks.items()} | {START: 0}
        self.known: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[bytes, int]]] = {}
        self._left: dict[int, list[tuple[bytes, int]]] = {}

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def merge_plainly(self, data: bytes) -> list[int]:
        """Encoding by the definition: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte or a token that no merge makes."""
        if token not in self._halves:
            data = self.bytes_of[token]
            found = None
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
                    rank = self.ranks.get(parts[best] + parts[best + 1], NEVER)
                    if rank >= token:
                        break
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                if len(parts) == 2:
                    found = (self.ranks[parts[0]], self.ranks[parts[1]])
            self._halves[token] = found
        return self._halves[token]

    def _spine(self, token: int, side: int, memo: dict) -> list[tuple[bytes, int]]:
        """The nodes on one edge of a token's merge tree, with the rank of the merge that uses each up."""
        if token not in memo:
            out, node, until = [], token, NEVER
            while True:
                out.append((self.bytes_of[node], until))
                pair = self.halves(node)
                if pair is None:
                    break
                node, until = pair[side], node
            memo[token] = out
        return memo[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, put together, are encoded as just these two tokens.

        Only a merge across the border can break them. It happens if its two
        nodes lie on the facing edges of the merge trees and its rank comes
        before both nodes are used up inside their own token; at equal rank
        the pair further left goes first. A token that no merge makes never fits.
        """
        fits = left == START or not any(
            rank < a_until and rank <= b_until
            for a, a_until in self._spine(left, 1, self._right)
            for b, b_until in self._spine(right, 0, self._left)
            if (rank := self.ranks.get(a + b, NEVER)) < NEVER
        )
        fits = fits and (self.length_of[right] == 1 or self.halves(right) is not None)
        if len(self.known) >= 4 * CACHE_MATCHES:
            self.known.clear()
        self.known[left << 32 | right] = fits
        return fits


class PrefixTable:
    """The last token of every prefix of a byte string, with exact appends and edits."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data = ranks, b""
        self.last: list[int] = [START]  # last[i]: last token of the prefix of i bytes
        self._runs: list[tuple[int, ...]] = [()]  # the tokens of the first prefixes, read off once
        self.become(data)

    def become(self, data: bytes) -> tuple[int, ...]:
        """Hold ``data`` instead, keeping the entries of the prefix that both have; returns its tokens."""
        same = 0
        for a, b in zip(self.data, data):
            if a != b:
                break
            same += 1
        last, runs, table = self.last, self._runs, self.ranks
        del last[same + 1 :], runs[same + 1 :]
        self.data = data
        token_of, known = table.ranks.get, table.known.get
        length = table.length_of[last[-1]]
        for end in range(same + 1, len(data) + 1):
            # mostly the last token grows by the new byte or a shorter one takes its place
            longest = length = length + 1 if length < end else end
            while length:
                token = token_of(data[end - length : end])
                if token is not None:
                    before = last[end - length]
                    fits = known(before << 32 | token)
                    if fits or (fits is None and table.apart(before, token)):
                        break
                length -= 1
            else:
                token, length = self._longer(end, longest)
            last.append(token)
            if end <= RUN_BYTES:
                runs.append((*runs[end - length], token))
        return runs[-1] if len(data) <= RUN_BYTES else tuple(self.tokens())

    def _longer(self, end: int, than: int) -> tuple[int, int]:
        """The last token where it is longer than the one before by more than the new byte."""
        for length in range(than + 1, min(end, self.ranks.longest) + 1):
            token = self.ranks.ranks.get(self.data[end - length : end])
            if token is not None and self.ranks.apart(self.last[end - length], token):
                return token, length
        raise ValueError("the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        self.become(self.data + more)

    def edit(self, start: int, end: int, replacement: bytes) -> None:
        """Replace bytes ``start`` to ``end``; prefixes up to ``start`` keep their entries."""
        self.become(self.data[:start] + replacement + self.data[end:])

    def tokens(self) -> list[int]:
        out, at, length_of = [], len(self.data), self.ranks.length_of
        while at:
            out.append(self.last[at])
            at -= length_of[self.last[at]]
        out.reverse()
        return out


class Codec:
    """Encoding of texts match by match, with a bounded cache of the matches' ids in two generations."""

    def __init__(self, path: str, pattern: str, cache_matches: int = CACHE_MATCHES):
        self.ranks = Ranks.load(path)
        self.split = regex.compile(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.limit = cache_matches
        tokens = [self.ranks.bytes_of.get(i, b"") for i in range(max(self.ranks.bytes_of) + 1)]
        self._lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def learn(self, matches: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of unseen matches. In byte order neighbours share prefixes, whose entries are kept from one to the next."""
        found, whole_of, become = {}, self.ranks.ranks.get, PrefixTable(self.ranks).become
        for match in sorted(matches):  # code points sort as their UTF-8 bytes do
            data = match.encode("utf-8", "surrogatepass")
            whole = whole_of(data)
            found[match] = become(data) if whole is None else (whole,)
        return found

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text; texts are taken together up to a bounded size, and longer ones in slices."""
        for group in _groups(texts):
            parts = [(last, self.split.findall(piece)) for last, piece in group]
            unseen = set().union(*(matches for _, matches in parts)).difference(self.cache)
            known = unseen.intersection(self.before)
            self.cache.update((m, self.before[m]) for m in known)
            self.cache.update(self.learn(unseen - known))
            get, ids = self.cache.__getitem__, []
            for last, matches in parts:
                ids.extend(chain.from_iterable(map(get, matches)))
                if last:
                    yield ids
                    ids = []
            if len(self.cache) >= self.limit:
                # what was used since the last turn stays one turn more
                self.before, self.cache = self.cache, {}

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        out = []
        for at in range(0, len(ids), SLICE_CHARS):
            part = ids[at : at + SLICE_CHARS]
            lengths = self._lengths[part]
            ends = np.cumsum(lengths)
            shift = np.repeat(self._starts[part] - ends + lengths, lengths)
            out.append(self._blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


def slices_of(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in slices of about ``size``, cut before single spaces between two other characters.

    A match of the pattern never runs over such a place, so the slices'
    matches are the text's. A text without such places stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut != -1 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _groups(texts: Iterable[str | None]) -> Iterator[list[tuple[bool, str]]]:
    """Slices of the texts in order, in groups of bounded size; True marks the last slice of a text.

    A long text's slices stay in one group, so that its ids come out as one list.
    """
    group: list[tuple[bool, str]] = []
    size = 0
    for text in texts:
        slices = list(slices_of(text or ""))
        group += [(i == len(slices) - 1, piece) for i, piece in enumerate(slices)]
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the ids of ``column`` as an array of integers; ``path`` names the rank file on every worker."""

    small_batches(docs)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, pattern)
        for texts in batches:
            yield _id_lists([np.array(x, dtype=np.int32) for x in codec.encode_all(t.as_py() for t in texts)])

    return docs.withColumn(out, ids(F.col(column)))


def round_trip(docs: DataFrame, path: str, pattern: str, column: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``struct(token_ids, decoded)``: encode() and decode() in one pass over the text."""
    small_batches(docs)
    kind = pa.struct([("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    @F.arrow_udf("struct<token_ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, pattern)
        for texts in batches:
            ids, back = [], []
            for found in codec.encode_all(t.as_py() for t in texts):
                ids.append(np.array(found, dtype=np.int32))
                back.append(codec.decode(ids[-1]))
            yield pa.StructArray.from_arrays([_id_lists(ids), pa.array(back, pa.binary())], fields=list(kind))

    return docs.withColumn(out, both(F.col(column)))


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *found])))


def decode(tokens: DataFrame, path: str, pattern: str, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of ``column`` stand for; null ids give no bytes."""

    small_batches(tokens)

    @F.arrow_udf(T.BinaryType())
    def data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, pattern)
        for lists in batches:
            yield pa.array(
                [codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists],
                pa.binary(),
            )

    return tokens.withColumn(out, data(F.col(column)))
