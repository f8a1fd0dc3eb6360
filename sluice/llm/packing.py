"""Packing by power-of-two decomposition.

A document's ids (with an end id) are cut into pieces whose lengths are
powers of two: whole pieces of the maximum length first, then the binary
digits of the rest from the highest. Every piece is a sequence of its own and
goes to the bucket of its length, so no sequence crosses documents, every
batch of a bucket has one length, and nothing is padded.

Defined results: a special token of the file that a text holds literally is
its id, as in a call of the library with ``add_special_tokens=False``; a null
or empty text is the end id alone; a null id is
carried; repeated rows give their pieces each, with sequences of their own;
empty tables give empty tables; extra columns pass through and clashing ones
are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import small_batches

MAX_LENGTH = 2048
END_ID = 1
PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )
)
PIECES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]))


class FileEncoder:
    """Ids of whole texts by the vocabulary of a byte-level ``tokenizers`` file; no special tokens are put around them.

    Where the file's merges rank as its ids do, the rank encoder of
    ``tiktoken`` is built from the file: it gives the same ids four times
    faster than the ``tokenizers`` library, which is used for other files.
    With ``specials`` a special token that a text holds literally gets its
    own id, as by the library in its default state; else it is plain text.
    """

    def __init__(self, path: str, pattern: str, specials: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        added = [t for t in file.get("added_tokens") or [] if specials or not t["special"]]
        # tokens that take their surroundings in are left to the library
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and file.get("normalizer")) for t in added)
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.literal = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [vocab.get(a + b) for a, b in pairs]
        self.tokenizer = self.ranks = None
        if plain and made == list(range(256, 256 + len(made))):
            to_byte = {c: b for b, c in byte_alphabet().items()}
            ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(made)}
            self.ranks = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = not specials

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.ranks is not None:
            if self.literal is None or not self.literal.search(text):
                return self._ranked(text)
            # every second part is an added token; the texts between are split on their own, as in the library
            parts = self.literal.split(text)
            return b"".join(self.added[p] if i % 2 else self._ranked(p) for i, p in enumerate(parts) if p)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ranked(self, text: str) -> bytes:
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


def lengths_of(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to ``n``: as many of ``longest`` (a power of two) as fit, then the binary digits."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = END_ID, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: the documents' columns but ``text``, with ``doc_tokens``, ``start``, ``length``, ``ids``,
    ``bucket`` (the length), ``sequence_id`` and ``offset`` (0: a piece fills its sequence).

    ``path`` names the tokenizer file on every worker, ``pattern`` the
    expression that splits text before its merges. There is no shuffle:
    pieces are made where the text is read, and write_buckets() files them.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    small_batches(docs)
    added = ["doc_tokens", "start", "length", "ids", "bucket", "sequence_id", "offset"]
    keep = [c for c in docs.columns if c not in (*added, "text")]

    end = np.array([end_id], dtype="<u4").tobytes()

    @F.arrow_udf(PIECES)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path, pattern)
        for texts in batches:
            sizes, starts, lengths, totals, ids = [0], [], [], [], []
            for text in texts:
                data = encoder.encode(text.as_py()) + end
                parts, at = lengths_of(len(data) // 4, longest), 0
                for n in parts:
                    starts.append(at)
                    ids.append(data[4 * at : 4 * (at + n)])
                    at += n
                lengths += parts
                totals += [at] * len(parts)
                sizes.append(len(lengths))
            columns = [pa.array(x, pa.int64()) for x in (starts, lengths)]
            columns += [pa.array(ids, pa.binary()), pa.array(totals, pa.int64())]
            structs = pa.StructArray.from_arrays(columns, fields=list(PIECES_ARROW.value_type))
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)

    # one use of the pieces, or the plan would make them twice
    cut = docs.select(*keep, F.explode(pieces(F.col("text"))).alias("ids"))
    return cut.select(*keep, "ids.doc_tokens", "ids.start", "ids.length", "ids.ids").withColumns(
        {
            "bucket": F.col("length").cast("int"),
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> FileEncoder:
    """One encoder per worker process and file."""
    return FileEncoder(path, pattern, specials=True)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """File the pieces by length: one folder per bucket, for batches of equal length."""
    pieces.write.mode("error").partitionBy("bucket").parquet(path)
