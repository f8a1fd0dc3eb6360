"""The registered queries' digests against plain formulations, over the driver's smallest tables."""

import base64
import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sluice.llm import queries
from tests.llm.test_simhash_lines import Sets, fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    return {i: t or "" for i, t in rows}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, rx, ok in kinds for m in re.finditer(rx, text) if ok(m)]


def test_op1_base_spans(spark, texts):
    rows = queries.QUERIES["op1_anchor_pii"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), r.doc_id
        count = collections.Counter(k for k, _, _ in spans)
        every = r.spans.split(",") if r.spans else []
        assert set(filter(None, said.split(","))) <= set(every)
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == count[kind]


def test_op3_ids_and_bytes(spark, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.QUERIES["op3_prefix_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op5_fingerprints_and_components(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_simhash_neardup"](spark, SF).collect()}
    prints = {i: fingerprint(t) & (1 << 64) - 1 for i, t in texts.items()}
    ids, sets = sorted(prints), Sets()
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                sets.join(a, b)
    first = {}
    for i in ids:
        first.setdefault(sets.find(i), i)
    for i in ids:
        assert rows[i].fingerprint == f"{prints[i]:016x}" and rows[i].component_id == first[sets.find(i)]


def test_op8_sizes_slots_and_law(spark, texts):
    rows = queries.QUERIES["op8_virtual_slots"](spark, SF).collect()
    places, load = collections.defaultdict(list), collections.Counter()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 24
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert len(rows) == len(texts) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_op10_pieces_are_the_documents(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.Counter()
    for r in queries.QUERIES["op10_power_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
    assert set(pieces) == set(texts) and max(sequences.values()) <= 2048
    for doc_id, of in pieces.items():
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(of, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_op4_and_op6_cover_their_tables(spark):
    con = duckdb.connect()
    pages = queries.QUERIES["op4_style_tree"](spark, SF).collect()
    assert len(pages) == con.execute(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchall()[0][0]
    assert all(r.n_chars == len(r.text) for r in pages) and sum(r.n_chars > 0 for r in pages) > 0.9 * len(pages)
    vectors = queries.QUERIES["op6_collision_vectors"](spark, SF).collect()
    assert len(vectors) == con.execute(f"SELECT count(*) FROM '{SF}/embeddings.parquet'").fetchall()[0][0]
    assert all(r.kept == (r.vec_id == r.component_id) for r in vectors)
