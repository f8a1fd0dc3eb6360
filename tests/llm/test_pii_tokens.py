import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sluice.llm import bpe, packing, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if valid:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["a", "b@c.d", "@", ".", "..", "-", "+", "1", "23", "255", "256", "4465758382889437", "4111 1111 1111 1111"]
    bits += [" ", "  ", "(", ")", "é", "١", "İ", "1.2.3.4", "+1 (663) 555-6869", "x.com", "0", "%", "_", "\n", "1-1", "+"]
    hits = 0
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = base_spans(text)
        hits += len(want)
        assert [s for s in pii.find_spans(text) if s[0] in BASE] == want, repr(text)
    assert hits > 5000


def test_added_kinds_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00, account no. 12345678, https://a.b/c?d=1. At 12 Baker Street, London 12345."
    kinds = {k: text[s:e] for k, s, e in pii.find_spans(text)}
    assert kinds == {
        "iban": "DE89 3704 0044 0532 0130 00",
        "account": "12345678",
        "url": "https://a.b/c?d=1",
        "address": "12 Baker Street, London 12345",
    }
    assert pii.redact_text(text) == "IBAN <IBAN>, account no. <ACCOUNT>, <URL>. At <ADDRESS>."
    assert pii.redact_text("mail a@b.co now") == "mail <EMAIL> now"
    assert pii.find_spans("IBAN DE89 3704 0044 0532 0130 01 and the road ahead, 12 roads") == []


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("She lives at 5 Isle of Dogs Road now", "address", "5 Isle of Dogs Road"),
        ("at 12 Old Saint John The Baptist Church Lane.", "address", "12 Old Saint John The Baptist Church Lane"),
        ("at 350 5th Avenue today", "address", "350 5th Avenue"),
        ("Wir wohnen in der Hauptstraße 12 in Bonn", "address", "Hauptstraße 12"),
        ("Sie finden uns: Berliner Strasse 7a, Bonn 53111.", "address", "Berliner Strasse 7a, Bonn 53111"),
        ("in der Alten Berliner Straße 7", "address", "Alten Berliner Straße 7"),
        ("zur Konrad-Adenauer-Straße 3 gehen", "address", "Konrad-Adenauer-Straße 3"),
        ("Vive en la Calle Mayor 5 desde ayer", "address", "Calle Mayor 5"),
        ("en la calle de la Princesa, 12, Madrid", "address", "calle de la Princesa, 12"),
        ("Il habite 12 rue de la Paix depuis hier", "address", "12 rue de la Paix"),
        ("au 12 Rue de la Paix, Paris 75002.", "address", "12 Rue de la Paix, Paris 75002"),
        ("au 3 bis, rue de l’Église et", "address", "3 bis, rue de l’Église"),
        ("au 3, rue de l'Église et", "address", "3, rue de l'Église"),
        ("the account that you asked us about last week is 12345678 now", "account", "12345678"),
        ("this account is closed for good, as you know. Call 12345678", "account", None),
        ("the account that you asked us about last week\nis 12345678 now", "account", None),
        ("In 12 years the road and the street and dans la rue 5 fois", "address", None),
    ],
)
def test_addresses_and_accounts_in_their_languages(text, kind, want):
    assert [text[s:e] for k, s, e in pii.find_spans(text) if k == kind] == ([want] if want else [])


def test_street_and_account_words_alone_cost_their_length():
    assert pii.find_spans("Street Rue account " * 20000 + "-straße" * 20000) == []


def test_pii_columns(clashing):
    rows = pii.with_spans(clashing).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in BASE] == base_spans(r.text)
    clean = pii.redact(clashing)
    assert clean.columns == clashing.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[5] is None and texts[6] == "" and "<EMAIL> <PHONE>, <CARD>, <IP>" in texts[10]


def test_pii_of_nothing(no_docs):
    assert pii.with_spans(no_docs).count() == 0


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "é", ".", ",", "'s", "12", "<|endoftext|>", "日本", "\r\n", "\x85"]
    bits += ["😀", " a", "aaaa", "zz", "==", "----", "ation", "İ"]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    return mixed + ["".join(rng.choice("abcdethion") for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["e" * 3000]


def test_prefix_tables_encode_as_the_library(reference):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, cache_matches=500)
    for text, ids in zip(samples(), codec.encode_all(samples()), strict=True):
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_appends_and_edits_are_exact():
    ranks = bpe.Ranks.load(RANKS)
    rng = random.Random(3)
    table = bpe.PrefixTable(ranks, b"internationalisation of prefixes")
    for _ in range(60):
        a = rng.randint(0, len(table.data))
        b = rng.randint(a, min(len(table.data), a + 5))
        table.edit(a, b, bytes(rng.choice(b"abcdeionst ") for _ in range(rng.randint(0, 5))))
        table.append(rng.choice([b"", b"ing", b"er"]))
        assert table.tokens() == ranks.merge_plainly(table.data)


def test_long_texts_are_cut_where_matches_end(reference):
    text = "one two  three\n four five " * 400 + "end"
    assert "".join(bpe.slices_of(text, 100)) == text
    split = [m for piece in bpe.slices_of(text, 100) for m in reference.encode_ordinary(piece)]
    assert split == reference.encode_ordinary(text)


def test_encode_decode_columns(clashing, reference):
    ids = bpe.encode(clashing, RANKS, public_tokenizers.PATTERN)
    rows = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == clashing.count()
    rows += [
        r for r in bpe.round_trip(clashing, RANKS, public_tokenizers.PATTERN).select("text", "tokens.*").collect()
    ]
    for r in rows:
        assert r.token_ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_of_nothing(no_docs):
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).select('tokens.*').collect() == []


def test_lengths_are_powers_of_two():
    for n in (1, 2, 3, 2047, 2048, 2049, 10000):
        parts = packing.lengths_of(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
        assert parts == sorted(parts, reverse=True)


def test_file_encoder_equals_the_library():
    encoder = packing.FileEncoder(FILE, public_tokenizers.PATTERN)
    assert encoder.ranks is not None
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    for text in samples():
        got = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts_equal_the_library_by_default(spark):
    library = Tokenizer.from_file(FILE)
    encoder = packing.FileEncoder(FILE, public_tokenizers.PATTERN, specials=True)
    assert encoder.ranks is not None
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n", "<|endoftext|", *samples()]
    for text in texts:
        got = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)
    docs = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    pieces = sorted(packing.pack(docs, FILE, public_tokenizers.PATTERN).collect(), key=lambda p: p.start)
    assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), dtype="<u4").tolist() == [64, 220, 50256, 275, 1]


def test_pieces_cover_every_document(clashing, reference):
    pieces = packing.pack(clashing, FILE, public_tokenizers.PATTERN).collect()
    docs = clashing.collect()
    want = sorted(np.array([*reference.encode_ordinary(d.text or ""), 1], dtype="<u4").tobytes() for d in docs)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    whole, run = [], b""
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        assert p.length == p.bucket == len(p.ids) // 4 and p.offset == 0 and p.length & (p.length - 1) == 0
        assert p.start * 4 == len(run)
        run += bytes(p.ids)
        if len(run) == 4 * p.doc_tokens:
            whole.append(run)
            run = b""
    assert sorted(whole) == want
    assert zlib.crc32(whole[0]) >= 0 and hashlib.sha256(run).hexdigest().startswith("e3b0")


def test_packing_nothing(no_docs, tmpdir_path):
    pieces = packing.pack(no_docs, FILE, public_tokenizers.PATTERN)
    assert pieces.count() == 0
