import numpy as np
import pytest
import xxhash

import __spark_entry__
import corpus_pipeline
from sluice.llm import linededup, pii, queries, quality, simhash
from tests.llm.conftest import SCHEMA, edge_rows, prose


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(queries.ORACLE) <= set(queries.QUERIES)


def test_stages_keep_columns_and_survive_edges(spark, clashing, tmpdir_path):
    docs = clashing
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmpdir_path}/{name}")
        docs = spark.read.parquet(f"{tmpdir_path}/{name}")
    assert docs.count() > 0


def test_stages_of_nothing(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "").count() == 0, name


def test_run_equals_brute_force(spark, tmpdir_path):
    rows = edge_rows() + [(300 + i, prose(300 + i, 80), "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(400, prose(300, 80) + "\nmail me at x@y.org", "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmpdir_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, tmpdir_path).collect()
    from tests.llm.test_pii_tokens import FILE
    from tests.llm.test_quality_sharding import expected
    from tests.llm.test_simhash_lines import fingerprint, line_rows
    from tokenizers import Tokenizer

    kept = [r for r in rows if not expected(r[1])[5]]
    first = line_rows([(r[0], r[1]) for r in kept])
    texts = []
    for r in kept:
        at = float("inf") if r[0] is None else r[0]
        lines = [x for n, x in enumerate(r[1].split("\n")) if first.get((at, n), (at, n)) == (at, n)]
        text = "\n".join(lines)
        if text.strip() or text == r[1]:
            texts.append((at, text))
    groups = {}
    for at, text in sorted(texts):
        near = [f for f in groups if (f ^ fingerprint(text)).bit_count() <= 2]
        groups.setdefault(near[0] if near else fingerprint(text), (at, text))
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    want = sorted(
        np.array([*library.encode(pii.redact_text(t), add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        for _, t in groups.values()
    )
    whole, run = [], b""
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        run += bytes(p.ids)
        if len(run) == 4 * p.doc_tokens:
            whole.append(run)
            run = b""
    assert sorted(whole) == want


@pytest.mark.parametrize("module", [quality, linededup, simhash])
def test_no_local_checkpoint(module):
    with open(module.__file__, encoding="utf-8") as f:
        assert "localCheckpoint" not in f.read()


def test_hash_is_xxh64(spark):
    got = spark.sql("select xxhash64('some words') h").first().h
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"some words", 42)
