"""Corpus pipeline: from raw documents to packed token sequences.

Five stages, each one call of a text operator on all that the stage before it
kept. All but the last return the columns of ``documents``; the last returns
one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import linededup, packing, pii, quality, simhash
from sluice.llm.common import Scratch, fresh

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep, unchanged."""
    # the record travels as one column, so that none of its columns can clash with a rule's
    record = fresh("record", ["doc_id", "text", "source"])
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias(record))
    return quality.judge(packed, carry=[record], store=False).where("kept").select(f"{record}.*")


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier place holds; documents left without a line go."""
    return linededup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    return simhash.keep_one(docs, shingle_words=3, radius=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1 to 2048 tokens, each a power of two, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("fuzzy_lines", fuzzy_lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

# Fingerprints, similar lines and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each stage returns is stored before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = len(Scratch.opened)
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        Scratch.clear_since(mark)  # what the stage stored on its way
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)
