"""One query per operator, over whole tables, with SQL twins where SQL can express them.

Each query reads its table, applies its operator with production parameters
and derives the digest columns of its contract from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import (
    bpe,
    filteraudit,
    katz,
    licenses,
    linededup,
    packing,
    pii,
    quality,
    resample,
    sharding,
    simhash,
    styletree,
    vectors,
)
from sluice.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text; the digests are built from the operator's spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, "pii").select("doc_id", "pii")

    def of(kinds: tuple[str, ...]):
        return F.filter("pii", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(
            F.transform(
                spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    return found.select(
        "doc_id",
        *[F.size(of((k,))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(joined(of(pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        *[F.size(of((k,))).cast("long").alias(f"n_{k}") for k in pii.KINDS if k not in pii.BASE_KINDS],
    )


@query
def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents that is not blank, with the place of the line that stays for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.verdicts(docs).select("doc_id", "line_no", "first_doc", "first_line", "kept")


@query
def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again."""
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # behind an explode, or the plan would make the tokens once per column
    both = bpe.round_trip(docs, *vocabulary).select("doc_id", F.explode(F.array("tokens")).alias("t"))
    back = both.select("doc_id", "t.token_ids", "t.decoded")
    return back.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with the style trees of all hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = styletree.extract(pages, carry=["page_id", "url"])
    # behind an explode, or the plan would make the texts once per column
    once = texts.select("page_id", "url", F.explode(F.array("text")).alias("text"))
    return once.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, links at 2 bits or fewer, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grouped = simhash.group(docs, shingle_words=3, radius=2, carry=["doc_id"])
    return grouped.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op6_collision_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of equal labels, linked at a cosine of 0.98 or more."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vectors.group(rows, carry=["vec_id"])


@query
def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-off bigram scores of all documents; four fifths of them train the model."""
    scored = katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards over all documents, sizes near equal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, f"{Scratch(spark, 'shard-map').root}/map", shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        sharding.law().alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


@query
def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs, carry=["doc_id"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "strict_failed",
        "host_verdict",
    )


@query
def op10_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces of 1 to 2048 tokens, each a power of two."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters, per source, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filteraudit.audit(docs, table(spark, sf_dir, "labels"))


@query
def op12_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License words, base phrases and labels of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, carry=["doc_id"])


@query
def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words or more, drawn towards the benchmark's words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])


ORACLE["op9_host_quality"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls,
    len(string_split(coalesce(text, ''), chr(10))) AS n_lines
  FROM documents),
windows AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, n_lines
  FROM d LEFT JOIN covered USING (doc_id)),
failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.3 * n_words OR n_dup_lines > 0.5 * n_lines
      AS strict_failed
  FROM counts),
hosts AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS INTEGER)) AS f, f / n AS rate FROM failed GROUP BY source),
moments AS (SELECT least(greatest(avg(rate), 1e-6), 1 - 1e-6) AS m, var_pop(rate) AS v, avg(1.0 / n) AS u FROM hosts),
prior AS (
  SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * u, m * (1 - m) * 1e-4) - 1, 1) AS strength FROM moments),
verdicts AS (
  SELECT source, (f + m * strength) / (n + strength) AS shrunk,
    CASE WHEN shrunk > 0.5 THEN 'reject' WHEN shrunk > greatest(0.25, 2 * m) THEN 'strict' ELSE 'ok' END AS host_verdict
  FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (host_verdict = 'ok' OR (host_verdict = 'strict' AND NOT strict_failed)) AS kept,
  strict_failed, host_verdict
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source"""


ORACLE["op11_filter_audit"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents),
failing AS (
  SELECT doc_id, part,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM split),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
patterns AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, f),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
cells AS (
  SELECT part, o, step, o[step] AS own, n, g, x, f[o[step]] AS fails,
    len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda y: y)) = 1 AS single
  FROM patterns, steps),
sums AS (
  SELECT part, o, step, own,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN single AND fails THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails THEN x ELSE 0 END) AS toxic_lost
  FROM cells GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order,
  CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums"""

ORACLE["op12_license_index"] = licenses.twin_sql()

ORACLE["op13_importance_draw"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS ws FROM documents),
b AS (
  SELECT unnest(list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '')) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bytes AS (
  SELECT w, list_transform(range(CAST(length(hex(w)) / 2 AS BIGINT)),
    lambda i: CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bs
  FROM (SELECT w FROM dw UNION SELECT w FROM b)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x:
    list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 10000 AS bucket
  FROM bytes),
corpus AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS sa, (SELECT count(*) FROM b) AS ta),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (ta + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM corpus LEFT JOIN wanted USING (bucket), totals),
weights AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight
  FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000
    * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
    AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""
