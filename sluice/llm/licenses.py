"""License scans by a positional index of rare words, in DataFrame operations only.

A template is a sentence of a license with key phrases that must stand in it
word for word. The index lists, for every template, its key words with their
places. Document frequencies of all words of the templates are counted over
the whole corpus; each template is looked up under its key words of highest
inverse document frequency. An occurrence of such a word at place ``p`` whose
posting has place ``q`` proposes the template at ``p - q``; proposals of one
text are intersected by that start, so only starts stay that all the rare
words agree on. Every word of the template is then looked for at its place,
the key phrases have to be whole, and the share of the words found is the
match's score. Rare words are key words, which no match can lack, so the
look-up loses none.

The steps are joins on (row, place, word), so a text with very many license
words is as many rows, never one array per proposal. The index and the
templates are fixed, and small by construction; all else is exchanged by row.

Words are compared with A-Z lowered. Defined results: a null text is an empty
text without words; a text without licenses has no labels, no places and score
zero; overlapping places all count; repeated rows have equal results, one each;
a null id is a value like others; very long texts are read whole; empty tables
give empty tables; extra columns pass through, and a column that clashes with
an added one is replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, fresh, let, maybe_broadcast, text_of

# what lies between words: ASCII without digits and letters
BETWEEN = r"[\x00-/:-@\[-`{-\x7f]+"
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@dataclass(frozen=True)
class Template:
    """A sentence, its label, the key phrases it must hold, and the share of its words that have to stand in place."""

    label: str
    sentence: str
    phrases: tuple[str, ...] = ()
    share: float = 0.8
    base: bool = False

    def words(self) -> list[str]:
        return re.findall("[0-9a-z]+", self.sentence.lower())

    def mandatory(self) -> set[int]:
        """Places of the words of the key phrases; without phrases, all places."""
        words, places = self.words(), set()
        for phrase in self.phrases or (self.sentence,):
            part = re.findall("[0-9a-z]+", phrase.lower())
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            places.update(range(at, at + len(part)))
        return places

    def needed(self) -> int:
        return math.ceil(self.share * len(self.words()) - 1e-9)


# Names of licenses (base phrases first) and standard sentences of their notices.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", "mit license", share=1, base=True),
    Template("apache", "apache license", share=1, base=True),
    Template("gpl", "general public license", share=1, base=True),
    Template("apache-2.0", "Apache License, Version 2.0", share=1),
    Template("gpl-2.0", "General Public License, version 2", share=1),
    Template("gpl-3.0", "General Public License, version 3", share=1),
    Template("lgpl", "GNU Lesser General Public License", share=1),
    Template("agpl", "GNU Affero General Public License", share=1),
    Template("mpl-2.0", "Mozilla Public License, v. 2.0", share=1),
    Template("mpl-2.0", "Mozilla Public License Version 2.0", share=1),
    Template("epl", "Eclipse Public License", share=1),
    Template("boost", "Boost Software License", share=1),
    Template("cc-by", "licensed under CC BY 4.0", ("CC BY 4.0",), share=0.6),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",), share=0.6),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",), share=0.6),
    Template("cc-by-nd", "licensed under CC BY-ND 4.0", ("CC BY-ND 4.0",), share=0.6),
    Template("cc-by", "Creative Commons Attribution 4.0 International", share=1),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International", share=1),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International", share=1),
    Template("cc0", "CC0 1.0 Universal", share=1),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        ("permission is hereby granted", "copy of this software"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "bsd-3-clause",
        "may be used to endorse or promote products derived from this software without specific prior written "
        "permission",
        ("endorse or promote products derived from this software",),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License",
        ("except in compliance with the license",),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        ("general public license as published by the free software foundation",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software",
        ("without any express or implied warranty", "authors be held liable"),
    ),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words()})


def _row_keys() -> list[Column]:
    """Two 64-bit hashes that tell rows apart; rows with equal id and text share them, and their results."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]


def license_words(text: Column, vocabulary: list[str]) -> Column:
    """``n_words`` of a whole text, and place and lowered form of each word that templates use."""
    words = F.array_remove(F.split(text, BETWEEN), "")

    def found(all_words: Column) -> Column:
        placed = F.transform(all_words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
        # only ASCII words are lowered: other characters can lower to ASCII
        known = F.filter(
            placed,
            lambda x: F.lower(x["word"]).isin(vocabulary) & (F.octet_length(x["word"]) == F.length(x["word"])),
        )
        lowered = F.transform(known, lambda x: F.struct(x["pos"].alias("pos"), F.lower(x["word"]).alias("word")))
        return F.struct(F.size(all_words).cast("long").alias("n_words"), lowered.alias("hits"))

    return let(words, found)


def _fixed(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of literals."""
    made = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names.split(), strict=True)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*made)).alias("r")).select("r.*")


def document_frequencies(scanned: DataFrame) -> dict[str, int]:
    """Documents holding each license word, over the whole corpus: at most one row per word of the templates."""
    words = scanned.select(F.explode(F.array_distinct("found.hits.word")).alias("word"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_words(template: Template, frequency: dict[str, int], most: int) -> list[tuple[str, int]]:
    """The key words of highest inverse document frequency with their places, at most ``most``."""
    words = template.words()
    return sorted(((words[q], q) for q in template.mandatory()), key=lambda x: (frequency.get(x[0], 0), x[1]))[:most]


def matches(
    scanned: DataFrame, scratch: Scratch, templates: tuple[Template, ...] = TEMPLATES, rare: int = 3
) -> DataFrame:
    """One row per place where a template stands: ``k1, k2, template, start, words_found``.

    ``scanned`` has ``k1, k2`` and ``found`` (see ``license_words``).
    """
    spark = scanned.sparkSession
    frequency = document_frequencies(scanned)
    index = [
        (word, t, q, 1 << i, (1 << len(picked)) - 1)
        for t, template in enumerate(templates)
        for picked in [rare_words(template, frequency, rare)]
        for i, (word, q) in enumerate(picked)
    ]
    postings = F.broadcast(_fixed(spark, index, "word template q bit all_bits"))
    looked_up = sorted({row[0] for row in index})
    hits = scanned.select(
        "k1", "k2", F.explode(F.filter("found.hits", lambda x: x["word"].isin(looked_up))).alias("hit")
    ).select("k1", "k2", "hit.pos", "hit.word")
    proposed = scratch.write(
        hits.join(postings, "word")
        .select("k1", "k2", "template", (F.col("pos") - F.col("q")).alias("start"), "bit", "all_bits")
        .where("start >= 0")
        .groupBy("k1", "k2", "template", "start")
        .agg(F.bit_or("bit").alias("bits"), F.max("all_bits").alias("all_bits"))
        .where("bits = all_bits")
        .select("k1", "k2", "template", "start"),
        "proposed",
    )
    tokens = [
        (t, q, word, int(q in must))
        for t, template in enumerate(templates)
        for must in [template.mandatory()]
        for q, word in enumerate(template.words())
    ]
    expected = proposed.join(F.broadcast(_fixed(spark, tokens, "template q word must")), "template").select(
        "k1", "k2", "template", "start", (F.col("start") + F.col("q")).alias("pos"), "word", "must"
    )
    rows = scratch.write(proposed.select("k1", "k2").distinct(), "rows")
    there = (
        scanned.select("k1", "k2", "found.hits")
        .join(maybe_broadcast(rows), ["k1", "k2"], "left_semi")
        .select("k1", "k2", F.explode("hits").alias("hit"))
        .select("k1", "k2", "hit.pos", "hit.word")
        .distinct()
    )
    counted = (
        expected.join(there, ["k1", "k2", "pos", "word"])
        .groupBy("k1", "k2", "template", "start")
        .agg(F.count("*").alias("words_found"), F.sum("must").alias("musts"))
    )
    bounds = [(t, x.needed(), len(x.mandatory())) for t, x in enumerate(templates)]
    whole = counted.join(F.broadcast(_fixed(spark, bounds, "template needed all_musts")), "template").where(
        "words_found >= needed and musts = all_musts"
    )
    out = scratch.write(whole.select("k1", "k2", "template", "start", "words_found"), "matches")
    scratch.drop(proposed)
    scratch.drop(rows)
    return out


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    rare: int = 3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Documents with word count, places of the base phrases, labels and score; ``carry`` names the columns to return.

    The text is read once: its license words with their places are stored,
    and all later steps read those. ``score`` is the largest share of a
    matched template's words that stand in place.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    names = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    record = fresh("record", ["doc_id", "text"])
    packed = docs.select(
        *_row_keys(),
        F.struct(*names).alias(record),
        license_words(text_of(F.col("text")), vocabulary(templates)).alias("found"),
    )
    scanned = scratch.write(packed, "scanned")
    found = matches(scanned, scratch, templates, rare)
    facts = [(t, x.label, x.base, float(len(x.words()))) for t, x in enumerate(templates)]
    told = found.join(F.broadcast(_fixed(spark, facts, "template label base size")), "template")
    start = F.when(F.col("base"), F.col("start").cast("long"))
    verdict = scratch.write(
        told.groupBy("k1", "k2").agg(
            F.count(start).alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max(F.col("words_found") / F.col("size")).alias("score"),
        ),
        "verdict",
    )
    scratch.drop(found)
    rows = scanned.select("k1", "k2", record, F.col("found.n_words").alias("n_words"))
    joined = rows.join(maybe_broadcast(verdict), ["k1", "k2"], "left")
    return joined.select(
        f"{record}.*",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def twin_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same result in DuckDB without an index: every template against every license word of every text."""
    tokens = ", ".join(
        f"({t}, {q}, '{w}', {int(q in x.mandatory())})" for t, x in enumerate(templates) for q, w in enumerate(x.words())
    )
    facts = ", ".join(
        f"({t}, '{x.label}', {x.base}, {len(x.words())}, {x.needed()}, {len(x.mandatory())})"
        for t, x in enumerate(templates)
    )
    return rf"""
WITH tokens(t, q, word, must) AS (VALUES {tokens}),
facts(t, label, base, size, needed, musts) AS (VALUES {facts}),
split AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM split),
counted AS (
  SELECT doc_id, t, pos - q AS start, count(*) AS n, sum(must) AS m
  FROM placed JOIN tokens USING (word) WHERE pos >= q GROUP BY ALL),
hits AS (
  SELECT doc_id, label, base, start, n / size AS share
  FROM counted JOIN facts USING (t) WHERE n >= needed AND m = musts),
told AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM hits GROUP BY doc_id)
SELECT split.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM split LEFT JOIN told USING (doc_id)"""
