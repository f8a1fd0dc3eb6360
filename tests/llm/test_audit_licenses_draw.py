import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import filteraudit, licenses, resample
from sluice.llm.common import Scratch

SPACE = re.compile("[ \t-\r]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- filter audit


def failing(rows):
    """Per row: part, id and the letters of the filters it fails."""
    firsts = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    for doc_id, text, source in rows:
        t = text or ""
        words = [w for w in SPACE.split(t) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > firsts[t],
        }
        yield source or "", doc_id, {k for k, v in fails.items() if v}


def audited(rows, good, toxic):
    parts, out = collections.defaultdict(list), {}
    for part, doc_id, fails in failing(rows):
        parts[part].append((doc_id, fails))
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = (
                    f,
                    len(left),
                    len(gone),
                    sum(f in x for _, x in docs) - len(gone),
                    sum(x == {f} for _, x in docs),
                    sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone),
                )
        for key, (f, *rest) in out.items():
            if key[0] == part:
                out[key] = (*rest, shapley[f])
    return out


def of_audit(df):
    rows = df.collect()
    got = {
        (r.part, r.filter_order, r.step): (
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley,
        )
        for r in rows
    }
    assert len(got) == len(rows)
    return got


def test_audit_matches_brute_force(spark, clashing):
    rows = [(r.doc_id, r.text, r.source) for r in clashing.collect()]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("bits", F.lit(1))
    got = of_audit(filteraudit.audit(clashing, told))
    assert got == audited(rows, good, toxic)
    assert {p for p, _, _ in got} == {"", "a", "b", "c"} and len(got) == 4 * 600


def test_audit_of_many_copies_in_one_part(spark):
    """One part with most rows and one text with a third of them, over many ranges; hot texts on both join paths."""
    rng = random.Random(5)
    rows = []
    for i in range(2400):
        text = "same Text" if i % 3 == 0 else rng.choice(["#x", "Y", "z z z"]) + " " + " ".join(str(rng.random()) for _ in range(rng.choice([3, 210])))
        rows.append((i, text, "big" if i % 10 else f"s{i % 70}"))
    rows += [(None, "same Text", "big")] * 40 + [(0, "same Text", "big")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    want = audited(rows, {i for i in range(500) if i % 2}, set())
    assert of_audit(filteraudit.audit(docs, labels)) == want


@pytest.mark.parametrize("hot_texts", [1, 100_000])
def test_copies_are_found_hot_or_not(spark, monkeypatch, hot_texts):
    monkeypatch.setattr(filteraudit, "HOT_TEXTS", hot_texts)
    rows = [(i, f"text {i % 4}", "p") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    marked = filteraudit.failures(docs, none, Scratch(spark, "test")).collect()
    assert {r.doc_id for r in marked if r.bits & 16} == set(range(4, 40))


def test_audit_of_nothing(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(no_docs, none).count() == 0
    assert filteraudit.audit(edge_docs, none).where("good_lost + toxic_lost > 0").count() == 0


def test_galloping_merges():
    rng = np.random.default_rng(3)
    for n, m in itertools.product((0, 1, 2, 5, 90, 1000), repeat=2):
        a = np.unique(rng.integers(0, 1500, n))
        b = np.unique(rng.integers(0, 1500, m))
        assert filteraudit.gallop(a, b).tolist() == np.searchsorted(a, b).tolist()
        assert filteraudit.merged(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
        assert filteraudit.without(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        assert filteraudit.shared(a, b) == len({*a.tolist()} & {*b.tolist()})


# --- licenses


def scanned(text, templates=licenses.TEMPLATES):
    """Brute force: every template at every place."""
    words = WORD.findall(lowered(text))
    found = []
    for t in templates:
        own, must = t.words(), t.mandatory()
        for start in range(len(words)):
            same = [start + q < len(words) and words[start + q] == w for q, w in enumerate(own)]
            if all(same[q] for q in must) and sum(same) >= t.needed():
                found.append((t, start, sum(same) / len(own)))
    base = [(t.label, s) for t, s, _ in found if t.base]
    return (
        len(words),
        len(base),
        min((s for _, s in base), default=None),
        max((s for _, s in base), default=None),
        ",".join(sorted({x for x, _ in base})),
        ",".join(sorted({t.label for t, _, _ in found})),
        max((x for _, _, x in found), default=0.0),
    )


def license_rows():
    sentences = [t.sentence for t in licenses.TEMPLATES]
    rng = random.Random(9)
    rows = []
    for i, s in enumerate(sentences):
        words = s.split()
        changed = list(words)
        changed[rng.randrange(len(words))] = "otherwise"
        rows += [(1000 + 10 * i + k, x) for k, x in enumerate([s, f"x {s.upper()} y", " ".join(words[1:]), " ".join(changed), "-- ".join(words)])]
    rows += [
        (2001, "MIT License " * 3000),
        (2002, "mit mit license license general public general public license"),
        (2003, "MİT license, mité license, Kw MIT license, mit\x00license; public worK"),
        (2004, "\n".join(sentences)),
        (2005, "the of and in " * 2000 + "apache license"),
        (2006, "Licensed under CC BY-NC 4.0. Also: licensed by CC BY-NC 4.0 CC BY-NC 4.0"),
        (2004, "\n".join(sentences)),
    ]
    return rows


def test_licenses_match_brute_force(spark, clashing):
    rows = license_rows()
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    docs = clashing.withColumns({"hits": F.lit(3), "n_words": F.lit(-1), "k1": F.lit(2), "template": F.lit("x")})
    docs = docs.unionByName(extra, allowMissingColumns=True)
    out = licenses.scan(docs)
    assert out.count() == docs.count() and "template" in out.columns
    for r in out.collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == scanned(r.text), r.doc_id
    many = [r for r in out.where("doc_id = 2001").collect()]
    assert many[0].n_base == 3000 and many[0].last_word == 5998


def test_rare_words_lose_no_match(spark):
    """However many rare words are looked up, the matches are the same."""
    docs = spark.createDataFrame(license_rows(), "doc_id long, text string").repartition(3)
    found = [sorted(map(str, licenses.scan(docs, rare=n).collect())) for n in (1, 2, 9)]
    assert found[0] == found[1] == found[2]


def test_frequencies_are_of_all_documents(spark):
    docs = spark.createDataFrame([(i, "mit license" if i % 4 else "license only") for i in range(100)], "doc_id long, text string")
    words = docs.select(licenses.license_words(F.col("text"), licenses.vocabulary()).alias("found"))
    assert licenses.document_frequencies(words) == {"mit": 75, "license": 100}
    assert licenses.rare_words(licenses.TEMPLATES[0], {"mit": 75, "license": 100}, 1) == [("mit", 0)]


def test_licenses_of_nothing(no_docs):
    assert licenses.scan(no_docs).count() == 0


# --- importance draw


def drawn(rows, target, draw):
    def features(text):
        words = WORD.findall(lowered(text))
        runs = [" ".join(words[i : i + n]) for n in range(1, draw.longest + 1) for i in range(len(words) - n + 1)]
        return words, [zlib.crc32(x.encode()) % draw.buckets for x in runs]

    made = [features(text) for _, text in rows]
    s = collections.Counter(b for _, f in made for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sa + draw.buckets) / ((s[b] + 1) * (ta + draw.buckets)))) for b in range(draw.buckets)]
    out = []
    for (doc_id, _), (words, f) in zip(rows, made, strict=True):
        name = f"{draw.seed}:{'' if doc_id is None else doc_id}".encode()
        h = int(hashlib.sha256(name).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= draw.min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(able[: len(able) * draw.percent // 100], 1):
        r[4] = i
    return collections.Counter(tuple(r[:5]) for r in out)


def of_draw(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("draw", [resample.Draw(percent=40), resample.Draw(longest=3, buckets=97, percent=25, min_words=5, last_sort=1)])
def test_draw_matches_brute_force(spark, clashing, draw):
    docs = clashing.withColumns({"weight": F.lit(1), "rank": F.lit("x"), "neg": F.lit(4), "n_words": F.lit(4), "record": F.lit(5)})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [rows[0][1], None, "", "Alpha beta Été \U0001f600 word"]
    out = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), draw)
    assert of_draw(out) == drawn(rows, target, draw)
    assert {"neg", "n_words", "record", "source"} <= set(out.columns)


def test_draw_of_many_ties(spark):
    """A third of all rows are one repeated row; ranks stay gapless and exact."""
    draw = resample.Draw(percent=60, last_sort=3, min_words=1)
    rows = [(7, "alpha beta")] * 300 + [(None, "alpha beta")] * 50 + [(i, f"word{i % 5} beta") for i in range(500)] + [(1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = resample.resample(docs, spark.createDataFrame([("alpha gamma",)], "text string"), draw)
    assert of_draw(out) == drawn(rows, ["alpha gamma"], draw)


def test_cutoff_by_median_of_medians(spark):
    rng = random.Random(1)
    keys = [(rng.randrange(-50, 50), rng.randrange(9), i) for i in range(3000)]
    df = spark.createDataFrame(keys, "neg long, id long, rid long").repartition(8).cache()
    for k in (1, 2, 777, 1500, 2999, 3000):
        found, rounds = resample.cutoff(df, k, 1)
        assert found == sorted(keys)[k - 1] and rounds <= math.log(3000, 4 / 3) + 2
    skewed = spark.createDataFrame([(i, 0, i) for i in range(2000)], "neg long, id long, rid long").repartitionByRange(5, "neg")
    assert resample.cutoff(skewed, 1234, 10)[0] == (1233, 0, 1233)
    assert resample.weighted_median([(1, (5, 0, 0)), (10, (1, 0, 0)), (3, (9, 0, 0))]) == (1, 0, 0)


def test_draw_of_nothing(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(no_docs, none).count() == 0
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert of_draw(resample.resample(edge_docs, none)) == drawn(rows, [], resample.Draw())
    few = edge_docs.limit(3)
    assert resample.resample(few, none).where("rank is not null").count() == 0
