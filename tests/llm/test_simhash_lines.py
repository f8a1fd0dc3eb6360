import collections
import random
import re

import xxhash

from sluice.llm import linededup, simhash
from sluice.llm.common import Scratch, connected_components
from tests.llm.conftest import prose


def fingerprint(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t-\r]+", folded) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_groups_match_brute_force(clashing):
    rows = simhash.group(clashing).collect()
    assert len(rows) == clashing.count()
    assert all(r.fingerprint & (2**64 - 1) == fingerprint(r.text) for r in rows)
    sets, prints = Sets(), {r.fingerprint & (2**64 - 1) for r in rows}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                sets.join(a, b)
    low = collections.defaultdict(list)
    for r in rows:
        low[sets.find(r.fingerprint & (2**64 - 1))].append(r.doc_id)
    for r in rows:
        ids = [i for i in low[sets.find(r.fingerprint & (2**64 - 1))] if i is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(low)


def test_links_find_all_close_prints(spark):
    center = 0x0123456789ABCDEF
    prints = {center ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(1, 64, 7)} | {0, center}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    sets = Sets()
    for a, _ in enumerate(signed):
        for b in range(a):
            if ((signed[a][0] ^ signed[b][0]) & (2**64 - 1)).bit_count() <= 2:
                sets.join(a, b)
    found = {
        r.fp: r.group
        for r in simhash.components(spark.createDataFrame(signed, "fp long"), Scratch(spark, "test")).collect()
    }
    groups = collections.defaultdict(set)
    for i, (p,) in enumerate(signed):
        groups[sets.find(i)].add(found[p])
    assert all(len(g) == 1 for g in groups.values()) and len(set(found.values())) == len(groups)


def test_simhash_of_nothing(no_docs):
    assert simhash.group(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(300, 400)] + [(7, 7)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    got = {r.node: r.component for r in out.collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in [5, *range(300, 400)]} == {5} and 7 not in got


def line_rows(rows):
    """Brute force: (doc_id, line_no) to the first place of its component."""
    places = collections.defaultdict(list)
    for doc_id, text in rows:
        for n, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\n\x0b\f\r").lower()
            if line:
                places[line].append((float("inf") if doc_id is None else doc_id, n))
    lines = list(places)
    grams = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    sets = Sets()
    for a in range(len(lines)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                sets.join(a, b)
    first = {}
    for i, line in enumerate(lines):
        k = sets.find(i)
        first[k] = min(first.get(k, min(places[line])), min(places[line]))
    return {p: first[sets.find(i)] for i, line in enumerate(lines) for p in places[line]}


def test_lines_match_brute_force(spark, clashing):
    long_line = " ".join(prose(50, 60).split())
    variants = [long_line.replace(w, "other", 1) for w in long_line.split()[::6]]
    chain = [" ".join(long_line.split()[:50] + ["more", "words"][:k]) for k in range(3)]
    extra = [(100 + i, "own line number %d here\n%s" % (i, x)) for i, x in enumerate(variants + chain)]
    rows = [(r.doc_id, r.text) for r in clashing.collect()] + extra
    docs = clashing.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = line_rows([(d, t) for d, t in rows])
    got = linededup.verdicts(docs).collect()
    for r in got:
        here = (float("inf") if r.doc_id is None else r.doc_id, r.line_no)
        first = (float("inf") if r.first_doc == 2**63 - 1 else r.first_doc, r.first_line)
        assert first == want[here], here
        assert r.kept == (first == here)


def test_short_lines_and_changed_starts_match_brute_force(spark):
    rng = random.Random(3)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(7, 11)))

    pairs = []
    for n in range(240):
        line = " ".join(word() for _ in range(4 + n % 7))
        if n % 2:
            pairs.append((line, rng.choice("-*\"([>") + line))  # a bullet, quote or bracket before the line
        else:
            at = rng.choice([0, 1, len(line) - 1, len(line) - 2])
            pairs.append((line, line[:at] + "#" + line[at + 1 :]))
    rows = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    want = line_rows(rows)
    linked = sum(first != place for place, first in want.items())
    got = linededup.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(want[r.doc_id, r.line_no] == (r.first_doc, r.first_line) or r.kept for r in got)
    missed = sum(want[r.doc_id, r.line_no] != (r.first_doc, r.first_line) for r in got)
    assert linked > 200 and missed <= 0.01 * linked


def test_near_copies_of_long_words_meet(spark):
    rng = random.Random(4)
    rows = []
    for i in range(20):
        # 160 characters with 10 spaces, and the same with a full stop: nearly one space in 16 characters
        word = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(11)]
        line = " ".join(word)[:160]
        rows += [(2 * i, line), (2 * i + 1, line + ".")]
    got = linededup.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.first_doc for r in got} == {i: i - i % 2 for i in range(40)}


def test_signatures_are_dataframe_operations_and_one_permutation_minima(spark):
    plan, lines = linededup.LinePlan(), ["a", "eight ch", "nine char", "\U0001f600 " * 9, prose(6, 11), prose(7, 200, 200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(2, lines[2])], "key long, line string")
    signed = linededup.signatures(df, plan)
    shown = signed._jdf.queryExecution().toString()
    assert "Arrow" not in shown and "Python" not in shown and "Pandas" not in shown
    mask, n = 2**64 - 1, plan.bands * plan.rows

    def signed64(x):
        return x - (1 << 64) if x >> 63 else x

    for r in signed.collect():
        line = r.line
        grams = {line[i : i + 8] for i in range(max(1, len(line) - 7))}
        bins = [None] * n
        for gram in grams:
            h = signed64(xxhash.xxh64_intdigest(gram.encode("utf-32-be"), 42) | 1)
            at = max(i for i, start in enumerate(plan.starts()) if start < h)
            bins[at] = h if bins[at] is None else min(bins[at], h)
        full = [next(bins[i] for i in order if bins[i] is not None) for order in plan.orders()]
        want = []
        for b in range(plan.bands):
            h = xxhash.xxh64_intdigest(b.to_bytes(4, "little"), 42)
            for x in full[b * plan.rows : (b + 1) * plan.rows]:
                h = xxhash.xxh64_intdigest((x & mask).to_bytes(8, "little"), h)
            want.append(signed64(h))
        assert r.bands == want and r.copies == 1 + (r.key == 2)


def test_texts_are_split_once_and_lines_trimmed_where_needed(spark):
    raw = ["\tTab Before", "space after ", " \x0b\f\r both \r", "none", "\u00a0kept\u00a0", " ", "\r", ""]
    docs = spark.createDataFrame([(1, "\n".join(raw)), (2, None), (3, "")], "doc_id long, text string")
    lines = linededup.lines_of(docs)
    # a filter on the size of the split would make it a second time
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {(r.doc_id, r.line_no): r.line for r in lines.collect()}
    assert got == {(1, i): x.strip(" \t\n\x0b\f\r").lower() for i, x in enumerate(raw) if x.strip(" \t\n\x0b\f\r")}


def test_dedup_keeps_first_lines_and_columns(clashing):
    out = linededup.dedup(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert 1 in ids and 2 not in ids and {5, 6, 7, 15} <= ids
    text = {r.doc_id: r.text for r in rows}
    assert text[1] == [r.text for r in clashing.collect() if r.doc_id == 1][0]


def test_lines_of_nothing(no_docs):
    assert linededup.verdicts(no_docs).count() == 0
    assert linededup.dedup(no_docs).count() == 0
