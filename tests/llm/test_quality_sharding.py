import collections
import re

from pyspark.sql import functions as F

from sluice.llm import quality, sharding

SPACE = re.compile("[ \t-\r]+")


def expected(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            again += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, again, len(covered), failed


def test_counts_match_brute_force(clashing):
    rows = quality.judge(clashing).collect()
    assert len(rows) == clashing.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == expected(r.text), r.doc_id
        assert not (r.base_failed and r.kept)
    again = quality.judge(clashing, store=False).select(*quality.judge(clashing).columns).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_bad_host_goes_and_clean_hosts_stay(spark):
    good = "the quick brown fox jumps over a lazy dog while we all look on today"
    rows = [(i, good if (i % 10 or i % 7 == 6) else "too short", f"h{i % 7}") for i in range(700)]
    rows = [(i, "bad" if h == "h6" and i % 21 else t, h) for i, t, h in rows]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    verdict = {r.source: r.host_verdict for r in out}
    assert verdict["h6"] == "reject" and all(v == "ok" for h, v in verdict.items() if h != "h6")
    assert all(r.kept == (r.text == good) for r in out if r.source != "h6")
    assert not any(r.kept for r in out if r.source == "h6")


def test_small_hosts_are_shrunk():
    alpha, beta = quality.beta_prior(50, 0.1, 0.002, 0.01)
    assert (1 + alpha) / (1 + alpha + beta) < 0.5  # one failure of one document does not condemn a host


def test_quality_of_nothing(no_docs):
    assert quality.judge(no_docs).count() == 0


def test_shards_are_gapless_and_even(spark, clashing, tmpdir_path):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text")
    )
    rows = sharding.shard(docs, f"{tmpdir_path}/m", shards=8).collect()
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.size == len(r.text) + 8
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) <= 1.02 * min(load.values())
    edge = sharding.shard(clashing, f"{tmpdir_path}/e", shards=3).collect()
    assert len(edge) == clashing.count()
    by = collections.defaultdict(list)
    for r in edge:
        by[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())


def test_map_versions_and_rebalancing(spark, tmpdir_path):
    sizes = {s: 100 + s % 13 for s in range(sharding.SLOTS)}
    first = sharding.assign(sizes, 8)
    assert sharding.rebalance(first, sizes, 8) == first
    grown = sharding.rebalance(first, sizes, 9)
    moved = [s for s in first if first[s] != grown[s]]
    assert moved and all(grown[s] == 8 for s in moved)
    loads = collections.Counter()
    for s, shard in grown.items():
        loads[shard] += sizes[s]
    assert max(loads.values()) <= 1.05 * sum(sizes.values()) / 9
    shrunk = sharding.rebalance(grown, sizes, 8)
    assert set(shrunk.values()) == set(range(8))
    store = sharding.SlotMap(spark, f"{tmpdir_path}/map")
    assert store.write(first, sizes) == 1 and store.write(grown, sizes) == 2
    assert store.mapping() == grown and store.mapping(1) == first


def test_sharding_nothing(no_docs, tmpdir_path):
    assert sharding.shard(no_docs, f"{tmpdir_path}/m").count() == 0
