import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sluice.llm import katz, styletree, vectors
from sluice.llm.common import Scratch
from tests.llm.conftest import prose


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


def plain(html):
    """A page's text by its own markup only."""
    return styletree.main_text(styletree.read_page(html)[1], {}, frozenset())


def test_furniture_goes_and_text_stays():
    html = page(
        "<header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><article class='post no-ad'><header><h1>Title</h1>"
        "</header><p><b>First&nbsp;&amp; <i>best</i><br>line<p>Second<script>var x='</p>'</script></article>"
        "<div class='ad'>Buy</div><aside>Side</aside><div id=comments><p>Me too</p></div><form>Mail</form>"
        "<div style='display: none'>hidden</div><footer>&copy; us</footer>"
    )
    assert plain(html) == "Title\nFirst & best line\nSecond"
    assert plain("<div>" * 3000 + "deep") == "deep"
    assert plain(None) == "" and plain("") == ""
    assert plain("plain &lt; text") == "plain < text"


def test_names_that_only_sound_like_furniture():
    body = "<h1>Title</h1><p>First paragraph of the page.</p><p>Second one.</p>"
    want = "Title\nFirst paragraph of the page.\nSecond one."
    around = [
        '<div class="content no-sidebar">%s</div>', '<div class="layout with-sidebar">%s</div>', '<div class="has-banner">%s</div>',
        '<div class="article-body social-policy">%s</div>', '<form id="aspnetForm" method=post>%s<input type=text></form>',
        '<main>%s</main>', '<div class="sidebar">%s</div>', '<div id=overlay>%s</div>', '<section role=dialog>%s</section>',
    ]
    for outer in around:
        assert plain(page(outer % body)) == want, outer
        # beside real furniture
        mixed = outer % body + "<div class='sidebar-left'><p>Side</p></div><div class=commentlist><p>Me</p><p>too, and much more than that</p></div>"
        assert plain(page(mixed)) == want, outer
    assert plain(page("<article><div class='entry-header'><h1>T</h1></div><p>text of it</p></article>")) == "T\ntext of it"
    assert plain(page("<main><header><h1>T</h1></header><p>text of it</p></main>")) == "T\ntext of it"
    assert plain(page("<article><p>text of it</p></article><ol class=commentlist><li><p>a much longer comment</p></ol>")) == "text of it"
    assert plain(page("<article><p>text of it</p></article><form><label>Mail</label><input></form>")) == "text of it"
    for name in ("mainNav", "site-footer", "ad", "AdBox", "cookie-notice", "top_banner", "newsletter-signup", "share-buttons"):
        assert plain(page(f"<article><p>text of it</p></article><div class='{name}'>x y</div>")) == "text of it", name


def test_unclosed_comments_are_no_text():
    assert plain("<p>text</p><!-- never closed <p>more</p>") == "text"
    assert plain("<p>text</p><!-- closed --><p>more</p>") == "text\nmore"


def test_open_tags_cost_their_number():
    import time

    sizes = []
    for n in (1000, 6000):
        html = "<p>" + "<b>word " * n
        began = time.perf_counter()
        rows, pieces = styletree.read_page(html)
        sizes.append((len(rows), time.perf_counter() - began))
        assert len(pieces) == n and plain(html) == " ".join(["word"] * n)
    assert sizes[1][0] <= 6.1 * sizes[0][0] and sizes[1][1] < 0.5


def style_importances(pages):
    """Brute force: the tree of one host's different pages as nested dictionaries."""
    bodies = {}
    for html in pages:
        bodies[re.sub(r"(?is)<head[\s>].*?</head>", "", html)] = html
    count = collections.Counter(re.sub(r"(?is)<head[\s>].*?</head>", "", h) for h in pages)
    layouts, texts, on = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter()
    for html in bodies.values():
        seen = set()

        def walk(node, path):
            here = (*path, node.style)
            alive = [c for c in node.children if not isinstance(c, str) and c.role != styletree.GOES and c.tag not in styletree.UNSEEN]
            names = [c.style for c in alive]
            seen.add((here, "on", ""))
            seen.add((here, "layout", " ".join(n for i, n in enumerate(names) if not i or names[i - 1] != n)))
            block = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
            if block:
                seen.add((here, "text", block))
            for c in alive:
                if c.tag not in ("br", "wbr"):
                    walk(c, here)

        walk(styletree.parse(html), ())
        for here, kind, value in seen:
            (on.update([here]) if kind == "on" else (layouts if kind == "layout" else texts)[here].update([value]))
    assert count
    out = {}
    for here, n in on.items():
        below = [c for h, counter in texts.items() if h[: len(here)] == here for c in counter.values()]
        if n < 2 or not below or here[-1].split(".")[0].split("#")[0] in styletree.KEPT_WHOLE or here[-1] == "#":
            continue
        shown = layouts[here]
        total = sum(shown.values())
        entropy = (math.log(total) - sum(x * math.log(x) for x in shown.values()) / total) / math.log(max(n, 2))
        content = 1 - sum(map(math.log, below)) / len(below) / math.log(max(n, 2))
        damp = 0.9 ** len(shown)
        out[here] = round((((1 - damp) * entropy + damp * content) * n + 1) / (n + 1), 9)
    return out


def test_importances_match_a_tree_in_memory(spark):
    rows, by_host = [], collections.defaultdict(list)
    for i in range(60):
        host = f"h{i % 3}.example"
        text = " ".join(prose(i, 20).split())
        body = (
            f"<div class=x1><span>All our sites</span><i>{i % 4}</i></div><div class=x2><p>{text}</p>" + f"<p class=y>{i % 2}</p>" * (i % 5)
            + "</div><main><p>Read on</p><ul>" + "<li>one" * (i % 3) + f"</ul></main><div class=x3>Imprint {'a' if i % 7 else 'b'}</div>"
        )
        rows.append((i, f"http://{host}/{i}", page(body)))
        by_host[host].append(page(body))
    rows.append((99, "http://h0.example/copy", rows[0][2]))
    by_host["h0.example"].append(rows[0][2])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    parsed = pages.select(
        styletree.host_of(F.col("url")).alias("host"), F.xxhash64(F.regexp_replace("html", r"(?is)<head[\s>].*?</head>", "")).alias("body"),
        styletree.parsed_pages(F.col("html")).alias("p"))
    got = {(r.host, r.node): r.importance for r in styletree.importances(parsed.select("host", "body", "p.rows"), Scratch(spark, "test")).collect()}

    def key(path):
        k = 0
        for style in path:
            k = styletree._node_key(k, style)
        return k

    want = {(h, key(path)): v for h, of in by_host.items() for path, v in style_importances(of).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    assert any(v < 0.4 for v in want.values()) and any(v > 0.6 for v in want.values())


def test_unmarked_boilerplate_is_found_by_the_tree(spark):
    rows = []
    for i in range(40):
        text = " ".join(prose(i, 40).split())
        body = f"<div class=x1><span>All our sites</span></div><div class=x2><p>{text}</p></div><div class=x3>Imprint</div>"
        rows.append((i, f"https://user@Big.example:80/{i}", page(body), text))
    rows.append((40, "http://small.example/", page("<div class=x1>Only here</div>"), "Only here"))
    rows.append((41, None, page("<div class=x1>No host</div>"), "No host"))
    rows.append((42, "http://empty.example/", None, ""))
    # a host of copies keeps its text: nothing else is left of its pages
    rows += [(50 + i, "http://copies.example/", page("<div><p>same text</p></div>"), "same text") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string").withColumn("low", F.lit(1))
    out = styletree.extract(pages)
    assert out.columns == [*pages.columns, "text"]
    for r in out.collect():
        assert r.text == r.want, r.page_id


def test_hosts_of_few_pages_lose_unmarked_boilerplate(spark):
    rows = []
    for size in (2, 3, 4, 9):
        for i in range(size):
            text = " ".join(prose(100 * size + i, 40).split())
            body = f"<div class=x1><span>All our sites</span></div><div class=x2><p>{text}</p></div><div class=x3>Imprint</div>"
            rows.append((100 * size + i, f"http://of{size}.example/{i}", page(body), text))
    # copies are one page, whatever their heads say, and have nothing to be compared with
    for i in range(3):
        copy = f"<html><head><title>{i}</title></head><body><div><p>same text</p></div><div class=x3>Imprint</div></body></html>"
        rows.append((2000 + i, "http://copies.example/", copy, "same text\nImprint"))
    out = styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string"))
    for r in out.collect():
        assert r.text == r.want, r.page_id


def test_repeated_notices_in_articles_go_and_copies_stay(spark):
    rows = []
    for i in range(12):
        text = " ".join(prose(i, 40).split())
        for k, tag in enumerate(("article", "main")):
            notice = "<p class='x7'>Read our terms before you go on.</p><h4 class=x8>Stay with us</h4>"
            body = f"<{tag}><h1>Title {i}</h1><p>{text}</p>{notice}</{tag}>"
            rows.append((100 * k + i, f"http://{tag}.example/{i}", page(body), f"Title {i}\n{text}"))
        # only the repeated notice is a paragraph
        body = f"<main><p class='x7'>Read our terms.</p><div>{text}</div></main>"
        rows.append((200 + i, f"http://divs.example/{i}", page(body), text))
        # near copies: the article's paragraphs are the same on all pages, its date is not
        body = f"<article><h2>News</h2><p>A long paragraph on every page.</p><span>Day {i}</span></article>"
        rows.append((300 + i, f"http://near.example/{i}", page(body), f"News\nA long paragraph on every page.\nDay {i}"))
    out = styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string"))
    for r in out.collect():
        assert r.text == r.want, r.page_id


def test_pages_of_nothing(spark):
    assert styletree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def unit_rows():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        rows.append((i, rng.normal(size=16), i % 3))
    for i in range(300):  # noisy copies around the threshold
        v = rows[i][1]
        rows.append((600 + i, v + rng.normal(size=16) * rng.uniform(0.01, 0.08) * np.linalg.norm(v), rows[i][2]))
    rows = [(i, [float(x) for x in v], lab) for i, v, lab in rows]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0)]
    rows += [(2004, rows[0][1], None), (2005, [float("inf")] + [1.0] * 15, 0), (2006, [], 0), (2007, [1.0, 2.0], 0)]
    rows += [(None, rows[1][1], 1), (2008, rows[0][1], 0), (2008, rows[0][1], 0)]
    return rows


def test_links_match_brute_force(spark):
    rows = unit_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rid", F.lit(1))
    for plan in (vectors.Collisions(), vectors.Collisions(tile=50)):
        got = vectors.group(table, plan=plan).collect()
        assert len(got) == len(rows)
        good = [
            k
            for k, (_, v, lab) in enumerate(rows)
            if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ]
        links = collections.defaultdict(set)
        for a in good:
            for b in good:
                if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                    x, y = (np.array(rows[k][1], dtype="f4").astype("f8") for k in (a, b))
                    if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 - 1e-12:
                        links[a].add(b)
        want = collections.Counter()
        for k, r in enumerate(rows):
            want[r[0], len(links[k])] += 1
        have = collections.Counter((r.vec_id, r.n_links) for r in got)
        missed = sum((want - have).values())
        assert missed <= 0.02 * len(rows)
        assert sum(r.n_links for r in got) >= 0.97 * sum(len(x) for x in links.values())
        for r in got:
            if r.vec_id is not None and 2000 <= r.vec_id <= 2007:
                assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
        assert {r.component_id for r in got if r.vec_id in (0, 1000, 1039, 2008)} == {0}


def test_recall_is_calibrated():
    assert vectors.Collisions().recall > 0.998


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.group(empty).count() == 0


def brute_scores(docs):
    """The model from its formulas, with plain dictionaries."""
    texts = [(i, (t or "").encode().lower().split() + [katz.END]) for i, t in docs]
    trains = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in texts]
    words, pairs, history = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, tokens), train in zip(texts, trains, strict=True):
        if train:
            words.update(tokens)
            for h, w in zip([katz.START, *tokens], tokens):
                pairs[h, w] += 1
                history[h] += 1

    def discounts(counts):
        n = [sum(c == r for c in counts.values()) for r in range(1, 7)]
        d = katz.good_turing(n)
        return {r: (r * d[r - 1] if r <= 5 else r) for r in set(counts.values())}, sum(
            r * c * (1 - f) for r, (c, f) in enumerate(zip(n, d), 1)
        )

    (unigram, left), (bigram, _) = discounts(words), discounts(pairs)
    n, v = sum(words.values()), len(words)
    total = n if left else n + 1

    def p(w):
        return (unigram[words[w]] if words[w] else (left or 1.0)) / total if n else 1.0

    after = collections.defaultdict(list)
    for (h, w), r in pairs.items():
        after[h].append((w, r))
    alpha = {
        h: (1 - sum(bigram[r] for _, r in ws) / (history[h] + 1)) / (1 - sum(p(w) for w, _ in ws))
        for h, ws in after.items()
    }

    def q(h, w):
        r = pairs[h, w]
        return bigram[r] / (history[h] + 1) if r else alpha.get(h, 1.0) * p(w)

    for h in [*list(after)[:20], katz.START, b"never seen"]:
        if n:
            assert math.isclose(sum(q(h, w) for w in [*words, b"never seen"]), 1.0, rel_tol=1e-9)
    out = []
    for (i, tokens), train in zip(texts, trains, strict=True):
        score = sum(math.log10(q(h, w)) for h, w in zip([katz.START, *tokens], tokens))
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((i, not train, len(tokens), sum(words[w] > 0 for w in tokens), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def as_rows(scored):
    return sorted(
        (
            (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
            for r in scored.collect()
        ),
        key=str,
    )


def test_scores_match_brute_force(spark, clashing, tmpdir_path):
    more = spark.createDataFrame([(200 + i, prose(i, 80)) for i in range(60)], "doc_id long, text string")
    docs = clashing.select("doc_id", "text").unionByName(more).repartition(5)
    scored = katz.score(docs, keep_model=f"{tmpdir_path}/model")
    assert as_rows(scored) == brute_scores([(r.doc_id, r.text) for r in docs.collect()])
    model = spark.read.parquet(f"{tmpdir_path}/model")
    totals = {r.kind: r.n for r in model.where("field = 'count'").groupBy("kind").agg(
        F.sum(F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    assert totals["word"] == totals["pair"] == scored.first().train_tokens


def test_blocks_are_small_rows():
    text = " ".join(f"w{i * i % 3001}" for i in range(200_000))
    rows = pa.table({"doc_id": [1, 2], "text": [text, "w1 w0 w1"], "train": [True, False]}).to_batches()
    (stored,) = katz._make_blocks(rows)
    assert stored.nbytes < 2.5 * 200_000  # four bytes a token as an array
    (block,) = katz.Block.each(stored)
    left, right, counts = block.pair_counts()
    again = block.pairs()
    assert left.tolist() == again[0].tolist() and right.tolist() == again[1].tolist()
    assert counts.tolist() == np.bincount(again[2][block.in_train], minlength=len(left)).tolist()
    keys = katz.pair_keys(block.history_keys()[left], block.words[right])
    asked = katz._ask(keys, counts, block.number, 7)
    assert asked.nbytes < 11 * len(keys) + 1000  # a key's eight bytes, and no four for a count


def test_large_rows_get_row_groups_of_some_megabytes(spark, tmpdir_path):
    scratch = Scratch(spark, "wide")
    wide = spark.range(0, 40, 1, 1).select(F.expr("transform(sequence(1, 60000), i -> xxhash64(id, i))").alias("v"))
    stored = scratch.write(wide, "wide", options=katz.SMALL_PAGES)
    (part,) = [f for f in stored.inputFiles() if "part-" in f]
    data = pq.ParquetFile(part.removeprefix("file:")).metadata
    assert max(data.row_group(i).total_byte_size for i in range(data.num_row_groups)) < 24e6
    scratch.clear()


def test_scores_without_training_texts(spark, no_docs):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string")
    assert as_rows(katz.score(docs)) == brute_scores([(i, "a b a") for i in held])
    assert katz.score(no_docs).count() == 0


def test_discounts_fall_back():
    assert katz.good_turing([0, 0, 0, 0, 0, 0]) == tuple((r - 0.5) / r for r in range(1, 6))
    assert all(0 < d <= 1 for d in katz.good_turing([100, 40, 20, 12, 8, 6]))
