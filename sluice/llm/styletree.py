"""Main-text extraction with a site style tree.

The DOM trees of all pages of a host are merged by presentation: nodes with
the same path of tags, classes and ids are one style-tree node. A node's
presentation importance is the entropy of the child layouts seen under it,
its content importance is one minus the mean entropy of the text blocks
below it over the host's pages (a block on every page says nothing about a
page). Both are blended by the number of layouts and shrunk towards full importance
by a prior, so that few pages need clearer evidence than many; branches of
low importance are removed from each page. Markup that names its own role (menus, footers,
adverts, forms, comments and so on) is removed on any page, so hosts of a
single page are cleaned as well; but a branch that holds more than half of a
page's paragraphs and headings is content, whatever its name.

The tree exists only as rows: pages give (node, parent), (node, layout) and
(node, block) rows, which are counted with map-side combining, so a host with a
third of all pages costs a row per node and task. A block is a row of its own
node; sums over branches are added up the tree by pointer doubling, so depth
costs its logarithm. Pages are then cut with the list of low nodes of their
host.

Defined results: a null or empty page has an empty text; a page without a
host is pruned by roles only; very long pages are read whole; pages of a
host that are equal but for their head count as one; empty tables give empty tables; extra columns pass through
and clashing ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, fresh, maybe_broadcast, small_batches

# rows of the tree: a node on a page (with its parent), the layout of its children, a block of its text; a node never cut
PAGE, LAYOUT, BLOCK, KEPT = 0, 1, 2, 3
# all low nodes together are broadcast up to this size
LOW_BYTES = 32 << 20
PAGES_PER_BATCH = 200


@dataclass(frozen=True)
class TreePolicy:
    """A branch goes below ``least`` importance, with ``prior`` pages of full importance added; ``gamma`` damps layouts."""

    least: float = 0.4
    prior: float = 1.0
    gamma: float = 0.9


# HTML element classes, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript svg math iframe object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("body html tbody td tfoot th thead tr dd dt li summary figcaption".split())
# an opening tag ends the open siblings named here, up to the nearest of the containers
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPES = frozenset("td th table button caption object".split())
# Elements, class words and roles that name page furniture.
FURNITURE = frozenset("aside form dialog".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets ad ads advert adverts "
    "advertisement adsense banner promo promos sponsor sponsors sponsored cookie cookies consent notice notices popup modal "
    "overlay newsletter subscribe signup share sharing social related recommended respond search login pagination pager "
    "skip header".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist commentform disqus reply replies".split())
# words that may stand beside a role in a name without changing it
NEUTRAL_WORDS = frozenset(
    "site page global main primary secondary left right top bottom upper lower outer inner wrapper wrap container holder box "
    "bar block area section region column col row list items item group links link menu button buttons icons form text "
    "inline fixed sticky mobile desktop unit slot zone panel x".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu form".split())
KEPT_WHOLE = frozenset("# html body main article".split())
# no role, one that always goes, one that goes unless it holds most of the page
PLAIN, GOES, MAY_GO = 0, 1, 2
ALWAYS_GO = frozenset("nav menu footer button select textarea input".split())
# what an article's text is made of
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre".split())


@dataclass(slots=True)
class Node:
    tag: str
    style: str
    role: int
    children: list = field(default_factory=list)


class _Builder(HTMLParser):
    """A forgiving DOM: implied ends for paragraphs, items and cells; stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", "#", PLAIN)
        self.open = [self.root]
        # open elements by tag: a search of the stack for a tag that is not open would cost the page's depth
        self.count: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, SCOPES)
        elif tag in IMPLIED:
            self._end(*IMPLIED[tag])
        in_article = bool(self.count.get("article") or self.count.get("main"))
        node = Node(tag, _style(tag, attrs), _role(tag, attrs, in_article))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end({tag}, ())

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _end(self, tags, stops):
        """Close the nearest open element of these tags, and all within it, if no stop is nearer."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                for node in self.open[i:]:
                    self.count[node.tag] -= 1
                del self.open[i:]
                return
            if self.open[i].tag in stops:
                return


def _style(tag: str, attrs: list) -> str:
    if not attrs:
        return tag
    named = [f"{'#' if k == 'id' else '.'}{' '.join(v.split())}" for k, v in attrs if k in ("id", "class") and v]
    return re.sub(r"\d{3,}", "0", tag + "".join(named)) if named else tag  # long numbers are ids of pages


def _names(value: str) -> Iterator[list[str]]:
    """The words of each name in a class or id: ``site-Footer mainNav`` are [site, footer], [main, nav]."""
    for name in value.split():
        yield [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]


def _role(tag: str, attrs: list, in_article: bool) -> int:
    """What an element's markup says it is. A name counts if it holds a role's word and else only neutral words, so
    ``no-sidebar``, ``entry-header`` or ``social-policy`` name no role."""
    if tag in ALWAYS_GO:
        return GOES
    role = MAY_GO if tag in FURNITURE else PLAIN
    if tag == "header" and not in_article:
        role = MAY_GO
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return role if tag in KEPT_WHOLE else GOES
        if not value:
            continue
        if key in ("class", "id") and tag not in ("html", "body"):
            for words in _names(value):
                if any(w in COMMENT_WORDS for w in words) and all(w in COMMENT_WORDS or w in NEUTRAL_WORDS for w in words):
                    return GOES
                known = [w for w in words if w in FURNITURE_WORDS and not (w == "header" and in_article)]
                if known and tag not in KEPT_WHOLE and all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS for w in words):
                    role = MAY_GO
        elif key == "role" and value.lower() in FURNITURE_ROLES and tag not in KEPT_WHOLE:
            role = MAY_GO
        elif key == "style" and "display:none" in value.replace(" ", "").lower() and tag not in KEPT_WHOLE:
            return GOES
    return role


def parse(html: str | None) -> Node:
    """The page's tree, roles decided: a branch that holds more than half of the page's paragraphs and headings (of its
    text, where there are none) is no furniture, whatever its name."""
    builder = _Builder()
    builder.feed(html or "")
    if builder.rawdata.startswith("<!--"):
        builder.rawdata = ""  # a comment that is never closed goes to the end of the page
    builder.close()
    _decide(builder.root)
    return builder.root


def _decide(root: Node) -> None:
    """Turn ``MAY_GO`` into ``GOES`` or ``PLAIN``, bottom-up without recursion."""
    order: list[tuple[Node, Node | None, bool]] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    may = False
    while todo:
        node, parent, prose = item = todo.pop()
        order.append(item)
        may = may or node.role == MAY_GO
        prose = prose or node.tag in PROSE or node.tag in HEADINGS
        for child in node.children:
            if not isinstance(child, str) and child.role != GOES and child.tag not in UNSEEN:
                todo.append((child, node, prose))
    if not may:
        return
    sizes: dict[int, list[int]] = {id(node): [0, 0] for node, _, _ in order}
    for node, parent, prose in reversed(order):
        prose = prose or node.tag in PROSE or node.tag in HEADINGS
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        size = sizes[id(node)]
        size[0] += own if prose else 0
        size[1] += own
        if parent is not None:
            above = sizes[id(parent)]
            above[0] += size[0]
            above[1] += size[1]
    which = 0 if sizes[id(root)][0] else 1
    whole = sizes[id(root)][which]
    for node, _, _ in order:
        if node.role == MAY_GO:
            node.role = PLAIN if 2 * sizes[id(node)][which] > whole else GOES


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _node_key(parent: int, style: str) -> int:
    """A style-tree node: its parent's key and its own style, so a path of any length costs one step."""
    return xxhash.xxh64_intdigest(style.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1) - (1 << 63)


# pieces of text: bits for the first of a block, in a paragraph, in a heading
STARTS, IN_PROSE, IN_HEADING = 1, 2, 4


def read_page(html: str | None) -> tuple[set[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """A page's rows for the tree, ``(node, kind, value)``, each once, and its pieces of text in page order:
    ``(node, article, bits, text)``, ``article`` being the node of the outermost article or main element around it.

    One parse gives both; depth first without recursion, so deep nesting
    costs no stack. A block's text is a row of its own element only.
    """
    rows: set[tuple[int, int, int]] = set()
    pieces: list[tuple[int, int, int, str]] = []
    starts = STARTS
    # (node or text, its parent's key, article, bits); None ends a block
    todo: list[tuple] = [(parse(html), 0, 0, 0)]
    while todo:
        item, above, article, bits = todo.pop()
        if item is None:
            starts = STARTS
            continue
        if isinstance(item, str):
            pieces.append((above, article, bits | starts, item))
            starts = 0
            continue
        tag = item.tag
        if item.role == GOES or tag in UNSEEN:
            if tag in BLOCKS:
                starts = STARTS
            continue
        if tag == "br" or tag == "wbr":
            pieces.append((above, article, bits | starts, " " if tag == "br" else ""))
            starts = 0
            continue
        key = _node_key(above, item.style)
        layout, words = [], []
        for child in item.children:
            if isinstance(child, str):
                words.append(child)
            elif child.tag not in UNSEEN and child.role != GOES and (not layout or layout[-1] != child.style):
                layout.append(child.style)
        rows.add((key, KEPT if tag in KEPT_WHOLE else PAGE, above))
        rows.add((key, LAYOUT, _hash(" ".join(layout))))
        block = " ".join("".join(words).split())
        if block:
            rows.add((key, BLOCK, _hash(block)))
        if not article and tag in ("article", "main"):
            article = key
        bits |= (IN_PROSE if tag in PROSE else 0) | (IN_HEADING if tag in HEADINGS else 0)
        if tag in BLOCKS:
            starts = STARTS
            todo.append((None, 0, 0, 0))
        todo += [(child, key, article, bits) for child in reversed(item.children)]
    return rows, pieces


def main_text(pieces: list[tuple[int, int, int, str]], parents: dict[int, int], low: frozenset[int]) -> str:
    """A page's text without the branches in ``low``; ``parents`` leads from each of its nodes to the one above.

    If the low branches hold all of a page's text (a host of copies), only
    furniture is removed; so in an article (or main element) if they hold all
    of its paragraphs and these are most of its text (near copies).
    """
    if not low:
        return _joined(pieces)
    cut: dict[int, bool] = {0: False}

    def is_cut(node: int) -> bool:
        """Whether the node or one above it is low; what is found on the way is kept."""
        path = []
        while node not in cut:
            path.append(node)
            node = parents[node]
        gone = cut[node]
        for node in reversed(path):
            gone = gone or node in low
            cut[node] = gone
        return gone

    spared = _spared(pieces, is_cut)
    kept, starts = [], 0
    for node, article, bits, text in pieces:
        starts |= bits & STARTS
        if not is_cut(article if article in spared else node):
            kept.append((node, article, bits | starts, text))
            starts = 0
    return _joined(kept) or _joined(pieces)


def _joined(pieces: list[tuple[int, int, int, str]]) -> str:
    blocks: list[list[str]] = []
    for _, _, bits, text in pieces:
        if bits & STARTS or not blocks:
            blocks.append([])
        blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _spared(pieces: list[tuple[int, int, int, str]], is_cut) -> set[int]:
    """Articles whose paragraphs all lie in low branches, and are longer than their other text without headings."""
    lost, other, whole = {}, {}, set()
    for node, article, bits, text in pieces:
        size = len(text.strip())
        if not article or not size or bits & IN_HEADING:
            continue
        gone = is_cut(node)
        if bits & IN_PROSE:
            if gone:
                lost[article] = lost.get(article, 0) + size
            else:
                whole.add(article)
        elif not gone:
            other[article] = other.get(article, 0) + size
    return {a for a, n in lost.items() if a not in whole and n > other.get(a, 0) and not is_cut(a)}


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty when there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


ROW = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())])
PIECE = pa.struct([("node", pa.int64()), ("article", pa.int64()), ("bits", pa.int32()), ("text", pa.string())])
PARSED = pa.struct([("rows", pa.list_(ROW)), ("pieces", pa.list_(PIECE))])


PARSED_DDL = (
    "struct<rows:array<struct<node:long,kind:int,value:long>>,pieces:array<struct<node:long,article:long,bits:int,text:string>>>"
)


def _list_column(sizes: list[int], kind: pa.DataType, columns: list[pa.Array]) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))


def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for htmls in batches:
        # a page's rows and pieces become arrays before the next page is parsed
        rows, numbers, texts = [np.empty((0, 3), np.int64)], [np.empty((0, 3), np.int64)], [pa.array([], pa.string())]
        for html in htmls:
            of_tree, pieces = read_page(html.as_py())
            rows.append(np.array(list(of_tree), dtype=np.int64).reshape(-1, 3))
            numbers.append(np.array([x[:3] for x in pieces], dtype=np.int64).reshape(-1, 3))
            texts.append(pa.array([x[3].encode("utf-8", "replace").decode() for x in pieces], pa.string()))
        flat, marks = np.concatenate(rows), np.concatenate(numbers)
        of_rows = [pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2])]
        of_pieces = [pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(marks[:, 2].astype(np.int32)), pa.concat_arrays(texts)]
        sizes = [len(x) for x in rows[1:]], [len(x) for x in numbers[1:]]
        both = zip(sizes, (of_rows, of_pieces), PARSED, strict=True)
        yield pa.StructArray.from_arrays([_list_column(n, f.type, c) for n, c, f in both], fields=list(PARSED))


def parsed_pages(html: Column) -> Column:
    """Every page's rows and pieces."""
    return F.arrow_udf(_parsed, PARSED_DDL)(html)


def _below(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, node, blocks, block_log`` of every node with all nodes below it added.

    ``nodes`` has a node's own values and its ``parent`` (0 above the root).
    By doubling: after round k a node has the sums of all nodes less than
    2**k levels below it and a pointer 2**k levels up, so a tree of any depth
    d takes log2(d) rounds.
    """
    current = scratch.write(nodes.select("host", "node", F.col("parent").alias("up"), "blocks", "block_log"), "below")
    while True:
        hanging = current.where("up <> 0")
        if hanging.isEmpty():
            return current.select("host", "node", "blocks", "block_log")
        added = hanging.groupBy("host", F.col("up").alias("node")).agg(
            F.sum("blocks").alias("more"), F.sum("block_log").alias("more_log")
        )
        further = current.select("host", F.col("node").alias("up"), F.col("up").alias("next"))
        following = scratch.write(
            current.join(added, ["host", "node"], "left")
            .join(further, ["host", "up"], "left")
            .select(
                "host",
                "node",
                F.coalesce("next", F.lit(0)).alias("up"),
                (F.col("blocks") + F.coalesce("more", F.lit(0))).alias("blocks"),
                (F.col("block_log") + F.coalesce("more_log", F.lit(0.0))).alias("block_log"),
            ),
            "below",
        )
        scratch.drop(current)
        current = following


def importances(parsed: DataFrame, scratch: Scratch, policy: TreePolicy = TreePolicy()) -> DataFrame:
    """``host, node, pages, importance`` of the style-tree nodes that have text below them and two pages or more;
    elements that are never cut are left out. ``parsed`` has ``host, body, rows``."""
    hosted = parsed.where(F.col("host") != "")
    # equal pages share the weight of one; the head is no part of the tree
    copies = scratch.write(hosted.groupBy("host", "body").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    few = maybe_broadcast(copies.withColumnsRenamed({"host": "copy_host", "body": "copy_body"}))
    seen = (
        hosted.join(few, (F.col("host") == F.col("copy_host")) & (F.col("body") == F.col("copy_body")), "left")
        .select("host", (1 / F.coalesce("copies", F.lit(1))).alias("weight"), F.explode("rows").alias("r"))
        .groupBy("host", "r.node", "r.kind", "r.value")
        .agg(F.greatest(F.round(F.sum("weight")), F.lit(1.0)).alias("n"))
    )
    n = F.col("n")
    is_page = F.col("kind").isin(PAGE, KEPT)
    is_layout, is_block = (F.col("kind") == k for k in (LAYOUT, BLOCK))
    nodes = scratch.write(
        seen.groupBy("host", "node").agg(
            F.sum(F.when(is_page, n)).alias("pages"),
            F.max(F.when(is_page, F.col("value"))).alias("parent"),
            F.max(F.when(F.col("kind") == KEPT, 1).otherwise(0)).alias("kept"),
            F.count(F.when(is_layout, 1)).alias("layouts"),
            F.sum(F.when(is_layout, n)).alias("shown"),
            F.sum(F.when(is_layout, n * F.ln(n))).alias("shown_log"),
            F.count(F.when(is_block, 1)).alias("blocks"),
            F.coalesce(F.sum(F.when(is_block, F.ln(n))), F.lit(0.0)).alias("block_log"),
        ),
        "nodes",
    )
    summed = _below(nodes, scratch)
    known = nodes.drop("blocks", "block_log").join(summed, ["host", "node"])
    # a node of one page has nothing to be compared with
    judged = known.where((F.col("pages") >= 2) & (F.col("blocks") > 0) & (F.col("kept") == 0))
    log_pages = F.ln(F.greatest("pages", F.lit(2.0)))
    # entropy to the base of the page count: (ln N - sum(n ln n) / N) / ln pages
    presentation = (F.ln("shown") - F.col("shown_log") / F.col("shown")) / log_pages
    content = 1 - F.col("block_log") / F.col("blocks") / log_pages
    damp = F.pow(F.lit(policy.gamma), F.col("layouts"))
    importance = (1 - damp) * presentation + damp * content
    shrunk = (importance * F.col("pages") + policy.prior) / (F.col("pages") + policy.prior)
    # sums come in any order: the last digits say nothing
    return judged.select("host", "node", "pages", F.round(shrunk, 9).alias("importance"))


def extract(pages: DataFrame, policy: TreePolicy = TreePolicy(), carry: list[str] | None = None) -> DataFrame:
    """Pages with ``text``, their main text; ``carry`` names the input columns to return (default all).

    Pages are parsed once: their rows and pieces are stored, and the text is
    put together from the pieces. The low nodes of a host come to its pages
    by a broadcast if all of them together are small, else by a join.
    """
    scratch = Scratch(pages.sparkSession, "styletree")
    small_batches(pages, PAGES_PER_BATCH)
    keep = [c for c in (pages.columns if carry is None else carry) if c != "text"]
    body = F.xxhash64(F.regexp_replace("html", r"(?is)<head[\s>].*?</head>", ""))
    stored = scratch.write(
        pages.select(
            F.struct(*[F.col(c) for c in keep]).alias("record"),
            host_of(F.col("url")).alias("host"),
            body.alias("body"),
            parsed_pages(F.col("html")).alias("p"),
        ),
        "pages",
    )
    judged = importances(stored.select("host", "body", "p.rows"), scratch, policy)
    low = scratch.write(
        judged.where(F.col("importance") < policy.least).groupBy("host").agg(F.collect_set("node").alias("low")), "low"
    )
    size = low.agg(F.coalesce(F.sum(F.size("low") * 8 + F.octet_length("host") + 32), F.lit(0))).first()[0]

    @F.arrow_udf("string")
    def texts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, pieces, lows in batches:
            out = []
            for i in range(len(rows)):
                own = list(zip(*(c.to_pylist() for c in pieces[i].values.flatten()), strict=True))
                if not lows[i].is_valid:
                    out.append(_joined(own))
                    continue
                nodes, kinds, above = (c.to_numpy(zero_copy_only=False) for c in rows[i].values.flatten())
                is_page = (kinds == PAGE) | (kinds == KEPT)
                parents = dict(zip(nodes[is_page].tolist(), above[is_page].tolist(), strict=True))
                out.append(main_text(own, parents, frozenset(lows[i].values.to_pylist())))
            yield pa.array(out, pa.string())

    side = low.withColumnRenamed("host", "low_host")
    joined = stored.join(F.broadcast(side) if size <= LOW_BYTES else side, F.col("host") == F.col("low_host"), "left")
    return joined.select("record.*", texts(F.col("p.rows"), F.col("p.pieces"), F.col("low")).alias("text"))
