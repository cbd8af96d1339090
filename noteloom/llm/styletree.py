"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node for each path of tags and classes from the body down. Of a node we
know on how many pages it stands, with which presentations (the tags right below it) and with which content. Its
importance is the entropy of each of the two over the host's pages, to the base of the number of pages: near 0 for what every page
repeats in the same form, near 1 for what differs from page to page. Copies of a page
count once, so they don't make its text unimportant. The tree is held as counts by host, node and feature, added up before they are
shuffled, so no task holds a host.

Every branch is judged, menus and adverts as well as parts of articles. Without article or main elements, and inside of them, a branch of
a page goes if the more important of its node's two sides is below IMPORTANCE. (Inside, copies of one element's text count once, so that pages that
differ around it only don't make it unimportant; such an element itself and what holds it always stay.) Beside them the branch has to be as
diverse as articles are: it stays only if its node is judged and its importance is ALIKE or more, so that a menu drawn from some
dozens of forms goes.

What the tree can't see - hosts with few pages, or with a menu that differs on every page - is left to a prior: kinds of elements and names of
classes known for menus, headers, footers, sidebars, notices, adverts, forms and comments go in any case. prior=False leaves it
out, so that what the tree decides alone can be told.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, as_bytes, saved

#: Importance under which a node's branches go, the importance that one beside an article needs to stay, and the pages of a host from
#: which a node is judged.
IMPORTANCE, ALIKE, PAGES = 0.35, 0.95, 4

_PRIME, _RADIX = (1 << 61) - 1, 0x9E3779B97F4A7C15 % ((1 << 61) - 1)

# Element and class names of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg canvas select button".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("nav footer aside form fieldset head menu dialog label audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner menu menus nav navbar navigation breadcrumb "
    "breadcrumbs header footer foot sidebar side aside rail widget widgets notice notices notification alert cookie cookies consent gdpr popup modal overlay subscribe "
    "subscription newsletter signup login comment comments reply replies respond discussion disqus share sharing social related recommended recommendations pagination pager "
    "masthead copyright legal disclaimer toolbar skip search form".split())
#: Of elements that end others of their family: the family's name and the elements it doesn't reach out of.
FAMILY = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option", "p": "p"}
HOLDS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "table": ("tr", "td", "p"), "tr": ("td",), "select": ("option",), "button": ("p",), "td": ("p",), "th": ("p",)}
_ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """scope: the open elements of each family that an element here would end; inside: whether an article holds it."""

    __slots__ = ("tag", "kind", "noise", "kids", "parent", "scope", "inside")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.kind, self.noise = tag, tag in DROP
        self.scope, self.inside = ({}, False) if parent is None else (parent.scope, parent.inside or parent.tag == "article")
        if tag in FAMILY or tag in HOLDS:
            self.scope = {k: v for k, v in self.scope.items() if k not in HOLDS.get(tag, ())}
            if tag in FAMILY:
                self.scope[FAMILY[tag]] = self
        if attrs and "=" in attrs or attrs.strip() == "hidden":
            found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            label = f"{found.get('class', '')} {found.get('id', '')}".strip()
            if label:
                names = _NAME.findall(_CAMEL.sub(" ", html.unescape(label)).lower())
                self.kind = f"{tag}.{'.'.join(n for n in names if n.isalpha())}"
                self.noise = self.noise or tag not in ("html", "body", "main") and not NOISE.isdisjoint(names)
            self.noise = (self.noise or found.get("role", "").lower() in ROLES or "hidden" in found
                          or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower())


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag whose name ends at a place, -1 without one. A > in a quoted value doesn't end it; a quote that
    is never closed is a plain character."""
    while True:
        m = _STOP.search(page, at)
        if m is None or m[1] is None:
            return -1 if m is None else m.start()
        close = page.find(m[1], m.end())
        if close < 0:
            return page.find(">", at)
        at = close + 1


def parse(page: str) -> Node:
    """A page's tree of elements and texts; open elements are closed where HTML lets them be. Time is linear in the page: what is open is
    counted by tag, and elements know what they would end, so nothing is looked for along the branch in vain."""
    root = top = Node("root", "", None)
    at, low, open_ = 0, None, {}

    def leave(node: Node) -> Node:
        """Closes node and what is open inside."""
        nonlocal top
        while True:
            open_[top.tag] -= 1
            top, closed = top.parent, top
            if closed is node:
                return top

    while True:
        m = _OPEN.search(page, at)
        if m is None:
            rest = page[at:]
            if rest:
                top.kids.append(rest)
            return root
        if m.start() > at:
            top.kids.append(page[at:m.start()])
        if m[1]:
            close = page.find("-->", m.end() - 2)
            at = len(page) if close < 0 else close + 3
            continue
        end = page.find(">", m.end()) if m[2] or m[3] else _tag_end(page, m.end())
        if end < 0:  # the page ends inside a tag
            return root
        at = end + 1
        if m[2]:
            continue
        tag = m[4].lower()
        if m[3]:
            if open_.get(tag):
                node = top
                while node.tag != tag:
                    node = node.parent
                leave(node)
            elif tag == "p":
                top.kids.append(Node("p", "", top))
            continue
        attrs = page[m.end():end]
        if tag in RAW:
            low = page.lower() if low is None else low
            close = low.find(f"</{tag}", at) if len(low) == len(page) else -1
            if close < 0 and len(low) != len(page):
                found = re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
                close = found.start() if found else -1
            close = -1 if close < 0 else page.find(">", close)
            at = len(page) if close < 0 else close + 1
            continue
        if tag in _ENDS_P and "p" in top.scope:
            leave(top.scope["p"])
        if tag in FAMILY and tag != "p" and FAMILY[tag] in top.scope:
            leave(top.scope[FAMILY[tag]])
        node = Node(tag, attrs, top)
        if tag == "header":
            if node.inside:
                node.kind = tag
            node.noise = not node.inside
        top.kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            open_[tag] = open_.get(tag, 0) + 1
            top = node


def _around(nodes: list[Node]) -> set[int]:
    """The ids of the nodes' ancestors."""
    out: set[int] = set()
    for node in nodes:
        node = node.parent
        while node is not None and id(node) not in out:
            out.add(id(node))
            node = node.parent
    return out


def _main(root: Node) -> list[Node]:
    """The outermost article or main elements that are no noise themselves; of main elements those without such inside."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            found.append(node)
        if node.tag != "article":
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.noise)
    holders = _around(found)
    return [n for n in found if n.tag == "article" or id(n) not in holders]


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_nodes(root: Node, mains: set[int]) -> Iterator[tuple[int, Node, Node | None]]:
    """(path hash, node, main element around it) of the style tree's nodes. mains: ids of the main elements, which are no nodes themselves.
    A branch of a kind known as noise is one node, since it goes as a whole."""
    stack: list[tuple[Node, int, Node | None]] = [(root, 0, None)]
    while stack:
        node, path, main = stack.pop()
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag in BLOCK:
                top = id(kid) in mains
                here = _hash(f"{path}/{'!' if top else ''}{kid.kind}")
                if kid.tag not in ("html", "body") and not top:
                    yield here, kid, main
                if not kid.noise:
                    stack.append((kid, here, kid if top else main))


def _contents(root: Node) -> dict[int, int]:
    """A hash of each block element's content by its id: of its texts between the edges of blocks, from sums over the page."""
    sums, run, out = [0], [], {}
    stack: list = [(k, None) for k in reversed(root.kids)]

    def close():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            sums.append((sums[-1] * _RADIX + _hash(text)) % _PRIME)

    while stack:
        kid, begun = stack.pop()
        if isinstance(kid, str):
            run.append(kid)
        elif begun is not None:
            close()
            out[id(kid)] = (sums[-1] - sums[begun] * pow(_RADIX, len(sums) - 1 - begun, _PRIME)) % _PRIME
        else:
            if kid.tag in BLOCK:
                close()
                stack.append((kid, len(sums) - 1))
            stack.extend((k, None) for k in reversed(kid.kids))
    return out


def features(page: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(None, path, 0, presentation) and (None, path, 1, content) of a page's style nodes; inside a main element
    (its content, path, 2, presentation) and (its content, path, 3, content)."""
    root = parse(page)
    mains, content = {id(m) for m in _main(root)}, _contents(root)
    for path, node, main in style_nodes(root, mains):
        key, kind = (None, 0) if main is None else (content[id(main)], 2)
        yield key, path, kind, _hash(" ".join(k.kind for k in node.kids if isinstance(k, Node)))
        yield key, path, kind + 1, content[id(node)]


def extract(page: str, low: frozenset[int] | set[int] = frozenset(), high: frozenset[int] | set[int] = frozenset(), prior: bool = True) -> str:
    """The main text of a page, with the branches of low importance removed and those of high importance beside main elements kept; and
    without kinds known as noise, unless prior is False."""
    root = parse(page)
    mains = _main(root)
    tops = {id(m) for m in mains}
    around = tops | _around(mains)
    judged = [(path, id(n)) for path, n, _ in style_nodes(root, tops) if id(n) not in around] if low or high else []
    dropped = {n for path, n in judged if path in low}
    tops |= {n for path, n in judged if path in high}
    blocks: list[str] = []
    run: list[str] = []

    def close():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    stack: list = [(k, not mains) for k in reversed(root.kids)]
    while stack:
        kid, inside = stack.pop()
        if kid is None:
            close()
        elif isinstance(kid, str):
            if inside:
                run.append(kid)
        elif not (prior and kid.noise):
            if kid.tag in BLOCK:
                close()
                stack.append((None, inside))
            if id(kid) not in dropped:
                inner = inside or id(kid) in tops
                stack.extend((k, inner) for k in reversed(kid.kids))
    close()
    return " ".join(blocks)


def host_of(url) -> F.Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def low_nodes(pages: DataFrame, importance: float = IMPORTANCE, alike: float = ALIKE, least: int = PAGES) -> DataFrame:
    """(host, low, high): the paths of a host's style nodes whose presentation and content are both of low importance, and the paths of
    those outside main elements of which one is as diverse as articles are. pages: host, html."""

    def run(batches):
        for batch in batches:
            hosts, rows = batch.column(0).to_pylist(), []
            for host, raw in zip(hosts, as_bytes(batch.column(1))):
                page = xxhash.xxh64_intdigest(raw) - (1 << 63)
                rows += {(host, page if key is None else key, *x) for key, *x in features(raw.decode("utf-8", "replace"))}
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "page", "path", "kind", "feature"])

    found = pages.select("host", "html").mapInArrow(run, "host string, page bigint, path bigint, kind int, feature bigint").distinct()
    counts = found.groupBy("host", "path", "kind", "feature").count()
    n, c = F.sum("count"), F.col("count")
    spread = counts.groupBy("host", "path", "kind").agg(n.alias("n"), (F.log(n) - F.sum(c * F.log(c)) / n).alias("entropy"))
    judged = spread.where(F.col("n") >= least).withColumn("importance", F.col("entropy") / F.log("n"))
    nodes = judged.groupBy("host", "path").agg(F.max("importance").alias("importance"), F.max("kind").alias("kind"))
    beside = F.col("kind") < 2
    small, large = F.col("importance") < importance, beside & (F.col("importance") >= alike)
    return (
        nodes.where(small | large)
        .groupBy("host").agg(F.collect_list(F.when(small, F.col("path"))).alias("low"), F.collect_list(F.when(large, F.col("path"))).alias("high"))
    )


def main_text(pages: DataFrame, prior: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null or empty html, and pages without main text, give an empty text; a null or odd url puts the page on the host "";
    repeated rows give equal rows and count as pages of their own; an empty table gives no rows; other columns are ignored."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = saved(low_nodes(rows)).withColumnRenamed("host", "low_host")
    few = low.agg(F.coalesce(F.sum(F.size("low") + F.size("high")), F.lit(0))).first()[0] <= BROADCAST_IDS
    if few:  # the judged paths of all hosts, counted: one table for every worker
        table = {r.low_host: (frozenset(r.low), frozenset(r.high)) for r in low.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(table)
        judged = lambda batch: (shared.value.get(h, ((), ())) for h in batch.column(3).to_pylist())
    else:
        rows = rows.join(low, F.col("host") == F.col("low_host"), "left").select("page_id", "url", "html", "low", "high")
        judged = lambda batch: ((frozenset(x or ()), frozenset(y or ())) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()))

    def run(batches):
        for batch in batches:
            texts = [extract(raw.decode("utf-8", "replace"), low, high, prior) for raw, (low, high) in zip(as_bytes(batch.column(2)), judged(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
