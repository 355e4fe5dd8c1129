"""Main text of web pages by composite text density.

Each DOM node gets a density: characters per tag below it, weighted by how
little of that text is link text. The node whose children's densities sum to
most is the body of the article; the least density on the path from that node
up to the page's body is the threshold that lets neighbouring blocks in.

Elements and class words of page furniture only raise a suspicion: what is
below them is counted first, and stays if it is the page's own text.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title textarea select option button iframe object svg math canvas audio video".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
FRAME = frozenset("nav footer aside form header dialog menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr legend".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
             "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
             "tbody": frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "thead", "tr", "td", "th"])}
SCOPE = frozenset("ul ol dl table article section main div body html td th blockquote".split())
LISTS = frozenset("ul ol dl table select".split())
_STOPS = SCOPE | LISTS | {"p"}.union(*CLOSED_BY.values())       # elements at which a search for one to close looks
# Class, id and role words of page furniture, held against whole words between white space.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
                      "breadcrumbs header footer sidebar aside cookie cookies consent notice notices popup modal newsletter subscribe share "
                      "sharing social related recommended comment comments disqus reply replies pagination pager toolbar widget form search "
                      "contentinfo complementary masthead skip "
                      "cookie-banner cookie-notice cookie-consent cookie-bar site-header site-footer page-footer site-nav main-nav nav-menu "
                      "main-menu nav-bar side-bar social-links social-share share-buttons related-posts related-articles comment-list "
                      "comments-area comment-form search-form newsletter-signup ad-container ad-slot ad-banner skip-link".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|>|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDE = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w")


class Node:
    __slots__ = ("chars", "density", "drop", "holds", "kids", "link_chars", "link_tags", "name", "stop", "suspect", "sum", "tags", "up")

    def __init__(self, name: str, up, drop: bool = False, suspect: frozenset = frozenset()):
        self.name, self.up, self.drop, self.suspect, self.kids = name, up, drop, suspect, []
        self.holds = frozenset()
        self.stop = self if name in _STOPS else up and up.stop      # the nearest of _STOPS, this one or above
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _furniture(attrs: str) -> frozenset:
    return FURNITURE.intersection(w for m in _NAMES.finditer(attrs) for w in next(filter(None, m.groups()), "").lower().split())


def parse(page: str) -> Node:
    """The page as a tree; texts are the strings among a node's kids. Unclosed and stray tags are mended as browsers do.

    Time grows with the page whatever its nesting: nothing is searched for
    that is not open, and what is passed on the way up is closed."""
    root = Node("html", None)
    now, at, n = root, 0, len(page)
    is_open: dict[str, int] = defaultdict(int)

    def leave(node: Node, to: Node) -> Node:
        while node is not to:
            is_open[node.name] -= 1
            node = node.up
        return to

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            now.kids.append(page[at:])
            break
        if m.start() > at:
            now.kids.append(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                now.kids.append(_html.escape(m.group()[9:-3]))
            continue
        if m.group(1) or m.group(4):
            if is_open[name]:
                node = now
                while node.name != name:
                    node = node.up
                now = leave(now, node.up)
            continue
        attrs = m.group(3) or m.group(6) or ""
        if name == "html":
            continue
        if name == "body":
            now = leave(now, root)              # a head that was left open ends here
        now = leave(now, _close_for(now, name, is_open))
        named = attrs if name not in ("body", "article", "main") else ""
        words = _furniture(named) if named else frozenset()
        node = Node(name, now, name in HIDDEN or bool(named and _HIDE.search(named)), words | {f"<{name}>"} if name in FRAME else words)
        now.kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not attrs.endswith("/"):
            now = node
            is_open[name] += 1
    return root


def _close_for(now: Node, name: str, is_open: dict[str, int]) -> Node:
    """The node that a new element of this name goes into."""
    above = lambda node: node.up and node.up.stop
    if name in CLOSES_P and is_open["p"]:
        node = now.stop
        while node is not None and node.name != "p" and node.name not in SCOPE:
            node = above(node)
        if node is not None and node.name == "p":
            now = node.up
    if name in CLOSED_BY and any(is_open[x] for x in CLOSED_BY[name]):
        node, last = now.stop, None
        while node is not None and node.name not in LISTS:
            if node.name in CLOSED_BY[name]:
                last = node
            node = above(node)
        if last is not None:
            now = last.up
    return now


def _order(root: Node) -> list[Node]:
    """All nodes, parents first; dropped ones are left out with what they hold."""
    out = [root]
    for node in out:
        out.extend(k for k in node.kids if isinstance(k, Node) and not k.drop)
    return out


def _count(nodes: list[Node]) -> None:
    """Characters, tags and links below each node (parents first), and whether an article or main is."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                size = len(_SPACE.sub(" ", _html.unescape(k) if "&" in k else k).strip())
                node.chars += size
                if node.name == "a":
                    node.link_chars += size
            elif not k.drop:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.chars if node.name == "a" else k.link_chars
                node.link_tags += k.link_tags + (k.name == "a")
                if k.holds or k.name in ("article", "main"):
                    node.holds |= k.holds | {k.name} & {"article", "main"}
        if node.name == "a":
            node.link_chars = node.chars


def _judge(root: Node) -> bool:
    """Drop furniture; True if any was dropped.

    What a word or element of furniture is on stays if a ``main`` is below
    it, or an ``article`` while the page has none elsewhere. A class word or
    ``form`` is also no furniture on a page where it stands over most of the
    text that is not in links. A header inside an article that holds a
    heading is part of the article."""
    nodes = _order(root)
    if not any(x.suspect for x in nodes):
        return False
    body = next((x for x in nodes if x.name == "body"), root)
    over: dict[str, int] = {}                   # text below each word, nested ones once
    seen: dict[int, tuple[frozenset, bool]] = {}        # words above a node with its own; is it in an article
    free = False
    for node in nodes:
        above, inside = seen[id(node.up)] if node.up is not None else (frozenset(), False)
        for w in node.suspect - above:
            over[w] = over.get(w, 0) + node.chars - node.link_chars
        mark = node.name in ("article", "main")
        free |= mark and not above
        seen[id(node)] = above | node.suspect, inside or mark
    text = {w for w, n in over.items() if 2 * n > body.chars - body.link_chars and (w == "<form>" or not w.startswith("<"))}
    dropped = False
    for node in nodes:
        if node.suspect - text and "main" not in node.holds and (free or "article" not in node.holds):
            heading = node.name == "header" and seen[id(node)][1] and any(isinstance(x, Node) and x.name in ("h1", "h2", "h3") for x in node.kids)
            node.drop = not heading
            dropped |= node.drop
    return dropped


def measure(root: Node) -> list[Node]:
    """Fill in densities and their sums; returns the nodes, parents first."""
    nodes = _order(root)
    _count(nodes)
    if _judge(root):
        nodes = _order(root)
        _count(nodes)
    body = next((x for x in nodes if x.name == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * lc + ratio * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else math.log(max(1.0, c / lc * t / lt)))
    for node in nodes:
        node.sum = sum(k.density for k in node.kids if isinstance(k, Node) and not k.drop)
    return nodes


def _is_inline(node: Node) -> bool:
    return all(x.name not in BLOCK for x in _order(node))


def _runs(node: Node, on_path: set[int]) -> list:
    """Kids of a path node; texts and the inline elements among them come as one node that stands for the line."""
    out, run = [], []

    def flush():
        if any(isinstance(k, str) and _WORD.search(k) for k in run):
            line = Node("span", node)
            line.kids = run.copy()
            line.density = math.inf
            out.append(line)
        else:
            out.extend(k for k in run if isinstance(k, Node))
        run.clear()

    for k in node.kids:
        if isinstance(k, str) or not k.drop and id(k) not in on_path and _is_inline(k):
            run.append(k)
        elif not k.drop:
            flush()
            out.append(k)
    flush()
    return out


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that make up the article, in page order; text that stands directly in a node above them is part of it."""
    nodes = measure(root)
    body = next((x for x in nodes if x.name == "body"), root)
    best = max(_order(body), key=lambda x: x.sum)      # of equal sums the outermost
    if best.sum <= 0:
        best = body
    path, node = [], best
    while node is not None and node is not body:
        path.append(node)
        node = node.up
    marked = [x for x in path if x.name in ("article", "main")]
    if marked:
        return [marked[-1]]                     # the page itself says where the article begins and ends
    threshold = min((x.density for x in [*path, body]), default=0.0)
    chosen: list[Node] = []
    stack = [body]
    on_path = {id(x) for x in path}
    while stack:
        node = stack.pop()
        if node is best:
            chosen.append(node)
        elif id(node) in on_path or node is body:
            stack.extend(reversed(_runs(node, on_path)))
        elif node.density >= threshold and node.density > 0:
            chosen.append(node)
    return chosen


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below a node, white space as one space, character references decoded."""
    out, line = [], []

    def flush():
        if text := _SPACE.sub(" ", _html.unescape("".join(line))).strip():
            out.append(text)
        line.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.drop or x is top:
            if x.name in BLOCK:
                flush()
                stack.append(None)
            elif x.name == "br":
                line.append("\n")
            stack.extend(reversed(x.kids))
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of a page: blocks in page order, two line ends between them."""
    if not page or not page.strip():
        return ""
    return "\n\n".join(b for node in main_nodes(parse(page)) for b in blocks(node))


def _run(batches):
    for b in batches:
        texts = [extract(p) for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    * a null or empty page, or one without main text, gives an empty text;
    * null ids and urls pass through; repeated rows each get their row;
    * an empty table gives an empty result; other columns are ignored;
    * pages are read whole, one at a time, with memory for one page.
    """
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType)])
    schema = schema.add("text", "string").add("n_chars", "long")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(_run, schema)
