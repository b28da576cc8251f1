"""Main text of web pages by tree scoring.

A page is parsed into a tree (void elements, implied ends, raw-text elements and unclosed tags as browsers take them,
nearly). Paragraphs pass points for their length and commas to their parent in full, and each further ancestor gets half
of what the one below it got; a container's points are discounted by its link density. The best container is
kept, widened to the article it is part of, with siblings that score well or read as prose. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts and reader comments are left out before and after, by element, role or name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, table

#: Where markup begins: a comment, a declaration, a tag.
_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed sets of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends these, up to the nearest element of the second set.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
_SCOPE = frozenset("article aside body button caption div footer form header li main nav section table td th html".split())
_CLOSES_P = _BLOCK - {"html", "head", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}

#: Never part of the main text.
_DROPPED = frozenset("head script style noscript iframe template textarea select option button form nav aside footer dialog object embed svg canvas audio video search menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|side-?bars?|nav|navbar|navigation|menus?|breadcrumbs?|footers?|site-?header|page-?header|masthead|topbar|toolbar|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommended|widgets?|pagination|pager|tags|skip-?link|hidden|sr-only|copyright|legal|disclaimer|login|search)(?:$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Scores. Points of an element before any paragraph, what each paragraph gives, and when a sibling is kept.
_WEIGHTS = {"article": 12.0, "main": 8.0, "section": 2.0, "div": 2.0, "td": 1.0, "pre": 1.0, "blockquote": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -5.0}
_LINE, _MOST_LENGTH, _SIBLING, _PROSE = 25, 3.0, 0.2, 80


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "length", "linked", "commas", "own", "score", "out")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.length = self.linked = self.commas = self.own = 0
        self.score = _WEIGHTS.get(tag, 0.0)
        self.out = False


class _Scanner:
    """Where things end in a page. What is not found once is not looked for again, so scanning takes linear time."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.missing else self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The bracket that ends the tag whose attributes begin at ``at``; with an unclosed quote the next one; -1 without any."""
        first = self.find(">", at)
        while first >= 0 and (m := _QUOTE.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            closed = self.find(m[0], m.end())
            if closed < 0:
                return first
            at = closed + 1
        return first


def parse(page: str) -> Node:
    """The tree; children are nodes and strings with their references still in them."""
    root = Node("html", "", None)
    path, at, look = [root], 0, 0
    open_: dict[str, list[int]] = {}  # depths of the open elements by tag
    scopes = [0]  # depths of those that end what a start tag may end
    scan = _Scanner(page)

    def back(depth: int) -> None:
        while len(path) > max(depth, 1):
            tag = path.pop().tag
            open_[tag].pop()
            if scopes[-1] == len(path):
                scopes.pop()

    def deepest(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=-1)

    while m := _MARKUP.search(page, look):
        if m[2] is None:
            end = scan.find("-->", m.end()) + 3 if m[0] == "<!--" else scan.find(">", m.end()) + 1
            stop = end if end > 2 or m[0] != "<!--" and end else len(page)
            attrs = ""
        else:
            stop = scan.tag_end(m.end()) + 1
            if not stop:
                if ">" in scan.missing:
                    break  # no tag ends any more
                look = m.end()
                continue
            attrs = page[m.end() : stop - 1]
        if m.start() > at:
            path[-1].children.append(page[at : m.start()])
        at = look = stop
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            found = deepest([tag])
            if found > 0 and (tag != "p" or found > scopes[-1]):
                back(found)
            continue
        if tag in ("html", "body"):
            if tag == "html":
                root.attrs = root.attrs or attrs
                continue
            back(1)
        if ends := _ENDS.get(tag):
            found = deepest(ends[0])
            if found > deepest(ends[1]):
                back(found)
        if tag in _CLOSES_P:
            found = deepest(["p", *_HEADINGS] if tag in _HEADINGS else ["p"])
            if found > scopes[-1]:
                back(found)
        child = Node(tag, attrs, path[-1])
        path[-1].children.append(child)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            closing = f"</{tag}"
            found = None if closing in scan.missing else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if not found:
                scan.missing.add(closing)
            stop = found.start() if found else len(page)
            child.children.append(page[at:stop])
            at = look = stop
        open_.setdefault(tag, []).append(len(path))
        if tag in _SCOPE:
            scopes.append(len(path))
        path.append(child)
    if at < len(page):
        path[-1].children.append(page[at:])
    return root


def _left_out(node: Node, in_article: bool) -> bool:
    tag = node.tag
    if tag in _DROPPED:
        return True
    if tag == "header":
        return not in_article
    attrs = node.attrs
    if not attrs or tag in ("html", "body"):
        return False
    found = {a.lower(): html.unescape(v or w or x or "") for a, v, w, x in _ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _ROLES or _HIDDEN.search(found.get("style", "")):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return bool(tag not in ("article", "main") and _NAMES.search(names)) or bool(re.search(r"(?:^|[\s_-])(?:comments?|reply|replies|ads?|advert|sponsored|related)(?:$|[\s_-])", names, re.I))


def _measure(root: Node) -> list[Node]:
    """Marks what is left out, sums lengths, commas and linked lengths, and deals out points; gives the containers."""
    order: list[tuple[Node, bool]] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        node.out = _left_out(node, inside)
        if node.out:
            continue
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, inside) for c in node.children if isinstance(c, Node))
    for node, _ in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                text = html.unescape(c) if "&" in c else c
                n = len(" ".join(text.split()))
                node.length += n
                node.own += n
                node.commas += text.count(",") + text.count("、") + text.count("，") + text.count("،")
            elif not c.out:
                node.length += c.length
                node.linked += c.linked
                node.commas += c.commas
                if c.tag not in _BLOCK:
                    node.own += c.own
        if node.tag == "a":
            node.linked = node.length
    gained: dict[int, float] = {}
    for node, _ in order:
        if node.tag in _BLOCK and node.tag not in ("html", "body") and node.own and node.parent is not None:
            prose = node.own >= _LINE and node.tag not in _HEADINGS
            density = node.linked / node.length if node.length else 0.0
            points = ((1.0 + node.commas if prose else 0.0) + min(node.own / 100, _MOST_LENGTH)) * (1 - density)
            to = node if node.tag in ("div", "section", "article", "main", "td") else node.parent
            gained[id(to)] = gained.get(id(to), 0.0) + points
    scored = []
    for node, _ in reversed(order):  # children before their parents: each passes half of what it has got on
        if (got := gained.get(id(node))) is None:
            continue
        if node.parent is not None:
            gained[id(node.parent)] = gained.get(id(node.parent), 0.0) + got / 2
        node.score = (node.score + got) * (1 - (node.linked / node.length if node.length else 0.0))
        scored.append(node)
    return scored[::-1]


def _kept(root: Node) -> list[Node]:
    containers = [n for n in _measure(root) if n.tag not in ("html",)]
    if not containers:
        return [root]
    best = max(containers, key=lambda n: n.score)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    parent = best.parent
    if parent is None or best.tag in ("body", "html"):
        return [best]
    least = max(10.0, _SIBLING * best.score)
    out = []
    for s in parent.children:
        if isinstance(s, str) or s.out:
            continue
        density = s.linked / s.length if s.length else 0.0
        prose = s.tag in ("p", "blockquote", "pre") and (s.length > _PROSE and density < 0.25 or density == 0 and 0 < s.length <= _PROSE)
        title = s.tag in ("h1", "header") and s.length > 0
        if s is best or prose or title or s.tag in ("article", "section", "div", "main") and s.score >= least and density < 0.5:
            out.append(s)
    return out


def _within(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space folded."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(text)
            parts.clear()

    stack: list = list(reversed(nodes))
    article = any(_within(n) for n in nodes)
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append(" ")
        elif not item.out:
            links = not article and item.tag in ("ul", "ol", "dl", "table") and item.length and item.linked / item.length > 0.9
            if links and sum(isinstance(c, Node) for c in item.children) > 1:
                continue  # a menu in all but name, on a page that doesn't say where its article is
            if item.tag in _BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(item.children))
    close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(_blocks(_kept(parse(page)))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(2).to_pylist()
        for at, end in groups(pages, 512):
            part, texts = batch.slice(at, end - at), [main_text(p) for p in pages[at:end]]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``, repeated ones too.

    Null or empty html, and pages with nothing but boilerplate, give an empty text. A page without a scoring paragraph
    gives what is left of its body.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
