"""Main text of a page by tree scoring.

A page becomes a tree, in time linear in its length however deep it is. Elements that are hidden are cut; those that may
be beside the article, by element, role or name, are suspects. Each paragraph gives points for its length and commas to
its ancestors, all to its parent, half to the next, less further up to LEVELS, but not beyond a suspect; an element's
points are discounted by the share of its text that is in links. Only then are suspects settled: those around the best
article, or around the best text where nothing else has any, are cleared and the tree is scored again; the others are
cut. The best element, widened to the article around it, and those of its siblings that score well too are the article;
its blocks are written in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z-]+)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|([a-zA-Z-]+)")
WORD = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no text to read, and those that are suspects.
GONE = frozenset("button select option svg canvas object audio video map head".split())
SUSPECT = frozenset("nav footer aside form menu dialog fieldset".split())
SUSPECT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names (the last telling word of a class or id) that mark what is beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist reply replies disqus respond share sharing social related recommended recommendations widget widgets login search toolbar skip".split()
)
#: Words after the telling one, and words before it that say an element is about the thing, not the thing itself.
PLAIN = frozenset(
    "list box wrap wrapper container block section area region panel pane left right top bottom bar slot inner outer content contents body main item items unit units zone holder group row col column columns links link buttons button btn icon icons post posts article articles stories form text title heading header primary secondary sticky fixed mobile desktop large small site root message label toggle".split()
)
#: Words before the telling one that leave it what it says; after others ("chocolate-cookies") it may be the article's own.
QUALIFIERS = frozenset("site global page main user users reader readers visitor facebook fb disqus live all view add leave new blog entry wp js my web mini inline native google email mail sign top sub primary second third floating collapsible".split())
ABOUT = frozenset("has no with without not non is are hide show".split())
ARTICLE_ROLES = frozenset(("main", "article"))
#: An open element of the key's kind ends where one of these starts.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that such an open element is not looked for beyond.
CLOSE_LIMIT = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt", "dd"), "table": ("tr", "td", "th")}
P_ENDS = BLOCK - frozenset("option caption".split())
P_LIMIT = frozenset("table td th caption button article section div body li".split())

COMMA = re.compile("[,،、，]")
FULL_LENGTH, LENGTH_POINT, LENGTH_MOST = 25, 100, 3
SIBLING_SHARE, LIST_LINKS = 0.2, 0.5
#: A suspect by an ambiguous name is cut inside an article if it has no more characters or no smaller share of links; what
#: is around the best element is taken whole if no part of it has more than this share of links.
SHORT, LINKED = 120, 0.3
#: Characters of an item from which a list of links after a paragraph is one of titles.
TITLE = 20
LEVELS = 8

#: What an element is: part of the page, a suspect, cut as hidden or without text; a suspect by a name that may mean its subject.
PART, DOUBTED, CUT, UNSURE = 0, 1, 2, 3


class Node:
    __slots__ = ("tag", "up", "kids", "state", "is_article", "inside", "open", "holder", "score", "chars", "linked")

    def __init__(self, tag: str, up: Node | None, state: int = PART, is_article: bool = False):
        self.tag, self.up, self.kids, self.state, self.is_article = tag, up, [], state, is_article
        self.inside = is_article or up is not None and up.inside  # an article
        self.open = _open_below(self, up)
        self.holder, self.score, self.chars, self.linked = self, 0.0, 0, 0


def _open_below(node: Node, up: Node | None) -> dict[str, Node]:
    """The open elements that a start tag below node may end, by tag: those of up, but for what node adds or hides."""
    found = up.open if up is not None else {}
    tag = node.tag
    if tag == "p" or tag in CLOSES:
        return {**found, tag: node, **({} if tag in ("p", "li", "dt", "dd") or "p" not in found else {"p": None})}
    hidden = CLOSE_LIMIT.get(tag, ())
    if tag in P_LIMIT:
        hidden = (*hidden, "p")
    if any(found.get(h) is not None for h in hidden):
        return {**found, **dict.fromkeys(hidden)}
    return found


def attributes(rest: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(rest)}


def telling(name: str) -> str:
    """What a class or id says its element is: its last word that is not a plain one, "" if it only tells about it."""
    words = [w for w in WORD.findall(CAMEL.sub(" ", name.split("--")[0]).lower()) if len(w) > 1 and not w.isdigit()]
    if not words or words[0] in ABOUT:
        return ""
    if "".join(words) in BESIDE:
        return "".join(words)
    while len(words) > 1 and words[-1] in PLAIN:
        words.pop()
    return words[-1]


def ambiguous(name: str) -> bool:
    """Whether the telling word of a class or id stands after one that it may belong to."""
    words = [w for w in WORD.findall(CAMEL.sub(" ", name.split("--")[0]).lower()) if len(w) > 1 and not w.isdigit()]
    while len(words) > 1 and words[-1] in PLAIN:
        words.pop()
    return any(w not in BESIDE and w not in PLAIN and w not in QUALIFIERS for w in words[:-1]) and "".join(words) not in BESIDE


def kind(tag: str, rest: str, up: Node) -> tuple[int, bool]:
    """(state, whether it is an article) of an element that starts below up."""
    if tag in GONE:
        return CUT, False
    state = DOUBTED if tag in SUSPECT or tag == "header" and not up.inside else PART
    is_article = tag in ("article", "main")
    if rest and rest != "/":
        attrs = attributes(rest)
        role = attrs.get("role", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
            return CUT, False
        if tag in ("body", "html", "main"):
            return PART, is_article
        if role in SUSPECT_ROLES:
            state = DOUBTED
        given = [x for k in ("class", "id") if k in attrs for x in attrs[k].split()]
        names = {telling(x) for x in given}
        if "header" in names and tag not in HEADINGS and not up.inside and not is_article:
            state = DOUBTED
        if names & BESIDE and state != DOUBTED:
            state = UNSURE if all(ambiguous(x) for x in given if telling(x) in BESIDE) else DOUBTED
        is_article = is_article or role in ARTICLE_ROLES or attrs.get("itemprop", "") == "articleBody"
    return state, is_article and state == PART


def tree(page: str) -> Node:
    root = Node("#root", None)
    at, open_node, n = 0, root, len(page)
    count: Counter = Counter()  # of open elements, so that an end tag without a start costs nothing

    def ended(last: Node) -> None:
        nonlocal open_node
        while True:
            node, open_node = open_node, open_node.up
            count[node.tag] -= 1
            if node is last:
                return

    while at < n:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else n]
            if text:
                open_node.kids.append(html.unescape(text) if "&" in text else text)
            if m is None:
                break
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        tag, rest = name.lower(), m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            if count[tag]:
                node = open_node
                while node.tag != tag:
                    node = node.up
                ended(node)
            elif tag == "br":
                open_node.kids.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag == "br":
            open_node.kids.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                open_node.kids.append(Node("hr", open_node))
            continue
        if tag in P_ENDS and open_node.open.get("p") is not None:
            ended(open_node.open["p"])
        if tag in CLOSES:
            for other in CLOSES[tag]:
                if open_node.open.get(other) is not None:
                    ended(open_node.open[other])
        node = Node(tag, open_node, *kind(tag, rest, open_node))
        open_node.kids.append(node)
        if not rest.endswith("/") or tag in BLOCK:
            open_node = node
            count[tag] += 1
    return root


def give(node: Node, points: float) -> None:
    """Points to node and those above it, up to the first suspect and LEVELS of them."""
    up, level = node, 0
    while up.tag != "#root" and level < LEVELS:
        up.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
        if up.state:
            break
        up, level = up.up, level + 1


def measure(root: Node) -> list[Node]:
    """Set every node's characters, linked characters and points; the nodes in page order, those that are cut left out."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed([k for k in node.kids if isinstance(k, Node) and k.state != CUT])
    own: dict[Node, list[str]] = {}
    for node in order:
        node.holder = node if node.tag in BLOCK or node.state or node.up is None else node.up.holder
        node.score, node.chars, node.linked = 0.0, 0, 0
        texts = [k for k in node.kids if isinstance(k, str)]
        if texts:
            own.setdefault(node.holder, []).extend(texts)
            node.chars = len(" ".join("".join(texts).split()))
    for node in reversed(order):
        if node.tag == "a":
            node.linked = node.chars
        if node.up is not None and not node.state:
            node.up.chars += node.chars
            node.up.linked += node.linked
    for node in order:
        texts = own.get(node)
        if texts and node.tag not in HEADINGS:
            text = " ".join("".join(texts).split())
            if text:
                points = (1 + len(COMMA.findall(text)) + min(len(text) / LENGTH_POINT, LENGTH_MOST)) * min(1, len(text) / FULL_LENGTH)
                points *= 1 - node.linked / max(node.chars, 1)
                to_parent = node.tag in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote") and not node.state and node.up.tag != "#root"
                give(node.up if to_parent else node, points)
    return order


def settled(root: Node) -> list[Node]:
    """The nodes, measured again if suspects around the article were cleared.

    No suspect is cleared if an article or main element outside them has text. Else those around the best article are;
    without any article, those around a heading of the first order with more points than all that is outside suspects
    has, or around the best text if there is none outside.
    """
    order = measure(root)
    doubt: dict[Node, Node | None] = {}  # of each node, the nearest suspect that it is or is in
    for node in order:
        doubt[node] = node if node.state else doubt[node.up] if node.up is not None else None
    if not any(doubt.values()) or any(n.is_article and n.chars and not doubt[n] for n in order):
        return order
    articles = [n for n in order if n.is_article and n.chars]
    if articles:
        best = max(articles, key=rank)
    else:
        outside = max((rank(n) for n in order if not doubt[n] and n.tag in BLOCK), default=0.0)
        titled = {id(doubt[n]) for n in order if n.tag == "h1"}
        held = [n for n in order if doubt[n] and n.tag in BLOCK and rank(n) > outside and (outside == 0 or id(doubt[n]) in titled)]
        if not held:
            return order
        best = max(held, key=rank)
    cleared: Node | None = best
    while cleared is not None:
        cleared.state, cleared = PART, cleared.up
    return measure(root)


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def rank(node: Node) -> float:
    return node.score * (1 - density(node))


def chosen(root: Node) -> list[Node]:
    best, doubted = None, set()
    order = settled(root)
    if unsure := [n for n in order if n.state == UNSURE]:
        # inside an article a name that may mean its subject cuts only what is short or of links; elsewhere it cuts
        for node in unsure:
            node.state = PART if node.up.inside and node.chars > SHORT and density(node) < LINKED else DOUBTED
        order = measure(root)
    for node in order:
        if node.state or node.up in doubted:
            doubted.add(node)
        elif node.score > 0 and node.tag in BLOCK and node.tag not in HEADINGS and (best is None or rank(node) > rank(best)):
            best = node
    if best is None:
        return [n for n in order if n.is_article and n.chars and n not in doubted][:1]
    around = best
    while around.inside and not around.is_article:
        around = around.up
    least = SIBLING_SHARE * rank(best)
    if around.inside:
        return _with_like(around, least)
    if best.tag in ("body", "html") or best.up is None:
        return [best]
    if best.up.tag not in ("body", "html", "#root") and all(density(k) < LINKED for k in best.up.kids if isinstance(k, Node) and not k.state and k.chars):
        return [best.up]  # nothing in it but text
    kids = [k for k in best.up.kids if isinstance(k, Node) and not k.state]
    place = next(i for i, k in enumerate(kids) if k is best)

    def stays(i: int, k: Node) -> bool:
        if k is best:
            return True
        if k.tag in HEADINGS:
            return i < place and density(k) < LIST_LINKS
        if k.tag in ("p", "pre", "blockquote"):
            return k.chars > 0 and density(k) < LIST_LINKS
        return k.chars > 0 and k.score > 0 and rank(k) >= least and density(k) < LIST_LINKS

    return [k for i, k in enumerate(kids) if stays(i, k)]


def _with_like(article: Node, least: float) -> list[Node]:
    """The article, and those beside it in the same parent that score as articles of their own."""
    if article.up is None:
        return [article]
    same = [k for k in article.up.kids if isinstance(k, Node) and k.is_article and not k.state]
    return [k for k in same if k is article or _prose(k) >= least and density(k) < LINKED]


def _prose(node: Node) -> float:
    """The best rank in an element."""
    most, todo = 0.0, [node]
    while todo:
        x = todo.pop()
        most = max(most, rank(x))
        todo += [k for k in x.kids if isinstance(k, Node) and not k.state]
    return most


def _text(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.state:
            todo += reversed(x.kids)
    return " ".join("".join(parts).split())


def is_menu(node: Node, before: Node | None) -> bool:
    """Whether a list is mostly links and nothing before it makes it a part of the text: a heading, or a paragraph that ends in a colon or is followed by titles."""
    if node.tag not in ("ul", "ol", "table", "dl") or not node.chars or density(node) <= LIST_LINKS:
        return False
    if before is None or before.state or not before.chars or density(before) >= LINKED:
        return True
    if before.tag in HEADINGS:
        return bool(BESIDE.intersection(WORD.findall(_text(before).lower())))
    if before.tag not in ("p", "blockquote"):
        return True
    items = sum(isinstance(k, Node) and not k.state for k in node.kids)
    return not _text(before).endswith(":") and node.chars < TITLE * items


def blocks(node: Node, out: list[list[str]]) -> None:
    """Append the node's texts to out, a list for each block."""
    todo: list = [(node, None)]
    while todo:
        x, before = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.state:
            if x.tag in BLOCK:
                out.append([])
        elif x is not node and is_menu(x, before):
            out.append([])
        else:
            if x.tag in BLOCK:
                out.append([])
                todo.append((None, None))
            last, kids = None, []
            for k in x.kids:
                kids.append((k, last))
                if isinstance(k, Node) or k.strip():
                    last = k if isinstance(k, Node) else None
            todo += reversed(kids)


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by a line feed, white space in a block as one space; "" if there is none."""
    if not page:
        return ""
    out: list[list[str]] = [[]]
    for node in chosen(tree(page)):
        blocks(node, out)
    lines = (" ".join("".join(b).split()) for b in out if b)
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_fl_id", "_fl_url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars (code points).

    Null and empty pages, and pages without an article, give an empty text. Whole pages are read, however long; ids and
    urls may be null or repeated; an empty table gives no rows; other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    own = small_batches(pages).select(F.col(id_col).alias("_fl_id"), F.col(url_col).alias("_fl_url"), F.col(html_col).alias("_fl_html"))
    out = own.mapInArrow(_extract, f"_fl_id {kind}, _fl_url string, text string, n_chars long")
    return out.withColumnsRenamed({"_fl_id": id_col, "_fl_url": url_col})
