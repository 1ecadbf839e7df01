"""Main text of web pages by composite text density.

The page becomes a tree of elements and text runs (unclosed and misnested tags included); elements
that are never part of an article are marked: scripts, styles, menus, footers, asides.  They give no
text, but those that a reader sees count in the densities above them.  For every node, with C
characters and T tags in its subtree, LC and LT of them in links,

    density = C/T * log base b of (C/LC * T/LT),   b = ln(C/(C-LC) * LC + LC(body)/C(body) * C + e)

(plain C/T on a page without links; zero counts are taken as 1 in denominators; a text run is a
node with one tag).  The subtree with the largest sum of child densities holds the article.  The
least density on its path to the body is the threshold: nodes of at least that density have their
own best subtree marked, and the main text is the lowest node above all marks.  If an ``article``
element holds the best subtree, it is the main text whole; marks outside a ``main`` that holds the
best subtree do not count.  As short blocks miss the threshold, the node then grows to its parent
while less than ``LINKED`` of what that adds is link text, up to below the body.

Names say less than elements: a form, and what a word of its class or id calls a sidebar, an advert, a
notice or reader comments, is *doubted*.  The densities choose first, with the sum of a doubted
subtree taken at ``DOUBT`` (reader comments: ``DOUBT_READERS``); doubted elements around the choice
are believed, and with them others that the same words doubt; the rest is dropped.  Inside the main
text, what holds ``SHARE`` of it, or has its id from its own heading, stays unless it is links.

Text: character references are decoded, white space (line breaks by ``br`` too) becomes one space,
block elements begin and end blocks, blocks are joined by a line feed in page order.

Defined results: null, empty and text-free pages have an empty text; a page without tags is one
block of text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import mapped

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"},
          "body": {"head"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "p": {"td", "th", "button", "object", "table"}}
P_STAYS_OPEN = frozenset("body html li td th tr tbody thead tfoot dd dt option legend figcaption summary".split())
# What is never part of an article, by element, role, and word in class or id.
DROP = frozenset("script style noscript template head title nav footer aside button select textarea input label iframe "
                 "object embed svg canvas audio video dialog menu".split())
UNSEEN = frozenset("script style noscript template head title iframe object embed svg canvas audio video".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
DROP_WORD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
                      "navigation header topbar menu sidebar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice "
                      "notices popup modal newsletter subscribe share sharing social related recommended comment comments "
                      "disqus respond replies pagination pager widget login signup".split())
READERS = frozenset("comment comments disqus respond replies".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
STATE, STATE_END = frozenset("has with without no not is".split()), frozenset("open closed enabled disabled".split())  # of a wrapper
PLAIN = DROP_WORD | frozenset("a add leave on post posts reader the to user write your".split())
LINKED = 0.3
DOUBT, DOUBT_READERS, SHARE = 0.3, 0.05, 0.3
HOLDS_ARTICLE = frozenset({"article", "main", "h1"})

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                  r"""|/?([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    """``words``: what makes it doubted; ``named``: its id, if only that does."""
    __slots__ = ("tag", "parent", "kids", "drop", "words", "named")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, words: frozenset[str] = frozenset(), named: str = ""):
        self.tag, self.parent, self.kids, self.drop, self.words, self.named = tag, parent, [], drop, words, named


def _judged(tag: str, attributes: str, inside_article: bool) -> tuple[bool, frozenset[str], str]:
    """Whether an element is never part of an article, the words that make it doubted, and its id if
    they are of that alone."""
    if tag in DROP or tag == "header" and not inside_article:
        return True, frozenset(), ""
    by_class, by_id, named = {"form"} if tag == "form" else set(), set(), ""
    if not attributes or tag in ("html", "body", "article", "main", "h1"):
        return False, frozenset(by_class), ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "role" and value.lower() in DROP_ROLE:
            return True, frozenset(), ""
        if name == "role" and value.lower() == "form":
            by_class.add("form")
        elif name in ("class", "id") and tag not in HEADING:
            for part in value.split():
                words = [w.lower() for w in _WORD.findall(part)]
                if words and words[0] not in STATE and words[-1] not in STATE_END:
                    (by_class if name == "class" else by_id).update(DROP_WORD.intersection(words))
            named = value if name == "id" else named
    return False, frozenset(by_class | by_id), "" if by_class else named


def parse(page: str) -> Node:
    """The page as a tree; ``kids`` are nodes and strings."""
    root = node = Node("html", None)
    inside = 0  # open article and main elements
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            node.kids.append(page[at:])
            break
        if m.start() > at:
            node.kids.append(page[at:m.start()])
        at = m.end()
        closing, tag, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            if m[4] is None:
                continue  # comment, doctype, or a wrong end tag
            closing, tag = m[0].startswith("</"), m[4].lower()  # quotes that do not close
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = None if up.tag == "table" and tag not in ("html", "body", "div", "article", "main", "section") else up.parent
            if up is not None and up.parent is not None:
                while True:
                    inside -= node.tag in ("article", "main")
                    node, last = node.parent, node
                    if last is up:
                        break
            continue
        if tag == "html":
            continue
        if tag in BLOCK and tag not in P_STAYS_OPEN:
            shut, stop = {"p"}, STOPS["p"]
        else:
            shut, stop = CLOSES.get(tag, ()), STOPS.get(tag, ())
        if shut:
            up, found = node, None
            while up.parent is not None and up.tag not in stop:
                if up.tag in shut:
                    found = up
                up = up.parent
            if found is not None:
                while node is not found.parent:
                    inside -= node.tag in ("article", "main")
                    node = node.parent
        child = Node(tag, node, *_judged(tag, attributes, inside > 0))
        node.kids.append(child)
        if tag in RAW:
            end = _END_RAW[tag].search(page, at)
            child.kids.append(page[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            node = child
            inside += tag in ("article", "main")
        elif tag not in VOID and tag in BLOCK:  # a slash does not close an HTML element
            node = child
            inside += tag in ("article", "main")
    return root


def _order(root: Node) -> list[Node]:
    """Nodes from the root down, without what no reader sees.  What is inside a dropped element is
    dropped too."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        for k in reversed(node.kids):
            if isinstance(k, Node) and k.tag not in UNSEEN:
                k.drop = k.drop or node.drop
                stack.append(k)
    return out


def _spare(root: Node) -> None:
    """Keep a dropped element after all if it holds an article, a main or an h1 (but not the
    page's menu, footer, script or head)."""
    stack: list[tuple[Node, list[Node]]] = [(root, [])]
    while stack:
        node, dropped = stack.pop()
        if node.drop:
            if node.tag in ("nav", "footer", "script", "style", "head", "noscript", "template", "header", "aside"):
                continue
            dropped = [*dropped, node]
        if dropped and node.tag in HOLDS_ARTICLE:
            for d in dropped:
                d.drop = False
        stack += [(k, dropped) for k in node.kids if isinstance(k, Node)]


def _titled(node: Node) -> bool:
    """Whether a doubted element has its id from the heading it begins with, and holds no form."""
    words = [w.lower() for w in _WORD.findall(node.named)]
    if not words or node.words & READERS and PLAIN.issuperset(words):
        return False
    heading, stack = None, [node]
    while stack:
        x = stack.pop()
        if x.tag == "form":
            return False
        if heading is None and x.tag in HEADING:
            heading = x
        stack += reversed([k for k in x.kids if isinstance(k, Node)])
    if heading is None:
        return False
    held, stack = [], [heading]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            held.append(x)
        else:
            stack += reversed(x.kids)
    return [w.lower() for w in _WORD.findall(html.unescape("".join(held)))] == words


def article(root: Node) -> Node:
    """The node whose subtree is the main text."""
    _spare(root)
    nodes = _order(root)
    index = {id(x): i for i, x in enumerate(nodes)}
    size = len(nodes)
    chars, tags, link_chars, link_tags = [0] * size, [1] * size, [0] * size, [0] * size
    seen, plain = [0] * size, [0] * size  # characters, without what is never part of an article; and without links
    runs: list[list[int]] = [[] for _ in range(size)]
    for i in range(size - 1, -1, -1):
        x = nodes[i]
        for k in x.kids:
            if isinstance(k, str):
                if c := len(" ".join(k.split())):
                    runs[i].append(c)
                    chars[i] += c
                    if not x.drop:
                        seen[i] += c
                        plain[i] += c
        if x.tag == "a":
            link_chars[i], link_tags[i], plain[i] = chars[i], link_tags[i] + 1, 0
        if x.parent is not None:
            p = index[id(x.parent)]
            chars[p] += chars[i]
            seen[p] += seen[i]
            plain[p] += plain[i]
            tags[p] += tags[i]
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
    body = next((i for i, x in enumerate(nodes) if x.tag == "body"), 0)
    body_links = link_chars[body] / max(1, chars[body])

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + body_links * c + math.e)
        if base <= 1 + 1e-12:
            return c / t
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(base)

    own = [density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(size)]
    in_runs = [sum(density(c, 1, 0, 0) for c in r) for r in runs]
    up = [index[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    doubted = [bool(x.words) and not x.drop for x in nodes]
    in_body = [i == body for i in range(size)]
    for i in range(body + 1, size):
        in_body[i] = in_body[up[i]]
    while True:
        sums = in_runs.copy()
        for i in range(size - 1, 0, -1):
            if not nodes[i].drop and not doubted[i]:
                sums[up[i]] += own[i]
        if True not in doubted:
            break
        trust = [1.0] * size
        choice, most = body, 0.0
        for i in range(size):
            if up[i] >= 0:
                trust[i] = trust[up[i]]
            if doubted[i]:
                trust[i] = min(trust[i], DOUBT_READERS if nodes[i].words & READERS else DOUBT)
            if in_body[i] and not nodes[i].drop and sums[i] * trust[i] > most:
                choice, most = i, sums[i] * trust[i]
        path, i = [], choice
        while i >= 0:
            if doubted[i]:
                path.append(i)
            i = up[i]
        if not path:
            break
        # The outermost doubted element around the choice is believed, those with most of its text too
        # (so the next round has at most half of the text).
        outer = path[-1]
        for i in path:
            if i == outer or 2 * plain[i] >= plain[outer]:
                doubted[i] = False
        inside = [False] * size
        for i in range(outer, size):
            inside[i] = i == outer or inside[up[i]]
        alike = nodes[outer].words - READERS - {"form"}
        for i in range(size):
            if doubted[i] and not inside[i] and nodes[i].words <= alike and seen[i] - plain[i] < LINKED * max(1, seen[i]):
                doubted[i] = False
    off = [x.drop for x in nodes]
    kept, kept_links = [0] * size, [0] * size  # characters, without what is dropped
    for i in range(size):
        off[i] = off[i] or doubted[i] or up[i] >= 0 and off[up[i]]
    for i in range(size - 1, -1, -1):
        kept[i] += 0 if off[i] else sum(runs[i])
        if nodes[i].tag == "a":
            kept_links[i] = kept[i]
        if i:
            kept[up[i]] += kept[i]
            kept_links[up[i]] += kept_links[i]
    # The best node of every subtree: the largest sum, the highest of equals.
    best = list(range(size))
    for i in range(size - 1, 0, -1):
        if off[i]:
            continue
        p = up[i]
        if sums[best[i]] > sums[best[p]] or sums[best[i]] == sums[best[p]] and best[i] < best[p]:
            best[p] = best[i]
    top = best[body]
    threshold, x, whole, main = own[top], nodes[top], None, None
    while x is not None:
        threshold = min(threshold, own[index[id(x)]])
        whole = x if x.tag == "article" else whole
        main = x if x.tag == "main" else main
        if index[id(x)] == body:
            break
        x = x.parent
    def settle(x: Node) -> None:
        """Drop what stays doubted, other than large or titled parts of ``x``."""
        at = index[id(x)]
        part = [False] * size
        for i in range(size):
            part[i] = i == at or up[i] >= 0 and part[up[i]]
            if doubted[i]:
                own_text = seen[i] - plain[i] < LINKED * seen[i] and part[i]
                large = not nodes[i].words & (READERS | {"form"}) and plain[i] >= SHARE * (kept[at] + plain[i])
                nodes[i].drop = not (own_text and (large or _titled(nodes[i])))

    if whole is not None:
        settle(whole)
        return whole
    start = body if main is None else index[id(main)]
    marks, stack = {top}, [start]
    while stack:
        i = stack.pop()
        if own[i] >= threshold and chars[i]:
            marks.add(best[i])
            stack += [index[id(k)] for k in nodes[i].kids if isinstance(k, Node) and id(k) in index and not off[index[id(k)]]]
    above = None  # path of the lowest node above all marks
    for i in marks:
        path, x = [], nodes[i]
        while x is not None:
            path.append(x)
            x = x.parent
        path.reverse()
        above = path if above is None else [a for a, b in zip(above, path) if a is b]
    x = above[-1]
    settle(x)
    while x.parent is not None and x is not nodes[body] and x.parent is not nodes[body]:
        i, p = index[id(x)], index[id(x.parent)]
        more = kept[p] - kept[i]
        if more and kept_links[p] - kept_links[i] >= LINKED * more:
            break
        x = x.parent
    return x


def blocks(node: Node) -> list[str]:
    """Text blocks of a subtree, in page order."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append(text)
            held.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not x.drop:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            elif x.tag == "br":
                held.append(" ")
            stack += reversed(x.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, one block a line."""
    return "\n".join(blocks(article(parse(page)))) if page else ""


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``."""
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_col).alias("html")).transform(
        mapped, run, f"page_id {types[page_id]}, url {types[url]}, text string, n_chars bigint")
