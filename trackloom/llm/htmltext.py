"""Main text of web pages by composite text density.

For every node of the DOM: characters per tag, adjusted by the share of characters and tags inside links and by
the page's own share of link text (Sun, Song and Liao 2011). A node's density sum is that of its children's
densities. The node of the largest sum is the main subtree; the least density on its path to the body is the
threshold by which other subtrees outside it still count as content. An ``article`` or ``main`` element
around the main subtree is taken whole.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments leave
the tree before densities are taken: by element, by role and by whole names in class and id. By name, an element stays
that holds an ``article`` or ``main`` or more than half of the page's text outside links. Headings in an article's header stay.

Character references are decoded, white space within a block becomes one space, blocks are trimmed and joined by
a blank line. Null, empty and textless pages give an empty string. Broken markup is read as browsers
do in the main: open paragraphs and list items end at the next block, end tags close what they can, an unclosed
comment or script ends with the page. Depth and size are not limited; nothing is recursive.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm.common import small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table caption tbody tfoot thead tr ul".split()
)
_ENDS_P = _BLOCK - {"html", "body", "caption", "tbody", "tfoot", "thead", "tr"}
#: An open element of the first kind ends where one of the second begins, unless one of the third stands between.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
_OUT = frozenset("nav footer aside form button select option input textarea dialog menu object embed audio video canvas map label fieldset legend datalist".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar side aside rail widget widgets footer foot header masthead topbar toolbar comment comments commentlist disqus respond reply replies "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations teaser teasers pagination pager tags copyright disclaimer legal skip".split()
)
_KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _unwanted(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether an element is unwanted by itself, and whether by a name in its class or id."""
    if tag in _OUT:
        return True, False
    if not raw or tag in ("html", "body"):
        return False, False
    own: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        if m[1]:  # the first of repeated attributes counts
            own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if own.get("role", "").strip().lower() in _OUT_ROLES or "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(own.get("style", "")):
        return True, False
    names = f"{own.get('class', '')} {own.get('id', '')}".lower().split()
    return False, tag not in _KEPT and any(w in _OUT_WORDS for w in names)


class Tree:
    """Nodes in page order (a parent stands before its children) and the events of the page."""

    def __init__(self, page: str):
        self.tags, self.parent, self.out, self.named, self.events = ["#root"], [-1], [False], [False], []
        path = [0]
        at, lower = 0, None
        for m in _TOKEN.finditer(page):
            if m.start() < at:
                continue  # inside a raw element
            if m.start() > at:
                self.events.append((path[-1], page[at : m.start()]))
            at = m.end()
            closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.events.append((path[-1], html.escape(m[0][9:].removesuffix("]]>"))))
                continue
            tag = tag.lower()
            if closing:
                self._close(tag, path)
                continue
            if tag in _RAW:
                if not raw.rstrip().endswith("/"):
                    lower = page.lower() if lower is None else lower
                    end = lower.find(f"</{tag}", at)
                    stop = page.find(">", end) if end >= 0 else -1
                    at = len(page) if stop < 0 else stop + 1
                continue
            if tag in _ENDS_P:
                self._end({"p"}, {"table", "td", "th", "button", "article", "div", "section", "li", "blockquote", "main"}, path)
            if tag in _SIBLINGS:
                self._end(*_SIBLINGS[tag], path)
            if tag in _HEADING and self.tags[path[-1]] in _HEADING:
                self._pop(path)
            node = len(self.tags)
            self.tags.append(tag)
            self.parent.append(path[-1])
            out, named = _unwanted(tag, raw)
            self.out.append(out)
            self.named.append(named)
            self.events.append((node, None))
            if tag not in _VOID and not (raw.endswith("/") and tag not in _BLOCK and tag not in ("a", "b", "i", "span", "em", "strong")):
                path.append(node)
        if at < len(page):
            self.events.append((path[-1], page[at:]))

    def _pop(self, path: list[int]) -> None:
        self.events.append((path.pop(), None))

    def _end(self, kinds: set[str], stops: set[str], path: list[int]) -> None:
        for k in range(len(path) - 1, 0, -1):
            tag = self.tags[path[k]]
            if tag in kinds:
                while len(path) > k:
                    self._pop(path)
                return
            if tag in stops:
                return

    def _close(self, tag: str, path: list[int]) -> None:
        block = tag in _BLOCK
        for k in range(len(path) - 1, 0, -1):
            own = self.tags[path[k]]
            if own == tag:
                while len(path) > k:
                    self._pop(path)
                return
            if not block and own in _BLOCK:  # an inline end tag closes nothing beyond its block
                return


def _named_out(tree: Tree) -> list[bool]:
    """Elements that their class or id drops: not those around an article or most of the text outside links."""
    n, tags, parent = len(tree.tags), tree.tags, tree.parent
    if not any(tree.named):
        return tree.named
    out, anchor, holds, plain = [False] * n, [False] * n, [False] * n, [0] * n
    for k in range(1, n):
        out[k] = out[parent[k]] or tree.out[k]
        anchor[k] = anchor[parent[k]] or tags[k] == "a"
        holds[k] = tags[k] in ("article", "main") and not out[k]
    for node, text in tree.events:
        if text is not None and not out[node] and not anchor[node]:
            plain[node] += len("".join(text.split()))
    for k in range(n - 1, 0, -1):
        plain[parent[k]] += plain[k]
        holds[parent[k]] = holds[parent[k]] or holds[k]
    return [tree.named[k] and not holds[k] and 2 * plain[k] <= plain[0] for k in range(n)]


def _selected(tree: Tree) -> list[bool]:
    """Nodes whose text is the main text."""
    n, tags, parent = len(tree.tags), tree.tags, tree.parent
    named, dropped, held, heading = _named_out(tree), [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        p = parent[k]
        held[k] = held[p] or tags[k] in ("article", "main")
        heading[k] = heading[p] or tags[k] in _HEADING
        dropped[k] = dropped[p] or tree.out[k] or named[k] or (tags[k] == "header" and not held[p])
    top = [False] * n  # inside a header within an article only headings stay
    for k in range(1, n):
        top[k] = top[parent[k]] or (tags[k] == "header" and held[parent[k]])
        if top[k] and not heading[k] and tags[k] != "header":
            dropped[k] = dropped[k] or not _has_heading(tree, k)
    chars, links, count, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    anchor = [False] * n
    for k in range(1, n):
        anchor[k] = anchor[parent[k]] or tags[k] == "a"
    for node, text in tree.events:
        if text is not None and not dropped[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if anchor[node]:
                links[node] += size
    for k in range(n - 1, 0, -1):
        if not dropped[k]:
            p = parent[k]
            chars[p] += chars[k]
            links[p] += links[k]
            count[p] += count[k] + 1
            link_tags[p] += link_tags[k] + (tags[k] == "a")
    share = links[0] / chars[0] if chars[0] else 0.0
    density = [0.0] * n
    for k in range(n):
        c, l, t, lt = chars[k], links[k], max(count[k], 1), max(link_tags[k], 1)
        if c and not dropped[k]:
            base = math.log(c / max(c - l, 1) * l + share * c + math.e)
            density[k] = max(c / t * math.log(c / max(l, 1) * t / lt + 1e-9) / math.log(max(base, 1.0001)), 0.0) if base > 1 else c / t * math.log(c / max(l, 1) * t / lt + 1e-9)
    total = [0.0] * n
    for k in range(1, n):
        if not dropped[k]:
            total[parent[k]] += density[k]
    main = max(range(n), key=lambda k: (total[k], -k)) if n else 0
    if not total[main]:
        main = max(range(n), key=lambda k: (chars[k] if not dropped[k] else -1, -k))
    least, k = density[main], main
    while k > 0:
        least = min(least, density[k])
        if tags[k] == "body":
            break
        k = parent[k]
    whole, k = main, main
    while k > 0:
        if tags[k] in ("article", "main"):
            whole = k
        k = parent[k]
    inside = [False] * n
    wide = tags[whole] in ("article", "main")
    for k in range(n):
        if dropped[k]:
            continue
        if k == whole or (k and inside[parent[k]]):
            inside[k] = True
        elif not wide and k and density[k] >= least and links[k] * 2 < chars[k] and not _above(parent, k, whole):
            inside[k] = True
        elif not wide and tags[k] == "h1":
            inside[k] = True
    return inside


def _above(parent: list[int], k: int, node: int) -> bool:
    """Whether k is an ancestor of node."""
    while node > k:
        node = parent[node]
    return node == k


def _has_heading(tree: Tree, k: int) -> bool:
    """Whether a heading stands below node k (its subtree follows it without a break)."""
    for j in range(k + 1, len(tree.tags)):
        if tree.parent[j] < k:
            return False
        if tree.tags[j] in _HEADING:
            return True
    return False


def extract(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    inside, blocks, held = _selected(tree), [], []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    for node, text in tree.events:
        tag = tree.tags[node]
        if text is None:
            if tag in _BLOCK:
                flush()
            elif inside[node] and tag in ("br", "td", "th", "img", "wbr"):
                held.append("" if tag == "wbr" else " ")
        elif inside[node]:
            held.append(html.unescape(text))
    flush()
    return "\n\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            cols = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *cols], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
