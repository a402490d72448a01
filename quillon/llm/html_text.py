"""Main text of web pages by composite text density.

A page is parsed into a tree. Every node gets its composite density:
characters per tag, adjusted for the characters and tags inside links and for
the page's own link share. A node's sum is that of its children's densities.
The node with the largest sum is the core; the threshold is the least density
on the path from it to body, and siblings along the path join if their density
reaches it, as do headings beside it. An article or main element around the
core is evidence: it is taken whole if the core holds most of its text.

Scripts, styles and the like are never text. Elements that say that they are
menus, page headers and footers, sidebars or dialogs (by tag, role or hidden)
are left out, and so are forms and those whose class or id looks like such, like
notices, adverts or reader comments, unless the densities speak for these:
where no article or main element stands outside of suspects and the densest
subtree among them is more than twice as dense as the densest outside, or
there is no text outside, the elements around it are not suspected any more
(reader comments only if there is nothing else).

Character references are decoded, white space inside a block is one space,
and blocks (any block element or line break parts them) are joined by \\n.
Null, empty and text-free pages give an empty text; of equally dense subtrees
the first is the core; repeated rows are extracted alike. Broken markup (unclosed
or stray tags, a page cut off anywhere) is parsed as far as it goes, at any
depth. A very long page is held whole, in about twenty times its bytes. Rows
and other columns pass through; a column named like the output is replaced.
"""

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm._text import with_columns

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
CUT_OFF = re.compile(r"</?\Z")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements whose content is never text of the page.
HARD = {"head", "script", "style", "noscript", "template", "iframe", "select", "textarea", "title", "svg", "canvas", "object", "audio", "video", "xmp"}
SUSPECT_TAGS = {"nav", "footer", "aside", "button", "menu", "dialog"}
#: How many times as dense as all else a suspect must be to be none.
DENSER = 2
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond)(?:[\s_-]|$)")
HEADINGS = {"h1", "h2", "h3", "hgroup"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar"
    r"|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|widget|toolbar|pagination|pager|search)(?:[\s_-]|$)"
)
#: An open element of the key is closed by the start of one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}


class Page:
    """The tree as parallel lists; pieces: (node, block, text) in page order.

    places: of the open elements of each tag in the stack; solid: of those that
    are not inline. With them no start or end tag searches the stack, so time
    is in proportion at any depth.
    """

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.hard, self.link = ["#"], [-1], [False], [False]
        self.suspect, self.sure, self.comment = [False], [False], [False]
        self.pieces: list[tuple[int, int, str]] = []
        self.stack, self.block = [0], 0
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self.read(html)

    def text(self, raw: str) -> None:
        if raw and not self.hard[node := self.stack[-1]]:
            self.pieces.append((node, self.block, unescape(raw)))

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.block += 1
            self.imply(tag)
        if tag in VOID:
            return
        up = self.stack[-1]
        sure = tag in SUSPECT_TAGS or tag == "header" and not (self.places.get("article") or self.places.get("main"))
        suspect, comment = tag == "form", False
        if attributes:
            told, named, comment = self.named(tag, attributes)
            sure, suspect = sure or told, suspect or named
        self.tag.append(tag)
        self.parent.append(up)
        self.hard.append(self.hard[up] or tag in HARD)
        self.suspect.append(suspect or sure)
        self.sure.append(sure)
        self.comment.append(comment)
        self.link.append(self.link[up] or tag == "a")
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def cut(self, k: int) -> None:
        """Close the open elements from place k of the stack on."""
        for node in self.stack[k:]:
            self.places[self.tag[node]].pop()
        while self.solid and self.solid[-1] >= k:
            self.solid.pop()
        del self.stack[k:]

    @staticmethod
    def named(tag: str, attributes: str) -> tuple[bool, bool, bool]:
        """Whether the attributes say that an element is noise, whether its names make it suspect, and whether as reader comments."""
        sure = suspect = comment = False
        for name, value in ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            name = name.lower()
            if name == "hidden" and tag not in ("html", "body") or name == "aria-hidden" and value == "true":
                sure = True
            elif name == "role":
                sure = sure or value in NOISE_ROLES
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main") and NOISE_NAMES.search(value):
                suspect, comment = True, comment or COMMENT_NAMES.search(value) is not None
        return sure, suspect, comment

    def imply(self, tag: str) -> None:
        """Close what the start of a block closes: an open paragraph, a list item before its next, and so on."""
        for k in reversed(self.solid):  # at most one of each tag in CLOSES before it returns
            open_ = self.tag[self.stack[k]]
            if open_ == "p" and tag != "br" or tag in CLOSES.get(open_, ()):
                self.cut(k)
                return
            if open_ not in CLOSES:
                return
            if tag not in ("li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "body") and open_ in CLOSES:
                return

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if not (places := self.places.get(tag)):
            return
        if tag in INLINE and self.solid and self.solid[-1] > places[-1]:  # a stray inline end does not close blocks
            return
        self.cut(places[-1])

    def read(self, html: str) -> None:
        at = 0
        while (m := TOKEN.search(html, at)) is not None:
            self.text(html[at : m.start()])
            at = m.end()
            end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self.close(tag)
                continue
            if tag in RAW:
                self.block += tag not in INLINE
                over = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = over.end() if over else len(html)
                continue
            self.open(tag, attributes)
        self.text(CUT_OFF.sub("", html[at:]))  # a page may end within a tag


def densities(page: Page, gone: list[bool], chars: list[int], link_chars: list[int]) -> tuple[list[float], list[float], list[int]]:
    """Composite density of each node that is not gone, the sum of its children's, and its characters."""
    n = len(page.tag)
    c, lc, t, lt = chars[:], link_chars[:], [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        p = page.parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        t[p] += t[i] + 1
        lt[p] += lt[i] + page.link[i]
    share = lc[0] / max(1, c[0])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if gone[i] or not c[i]:
            continue
        base = log(c[i] / max(1, c[i] - lc[i]) * lc[i] + share * c[i] + e)
        density[i] = c[i] / max(1, t[i]) * log(max(1.0, c[i] / max(1, lc[i]) * max(1, t[i]) / max(1, lt[i])) + e - 1) / log(base + e - 1)
        if i:
            sums[page.parent[i]] += density[i]
    return density, sums, c


def without(page: Page, cleared: set[int] = frozenset()) -> list[bool]:
    """Nodes that are left out: hard ones and what is inside suspects that are not cleared."""
    gone = [False] * len(page.tag)
    for i in range(1, len(gone)):
        gone[i] = gone[page.parent[i]] or page.hard[i] or page.suspect[i] and i not in cleared
    return gone


def path_up(page: Page, node: int) -> list[int]:
    path = [node]
    while path[-1] > 0:
        path.append(page.parent[path[-1]])
    return path


def cleared_by_density(page: Page, gone: list[bool], sums: list[float], c: list[int], chars: list[int], link_chars: list[int]) -> set[int]:
    """Suspects that the densities speak for."""
    n = len(gone)
    if c[0] and any(page.tag[i] in ("article", "main") and not gone[i] and c[i] for i in range(n)):
        return set()
    density, inner, _ = densities(page, page.hard, chars, link_chars)
    sure = [False] * n
    for i in range(1, n):
        sure[i] = sure[page.parent[i]] or page.sure[i]
    suspects = [i for i in range(n) if gone[i] and not sure[i] and not page.hard[i] and density[i]]
    if not suspects:
        return set()
    best = max(suspects, key=lambda i: (inner[i] or density[i], -i))
    path = path_up(page, best)
    if c[0] and ((inner[best] or density[best]) <= DENSER * max(sums) or any(page.comment[i] for i in path)):
        return set()
    return {i for i in path if page.suspect[i]}


def main_text(html: str | None) -> str:
    """The page's article, blocks joined by newlines."""
    if not html:
        return ""
    page = Page(html)
    n = len(page.tag)
    chars, link_chars = [0] * n, [0] * n
    for node, _, text in page.pieces:
        size = len("".join(text.split()))
        chars[node] += size
        if page.link[node]:
            link_chars[node] += size
    if not any(chars):
        return ""
    gone = without(page)
    density, sums, c = densities(page, gone, chars, link_chars)
    if any(gone[i] and chars[i] for i in range(n)) and (cleared := cleared_by_density(page, gone, sums, c, chars, link_chars)):
        gone = without(page, cleared)
        density, sums, c = densities(page, gone, chars, link_chars)
    core = max(range(n), key=lambda i: (sums[i], -i)) if any(sums) else 0
    path = path_up(page, core)
    threshold = min((density[x] for x in path if page.tag[x] not in ("#", "html")), default=density[core])
    kept = [False] * n
    kept[core] = True
    for i in path:
        kept[i] = kept[i] or page.tag[i] in ("article", "main") and 2 * c[core] >= c[i]
    on_path = set(path)
    for i in range(1, n):
        up = page.parent[i]
        if up in on_path and i not in on_path and not kept[up] and page.tag[i] != "a" and (density[i] >= threshold or page.tag[i] in HEADINGS and up == page.parent[core]):
            kept[i] = True
    for i in range(1, n):
        kept[i] = (kept[i] or kept[page.parent[i]]) and not gone[i]
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(html: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                pages = batch.column(batch.schema.get_field_index(html)).to_pylist()
                yield with_columns(batch, {html}, {"text": pa.array([main_text(p) for p in pages], pa.string())})

    return run


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text string."""
    keep = [f for f in pages.schema.fields if f.name not in (html, "text")]
    return pages.select(*(f.name for f in keep), html).mapInArrow(_extract(html), T.StructType([*keep, T.StructField("text", T.StringType())]))
