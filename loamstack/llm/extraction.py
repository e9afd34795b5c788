"""Main text of web pages by tag-path ratios.

A page is read into blocks (text between block-level tags), each with its root-to-leaf path of block-level tags. Per path, the text
outside links and the punctuation are summed over the page and divided by the path's blocks; the two ratios are laid along the page,
smoothed by a Gaussian, fused by a product and held against a threshold from their spread. Blocks at or over the threshold, and all
others of their paths, are content.

What is content selects the article: the lowest element that holds nearly all content (an ``article`` or ``main`` that holds it, or
else what lies between its first and its last content block, with the heading before). In it the content blocks are kept, and of the
other ones those that are no links: short paragraphs and headings of the article. An ``article`` only loses runs of three and more.

Names say what is no content, but have not the last word. Menus, footers, forms and the like, and elements whose class, id or role
is such a name as a whole, are dropped; but where the page's article lies in one of them, or no prose is left outside, the elements
that hold it are kept after all.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one newline.
Line breaks (``br``) and inline tags do not end a block. Markup may be broken: end tags may be missing, wrong or too many. Time and
memory are linear in the page, however deep its tags are nested.

Defined results. Null, empty or textless html: empty text. Very long pages are read whole. Repeated rows are extracted each on
its own; an empty table stays empty; extra columns are ignored by ``report`` and passed on by ``extract``, which refuses a table that
has columns of its results' names.
"""

from __future__ import annotations

import functools
import html as entities
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import in_batches, require

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "select", "canvas", "audio", "video"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary center hr hgroup dialog menu search legend head".split())
_LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary blockquote".split())
_DROPPED = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "search", "head", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "status"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Words that, as the first or last part of a class or an id, mark an element as none of the article ...
_MARKS = set("ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer foot masthead header topbar comment comments commentlist respond disqus replies reply share sharing social related recommended newsletter subscribe signup login search searchform pagination pager toolbar skip".split())
#: ... unless one of these is a part, too: they speak of the article itself, or say that something is (not) there.
_OWN = set("has with no without is not article entry post content main page body text science title results result story wrapper container layout".split())
_PARTS = re.compile(r"[a-z0-9]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CLOSES |= {h: {"p"} for h in _BLOCK - set(_CLOSES) - {"html", "body", "head"}}
_FENCE = {"table", "ul", "ol", "dl", "body", "article", "section", "main", "div", "td", "th"}
_ARTICLE, _KEPT = {"article", "main"}, {"html", "body", "main", "article"}
#: Elements that never hold an article, and the least characters of a block that may be one.
_NEVER, _PROSE = {"nav", "footer", "menu", "head", "button", "search"}, 80
_PUNCTUATION = re.compile(r"[.,;:!?…¿¡。，、]")


class Node:
    """An open or closed element. ``drop`` says that the element itself is to go by its tag or name, ``inside`` that it is (in) an article."""

    __slots__ = ("block", "drop", "hidden", "inside", "leads", "name", "number", "owner", "parent", "path")

    def __init__(self, number: int, name: str, parent: Node | None, drop: bool, block: bool, paths: dict[tuple[int, str], int]) -> None:
        self.number, self.name, self.parent, self.drop, self.block, self.hidden = number, name, parent, drop, block, False
        self.owner = self if block else parent.owner
        # a path is named by a number: that of its parent's path and the tag
        self.path = 0 if parent is None else paths.setdefault((parent.path, name), len(paths) + 1) if block else parent.path
        self.inside = name in _ARTICLE and not drop or bool(parent and parent.inside)
        self.leads = False


class Block:
    __slots__ = ("links", "node", "text")

    def __init__(self, node: Node, text: str, links: int) -> None:
        self.node, self.text, self.links = node, text, links


def _named(value: str) -> bool:
    """Whether a class or an id names something that is none of the article."""
    for token in value.lower().split():
        parts = _PARTS.findall(token)
        if parts and (parts[0] in _MARKS or parts[-1] in _MARKS) and _OWN.isdisjoint(parts):
            return True
    return False


def _judged(name: str, rest: str, in_article: bool) -> tuple[bool, bool]:
    """(to be dropped, hidden) by tag, name, role and style."""
    drop = name in _DROPPED or name == "header" and not in_article
    if "=" not in rest and "hidden" not in rest:
        return drop, False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, True
        drop = drop or key == "role" and value.lower() in _ROLES or key in ("class", "id") and name not in ("html", "body", "main") and _named(value)
    return drop, False


class Reader:
    """Reads a page into blocks and elements; ``stack`` are the open elements."""

    def __init__(self, html: str) -> None:
        self.html, self.paths = html, {}
        root = Node(0, "", None, False, True, self.paths)
        self.nodes, self.stack, self.blocks = [root], [root], []
        self.opens: dict[str, list[int]] = {}  # depths at which a name is open
        self.fences = [0]  # depths of open elements that end tags of other kinds don't reach through
        self.parts: list[str] = []
        self.linked, self.link = 0, None  # characters inside links; (depth, element) of the open link

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.blocks.append(Block(self.stack[-1], text, self.linked))
                self.stack[-1].owner.leads = True
        self.linked = 0

    def add(self, text: str) -> None:
        text = entities.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.link:
            depth, node = self.link
            if depth < len(self.stack) and self.stack[depth] is node:
                self.linked += len(text)
            else:
                self.link = None  # the end of a block has closed it

    def close(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on."""
        for node in self.stack[depth:]:
            self.opens[node.name].pop()
            if node.name in _FENCE:
                self.fences.pop()
        del self.stack[depth:]

    def end(self, name: str) -> None:
        if name == "a":
            self.link = None
        at = self.opens.get(name)
        inline = name not in _BLOCK
        if not at or inline and at[-1] < self.fences[-1]:  # an inline end tag closes nothing beyond its block
            if not inline:
                self.flush()
            return
        node = self.stack[at[-1]]
        if not inline or node.drop:
            self.flush()
        self.close(at[-1])

    def implied(self, name: str) -> None:
        """Closes what the start of a block ends without saying so."""
        closes = _CLOSES.get(name)
        if not closes or not any(self.opens.get(c) for c in closes):
            return
        if closes == {"p"}:
            if self.opens["p"][-1] > self.fences[-1]:
                self.close(self.opens["p"][-1])
            return
        fence = next((d for d in reversed(self.fences) if self.stack[d].name not in closes), 0)
        depths = [self.opens.get(c, []) for c in closes]  # each ascending
        if least := [x[k] for x in depths if (k := bisect_right(x, fence)) < len(x)]:
            self.close(min(least))

    def start(self, name: str, rest: str) -> None:
        block = name in _BLOCK
        if block:
            self.flush()
            self.implied(name)
        if name in _VOID:
            return
        parent = self.stack[-1]
        drop, hidden = _judged(name, rest, parent.inside)
        if name in _HEADINGS and parent.name == "header" and parent.inside:
            drop = False
        if drop and not block:
            self.flush()
        node = Node(len(self.nodes), name, parent, drop, block, self.paths)
        node.hidden = hidden
        self.nodes.append(node)
        self.opens.setdefault(name, []).append(len(self.stack))
        if name in _FENCE:
            self.fences.append(len(self.stack))
        self.stack.append(node)
        if name == "a":  # an anchor without a target is no link; each one ends the one before
            self.link = (len(self.stack) - 1, node) if any(x[1].lower() == "href" for x in _ATTRIBUTE.finditer(rest)) else None

    def read(self) -> Reader:
        html, at = self.html, 0
        last = html.rfind(">")
        while at < len(html):
            m = _TAG.search(html, at) if at <= last else None
            if m is None:
                self.add(html[at:])
                break
            if m.start() > at:
                self.add(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                if m["data"]:
                    self.parts.append(m["data"])
            elif m["end"]:
                self.end(name.lower())
            elif (name := name.lower()) == "br":
                self.parts.append(" ")
            elif name in _RAW:
                close = _raw_end(name).search(html, at)
                if not m["rest"].rstrip().endswith("/") or name not in ("svg", "math"):
                    end = html.find(">", close.end()) if close else -1
                    at = len(html) if close is None else end + 1 if end >= 0 else len(html)
                self.parts.append(" ")
            else:
                self.start(name, m["rest"])
        self.flush()
        return self


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I)


def _dropped(nodes: list[Node], kept: set[int]) -> list[bool]:
    """Of each element whether it is gone, with all that it lies in."""
    out = [False] * len(nodes)
    for n in nodes[1:]:
        out[n.number] = out[n.parent.number] or n.hidden or n.drop and n.number not in kept
    return out


def _prose(b: Block) -> int:
    """Characters of a block that reads like a paragraph, else 0."""
    own = len(b.text) - b.links
    return own if own >= _PROSE and _PUNCTUATION.search(b.text) else 0


def _blocks_left(page: Reader) -> list[Block]:
    """The blocks outside of what names, tags and roles say is no content, unless what they say leaves less than they take."""
    gone = _dropped(page.nodes, set())
    left = [b for b in page.blocks if not gone[b.node.number]]
    if any(b.node.inside for b in left):
        return left
    # the article may lie in an element that goes by its name: the one with the most prose counts, if it has more than what is left
    article, size = [0] * len(page.nodes), {}
    for n in page.nodes[1:]:
        article[n.number] = 0 if not n.inside else article[n.parent.number] or n.number
    for b in page.blocks:
        if (k := article[b.node.number]) and not any(x.hidden for x in (b.node, page.nodes[k])):
            size[k] = size.get(k, 0) + _prose(b)
    best = max(size, key=lambda k: (size[k], -k), default=0)
    if best and size[best] > sum(map(_prose, left)):
        kept, up = set(), page.nodes[best]
        while up is not None:
            kept.add(up.number)
            up = up.parent
        gone = _dropped(page.nodes, kept)
        return [b for b in page.blocks if not gone[b.node.number]]
    kept = set()
    while not any(map(_prose, left)):
        # no prose is left: of the elements that go by their names, the outermost one with the most of it stays after all
        size, outer = {}, [0] * len(page.nodes)
        for n in page.nodes[1:]:
            outer[n.number] = outer[n.parent.number] or (n.number if n.drop and n.number not in kept and n.name not in _NEVER else 0)
        for b in page.blocks:
            if (k := outer[b.node.number]) and not page.nodes[k].hidden and _prose(b):
                size[k] = size.get(k, 0) + _prose(b)
        if not size:
            break
        kept.add(max(size, key=lambda k: (size[k], -k)))
        gone = _dropped(page.nodes, kept)
        left = [b for b in page.blocks if not gone[b.node.number]]
    return left


def _smoothed(x: np.ndarray, spread: float = 1.0) -> np.ndarray:
    reach = min(3, len(x) - 1)
    if reach < 1:
        return x
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    padded = np.pad(x, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def content_paths(blocks: list[Block], strictness: float = 0.5) -> set[int]:
    """The paths whose fused ratio reaches the threshold anywhere on the page."""
    size, marks, times = {}, {}, {}
    for b in blocks:
        p = b.node.path
        own = max(0, len(b.text) - b.links)
        size[p] = size.get(p, 0) + own
        marks[p] = marks.get(p, 0) + len(_PUNCTUATION.findall(b.text))
        times[p] = times.get(p, 0) + 1
    ratio = np.array([size[b.node.path] / times[b.node.path] for b in blocks], float)
    pointed = np.array([marks[b.node.path] / times[b.node.path] for b in blocks], float)
    fused = _smoothed(ratio) * (1 + _smoothed(pointed))
    least = min(strictness * fused.std(), fused.max())
    return {b.node.path for b, f in zip(blocks, fused, strict=True) if f >= least}


def _container(page: Reader, blocks: list[Block], content: list[bool]) -> Node:
    """The lowest element that holds nine tenths of the content, no single paragraph or the like."""
    weight = [0.0] * len(page.nodes)
    for b, c in zip(blocks, content, strict=True):
        weight[b.node.number] += len(b.text) - b.links if c else 0
    total = sum(weight)
    for n in reversed(page.nodes[1:]):  # an element's number is greater than its parent's
        weight[n.parent.number] += weight[n.number]
    at = max((b for b, c in zip(blocks, content, strict=True) if c), key=lambda b: len(b.text)).node
    chain = [at]
    while chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    holder = chain.pop()
    for n in reversed(chain):
        if n.name in _LEAF or weight[n.number] < 0.9 * total or n.leads and n.name not in _KEPT:
            break
        holder = n
    return holder


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Reader(html).read()
    blocks = _blocks_left(page)
    if not blocks:
        return ""
    if all(b.links >= len(b.text) for b in blocks):  # an end tag is missing, or there is nothing but links: they tell nothing
        for b in blocks:
            b.links = 0
    paths = content_paths(blocks)
    content = [b.node.path in paths and len(b.text) > b.links for b in blocks]
    if not any(content):
        return ""
    holder = _container(page, blocks, content)
    within = [False] * len(page.nodes)
    for n in page.nodes:
        within[n.number] = n is holder or n.parent is not None and within[n.parent.number]
    inside = [i for i, b in enumerate(blocks) if within[b.node.number]]
    sure = holder.inside or any(blocks[i].node.inside and content[i] for i in inside)
    if sure and not holder.inside:
        inside = [i for i in inside if blocks[i].node.inside]  # several articles, or one and its frame
    elif not sure:  # no element says where the article is
        first, last = min(i for i in inside if content[i]), max(i for i in inside if content[i])
        while first and blocks[first - 1].node.name in _HEADINGS and within[blocks[first - 1].node.number]:
            first -= 1
        inside = [i for i in inside if first <= i <= last]
    # what is no content is kept for its place in the article, unless it is links for the most part
    linked = [not content[i] and 2 * blocks[i].links > len(blocks[i].text) for i in inside]
    out, at = [], 0
    while at < len(inside):
        stop = at + 1
        while linked[at] and stop < len(inside) and linked[stop]:
            stop += 1
        if not linked[at] or sure and stop - at < 3:
            out += [blocks[i].text for i in inside[at:stop]]
        at = stop
    return "\n".join(out)


def extract(pages: DataFrame, *, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without its html, with the text and its number of code points (``n_chars``)."""
    require(pages, **{html: T.StringType})
    keep = [c for c in pages.columns if c != html]
    if taken := {name, "n_chars"} & set(keep):
        raise ValueError(f"columns {sorted(taken)} are there already; rename them, or choose another name for the result")
    at, positions = pages.columns.index(html), [pages.columns.index(c) for c in keep]

    def run(batches):
        for table in in_batches(batches, 16 << 20):
            texts = [main_text(x) for x in table.column(at).to_pylist()]
            yield from table.select(positions).append_column(name, pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(x) for x in texts], pa.int64())).combine_chunks().to_batches()

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in keep), *T.StructType.fromDDL(f"`{name}` string, n_chars long").fields]))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
