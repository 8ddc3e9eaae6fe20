"""Pages as arrays of DOM nodes and pieces of text, for ``html_text``.

A page is read once, left to right: comments are skipped, the content of scripts and the like is
passed over, attributes are read for the words of their classes and roles, and elements that close
implicitly (paragraphs, list items, cells) are closed as browsers do. Every element is a node with its
parent; text belongs to the element that holds it. A break stands wherever a block begins or ends.
Broken markup never fails: unmatched end tags are ignored, unclosed elements end with the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+>?", re.S)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOP = re.compile(r"[.!?…。](?=\s|$)")

#: Kinds of elements, in the order of their codes; elements not named are ``other``.
KINDS = {
    "root": "html body",
    "article": "article main",
    "box": "div section center details summary hgroup",
    "paragraph": "p",
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol dl",
    "item": "li dt dd",
    "nav": "nav menu dir search",
    "header": "header",
    "footer": "footer",
    "aside": "aside dialog",
    "form": "form fieldset label button input legend output",
    "link": "a",
    "inline": "b i em strong span u s small big sub sup code kbd q cite mark abbr time font tt var del ins dfn samp bdi bdo",
    "table": "table tbody thead tfoot tr td th caption",
    "quote": "blockquote pre figure figcaption address",
    "noscript": "noscript noframes noembed",
    "other": "",
}
KIND = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
OTHER = len(KINDS) - 1

#: Words of classes, ids and roles that tell what an element is for, in the order of their bits.
HINTS = {
    "nav": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager tabs toc skip hamburger",
    "header": "header masthead topbar logo branding hero sitehead",
    "footer": "footer colophon copyright legal contentinfo bottom imprint",
    "side": "sidebar aside side rail widget widgets related recommended trending popular complementary teaser teasers",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted adsense banner commercial affiliate",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay dialog warning toast paywall disclaimer announcement",
    "comment": "comment comments commentlist discussion respond reply replies feedback disqus responses reviews guestbook",
    "social": "share sharing social follow tweet facebook twitter like buttons",
    "form": "form search login signin signup register subscribe subscription newsletter contact searchbox poll survey",
    "meta": "meta byline tags tag author date timestamp category categories",
    "content": "content article articlebody body post entry main story text maincontent prose maintext blog news",
    "page": "page wrapper wrap container layout site app outer inner row column col grid",
}
HINT = {word: 1 << i for i, words in enumerate(HINTS.values()) for word in words.split()}
HIDDEN = 1 << len(HINTS)
N_HINTS = len(HINTS) + 1

_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not parsed, and elements whose text is never shown as text of the page.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SILENT = frozenset("head template select svg math object canvas audio video datalist".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _RAW}
#: What an element that opens closes: (elements that it ends, elements beyond which it doesn't look).
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_KEEPS_P = frozenset("br head html body title option optgroup caption tbody td template tfoot th thead tr noscript legend".split())
_IN_HEAD = frozenset("base link meta title script style noscript template".split())


@dataclass
class Tree:
    """Nodes of some pages: parallel lists; ``pieces`` holds (node, text) pairs, and None at breaks."""

    tags: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    sign: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str] | None] = field(default_factory=list)
    pages: list[tuple[int, int]] = field(default_factory=list)  # where each page's nodes and pieces begin


_hints_of: dict[str, int] = {}


def hint_bits(attributes: str) -> int:
    """Bits of the words in class, id, role, itemprop and aria-label, and of elements that are hidden."""
    if attributes in _hints_of:
        return _hints_of[attributes]
    bits = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in _WORD.findall(_CAMEL.sub("-", value).lower()):
                bits |= HINT.get(word, 0)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
            bits |= HIDDEN
    if len(_hints_of) > 20_000:
        _hints_of.clear()
    _hints_of[attributes] = bits
    return bits


class _Builder:
    def __init__(self, tree: Tree):
        self.tree, self.stack, self.open, self.links, self.silent, self.headed = tree, [], {}, 0, 0, False
        tree.pages.append((len(tree.tags), len(tree.pieces)))
        self.push("html", 0)  # pages without the element have it too

    def push(self, tag: str, hints: int) -> None:
        t = self.tree
        up = self.stack[-1] if self.stack else -1
        self.stack.append(len(t.tags))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        self.silent += tag in _SILENT
        t.tags.append(tag)
        t.parent.append(up)
        t.depth.append(t.depth[up] + 1 if up >= 0 else 0)
        t.kind.append(KIND.get(tag, OTHER))
        t.hints.append(hints)
        for counts in (t.chars, t.linked, t.stops, t.sign):
            counts.append(0)

    def pop(self) -> str:
        tag = self.tree.tags[self.stack.pop()]
        self.open[tag] -= 1
        self.links -= tag == "a"
        self.silent -= tag in _SILENT
        if tag in _BLOCKS:
            self.tree.pieces.append(None)
        return tag

    def pop_to(self, ends: set | frozenset, beyond: set | frozenset, blocks: bool) -> None:
        """Close the innermost of ``ends``, unless one of ``beyond`` (or, with ``blocks``, another block) lies above it."""
        if not any(self.open.get(tag) for tag in ends):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tree.tags[self.stack[i]]
            if tag in ends:
                while len(self.stack) > i:
                    self.pop()
                return
            if tag in beyond or (blocks and tag in _BLOCKS):
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if tag == "body" and not self.open.get("body"):
                self.pop_to({"head"}, frozenset(), False)
                self.push("body", hint_bits(attributes) if attributes else 0)
            return
        if self.open.get("head") and tag not in _IN_HEAD:
            self.pop_to({"head"}, frozenset(), False)
        if tag in _BLOCKS:
            if tag not in _KEEPS_P:
                self.pop_to({"p"}, frozenset(), True)
            self.tree.pieces.append(None)
        if tag in _ENDS:
            self.pop_to(*_ENDS[tag], False)
        elif tag == "a":
            self.pop_to({"a"}, frozenset(), True)
        if tag not in _VOID:
            self.push(tag, hint_bits(attributes) if attributes else 0)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "p" and not self.open.get("p"):
            self.tree.pieces.append(None)
        self.pop_to({tag}, frozenset(), tag not in _BLOCKS)

    def text(self, text: str) -> None:
        if self.silent:
            return
        t, node = self.tree, self.stack[-1]
        t.pieces.append((node, text))
        if not text.isspace():
            n = len(text)
            t.chars[node] += n
            t.linked[node] += n if self.links else 0
            t.stops[node] += len(_STOP.findall(text))
            t.sign[node] |= "©" in text or "&copy" in text or "&#169" in text


def add_page(tree: Tree, html: str) -> None:
    """The page's nodes and pieces, behind those of the pages before."""
    build = _Builder(tree)
    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        if not found:
            build.text(html[at:])
            break
        if found.start() > at:
            build.text(html[at : found.start()])
        at = found.end()
        token = found.group()
        name = found.group(1)
        if name is None:
            if token[1] in "!?":
                continue
            name = _NAME.match(token, 2 if token[1] == "/" else 1)
            if not name:
                continue  # an end tag without a name
            name = name.group()
        tag = name.lower()
        if token[1] == "/":
            build.end(tag)
        elif tag in _RAW:
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else n
            if tag in _BLOCKS:
                tree.pieces.append(None)
        else:
            build.start(tag, found.group(2) or "")


def arrays(tree: Tree) -> dict[str, np.ndarray]:
    """The nodes as arrays in the order of depth and parent, with ``at``, each node's place in that order."""
    depth, parent = np.array(tree.depth, np.int64), np.array(tree.parent, np.int64)
    order = np.lexsort((np.arange(len(depth)), parent, depth))
    at = np.empty_like(order)
    at[order] = np.arange(len(order))
    up = np.where(parent[order] >= 0, at[parent[order]], -1)
    page = np.repeat(np.arange(len(tree.pages)), np.diff([*(p[0] for p in tree.pages), len(depth)])) if tree.pages else np.zeros(0, np.int64)
    out = {name: np.array(getattr(tree, name), np.int64)[order] for name in ("kind", "hints", "chars", "linked", "stops", "sign")}
    starts = np.searchsorted(depth[order], np.arange(depth.max() + 2 if len(depth) else 1))
    return out | {"parent": up, "order": order, "at": at, "page": page[order], "levels": starts}
