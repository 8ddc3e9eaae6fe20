"""Labelled pages to fit ``html_text`` on: pages whose own markup tells their parts, and copies of them in other layouts.

A page that marks its article (``article`` or ``main``) is labelled by that: what lies inside is content,
except what its elements or classes name as navigation, notes, forms and the like. From the parts of such
pages further pages are composed whose layout, element names and class names are drawn at random, so the
parts' labels are known although the markup no longer tells them as plainly. The words of parts are the pages' own.
"""

from __future__ import annotations

import random
import re

from plumbline.llm import html_tree as ht

_MORE = {name: 1 << i for i, name in enumerate(ht.HINTS)}
_OUT = sum(_MORE[n] for n in ("nav", "side", "advert", "notice", "comment", "social", "form")) | ht.HIDDEN
_KIND = {name: i for i, name in enumerate(ht.KINDS)}
_OUT_KINDS = {_KIND[n] for n in ("nav", "footer", "aside", "form", "noscript")}


def labels_by_markup(tree: ht.Tree) -> list[int] | None:
    """1 for nodes of the article, 0 for others; None for a page that marks none."""
    label, found = [], False
    for i, parent in enumerate(tree.parent):
        up = label[parent] if parent >= 0 else 0
        kind, hints = tree.kind[i], tree.hints[i]
        if kind in _OUT_KINDS or hints & _OUT:
            label.append(-1)  # and all below it
        elif up == 0 and kind == _KIND["article"]:
            label.append(1)
            found = True
        else:
            label.append(up)
    return [max(0, x) for x in label] if found else None


class Parts:
    """Texts of pages, by their role."""

    def __init__(self, pages: list[str]):
        self.headings, self.paragraphs, self.short = [], [], []
        for html in pages:
            tree = ht.Tree()
            ht.add_page(tree, html)
            label = labels_by_markup(tree)
            if label is None:
                continue
            texts: dict[int, list[str]] = {}
            for piece in tree.pieces:
                if piece and piece[1].strip():
                    texts.setdefault(piece[0], []).append(re.sub(r"[<>]", " ", piece[1]))
            for node, found in texts.items():
                text = " ".join(found)
                if label[node] and tree.kind[node] == _KIND["heading"]:
                    self.headings.append(text)
                elif label[node]:
                    self.paragraphs.append(text)
                else:
                    self.short.append(text)
        #: Texts to compose pages from where no page is labelled.
        plain = ["The ferry leaves at dawn, and the harbour is quiet until the fishing boats come back.", "Rain fell for most of the week.", "She read the letter twice, folded it, and said nothing; the others waited for an answer that did not come."]
        self.headings = self.headings or ["A quiet harbour"]
        self.paragraphs = self.paragraphs or plain
        self.short = self.short or ["Home", "About us", "Contact", "All rights reserved."]


def _pick(rng: random.Random, *choices: str) -> str:
    return rng.choice(choices)


def _named(rng: random.Random, words: str, tag: str = "div") -> str:
    """An opening tag whose class, id or role names it by one of some words, often with others beside."""
    word = rng.choice(words.split())
    dressed = _pick(rng, word, word, f"{word}-{rng.choice(['box', 'area', 'main', 'list', 'wrap', 'x1'])}", f"site-{word}", f"{rng.choice(['left', 'top', 'js', 'block'])} {word}")
    return f'<{tag} {_pick(rng, "class", "class", "id")}="{dressed}">'


#: What composed texts begin with: private characters that no element or feature knows.
CONTENT, ASIDE = "\ue001", "\ue000"


def compose(parts: Parts, rng: random.Random) -> str:
    """A page whose texts begin with the mark of what they are."""
    out: list[str] = []

    def say(text: str, label: int) -> str:
        return (CONTENT if label else ASIDE) + text

    def long() -> str:
        text = rng.choice(parts.paragraphs)
        odd = rng.random()
        if odd < 0.06:  # without punctuation
            return re.sub(r"[.,!?;:]", "", text) or text
        if odd < 0.1:  # one word again and again
            return " ".join(text.split()[:1] * rng.randint(3, 300)) or text
        return text

    def brief() -> str:
        return _pick(rng, rng.choice(parts.short), " ".join(rng.choice(parts.paragraphs).split()[: rng.randint(1, 12)]) or "x")

    def put(*bits) -> None:
        out.extend(bits)

    def links(label: int, item: str = "li") -> None:
        for _ in range(rng.randint(2, 8)):
            put(f"<{item}>" if item else "", f'<a href="/{rng.randint(1, 99)}">', say(brief(), label), "</a>", f"</{item}>" if item else " ")

    def navigation() -> None:
        shape = rng.randrange(5)
        if shape == 0:
            put("<nav>", "<ul>")
            links(0)
            put("</ul></nav>")
        elif shape == 1:
            put(_named(rng, ht.HINTS["nav"], "ul"))
            links(0)
            put("</ul>")
        elif shape == 2:
            put(_named(rng, ht.HINTS["nav"]))
            links(0, "")
            put("</div>")
        elif shape == 3:
            put('<div role="navigation"><ul>')
            links(0)
            put("</ul></div>")
        else:
            put("<ul>")
            links(0)
            put("</ul>")

    def box(words: str, tags: str, body) -> None:
        """Something beside the article, named by its element or by its class."""
        tag = rng.choice(tags.split())
        put(f"<{tag}>" if tag not in ("div", "section", "p", "ol", "ul", "article") and rng.random() < 0.5 else _named(rng, words, tag))
        body()
        put(f"</{tag}>")

    def prose(most: int = 3) -> None:
        if rng.random() < 0.4:
            put("<h3>", say(brief(), 0), "</h3>")
        for _ in range(rng.randint(1, most)):
            if rng.random() < 0.7:
                put("<p>", say(_pick(rng, brief(), long()), 0), "</p>")
            else:
                put(say(_pick(rng, brief(), long()), 0), "<br>")

    def listed() -> None:
        put("<h3>", say(brief(), 0), "</h3><ul>")
        links(0)
        put("</ul>")

    def form() -> None:
        tag = _pick(rng, "form", "form", "div")
        put("<form>" if tag == "form" else _named(rng, ht.HINTS["form"]))
        put("<p>" if rng.random() < 0.4 else "<label>", say(_pick(rng, brief(), long()), 0), '<input name="q">', "<button>", say(brief(), 0), "</button>", f"</{tag}>")

    def comments() -> None:
        tag = _pick(rng, "div", "section", "ol")
        put(_named(rng, ht.HINTS["comment"], tag))
        if rng.random() < 0.5:
            put("<h3>", say(brief(), 0), "</h3>")
        inner = "li" if tag == "ol" else _pick(rng, "div", "article", "div", "p")
        for _ in range(rng.randint(1, 4)):
            put(_named(rng, "comment reply user item entry", inner))
            if inner != "p" and rng.random() < 0.7:
                put("<p>", say(long(), 0), "</p>")
            else:
                put(say(long(), 0))
            put(f"</{inner}>")
        put(f"</{tag}>")

    asides = [
        lambda: box(ht.HINTS["advert"], "div div aside p section", lambda: put(say(_pick(rng, brief(), long()), 0))),
        lambda: box(ht.HINTS["advert"], "div div aside", prose),
        lambda: box(ht.HINTS["notice"], "div div dialog p section", lambda: put(say(_pick(rng, brief(), long()), 0))),
        lambda: box(ht.HINTS["notice"], "div dialog section", prose),
        lambda: box(ht.HINTS["side"], "div aside aside section", _pick_call(rng, listed, prose)),
        lambda: box(ht.HINTS["social"], "div ul", lambda: links(0, "")),
        form,
    ]

    def text_block(inside: bool = False) -> None:
        """A block of the article."""
        shape = rng.random()
        if shape < 0.62:
            words = long()
            put("<p>")
            if rng.random() < 0.3 and " " in words:
                a, b = words.split(" ", 1)
                tag = rng.choice("a b em span strong code i".split())
                put(f'<{tag} href="/x">' if tag == "a" else f"<{tag}>", say(a, 1), f"</{tag}>", " ", say(b, 1))
            else:
                put(say(words, 1))
            put("</p>" if rng.random() < 0.9 else "")
        elif shape < 0.7:
            put("<h2>", say(brief(), 1), "</h2>")
        elif shape < 0.78:
            put("<ul>" if rng.random() < 0.7 else "<ol>")
            for _ in range(rng.randint(2, 5)):
                put("<li>", say(_pick(rng, brief(), long()), 1), "</li>")
            put("</ul></ol>")
        elif shape < 0.83:
            put("<blockquote>", "<p>", say(long(), 1), "</p>", "</blockquote>")
        elif shape < 0.87:
            put("<table>")
            for _ in range(rng.randint(1, 4)):
                put("<tr><td>", say(brief(), 1), "</td><td>", say(brief(), 1), "</td></tr>")
            put("</table>")
        elif shape < 0.9:
            put('<figure><img src="/x.png"><figcaption>', say(brief(), 1), "</figcaption></figure>")
        elif shape < 0.93:
            put("<pre>", say(long(), 1), "</pre>")
        elif shape < 0.97 and not inside:
            put("<section>" if rng.random() < 0.5 else "<div>")
            for _ in range(rng.randint(1, 3)):
                text_block(True)
            put("</section></div>")
        else:
            put("<p>", "<b>", say(brief(), 1), "<br>", "<p>", say(long(), 1), "</p>")

    def article() -> None:
        shape = rng.randrange(12)
        opens, closes = [
            ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (_named(rng, ht.HINTS["content"]), "</div>"), (_named(rng, ht.HINTS["content"]), "</div>"),
            (_named(rng, ht.HINTS["content"], "section"), "</section>"), ('<div role="main">', "</div>"), ('<div itemprop="articleBody">', "</div>"), (f"<main>{_named(rng, ht.HINTS['content'])}", "</div></main>"),
            (_named(rng, ht.HINTS["content"], "article"), "</article>"), ("<div>", "</div>"), ("", ""),
        ][shape]
        put(opens)
        if rng.random() < 0.8:
            dressed = opens and rng.random() < 0.2
            put("<header>" if dressed else "", "<h1>", say(rng.choice(parts.headings), 1), "</h1>", "</header>" if dressed else "")
        odd = 0.12 if opens else 0.0
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            text_block()
            if rng.random() < odd:
                rng.choice(asides)()
        if opens and rng.random() < 0.15:
            comments()
        elif opens and rng.random() < 0.15:
            box(ht.HINTS["footer"], "footer footer div", lambda: put(say(brief(), 0)))
        put(closes)

    bare = rng.random()
    if bare < 0.02:  # text alone
        put(say(long(), 1), "<br>", say(long(), 1))
        return "".join(out)
    if bare < 0.1:  # nothing beside the article
        article()
        return "".join(out)
    put("<!DOCTYPE html><html><head><title>x</title></head><body>")
    wrapped = rng.random() < 0.5
    put(_pick(rng, "<div>", _named(rng, ht.HINTS["page"])) if wrapped else "")
    if rng.random() < 0.5:
        put(top := _pick(rng, "<header>", "<header>", '<div role="banner">', _named(rng, ht.HINTS["header"])))
        put(_pick(rng, '<a href="/">', "<p>", "<span>", "<h1>"), say(brief(), 0), "</a></span></h1>")
        if rng.random() < 0.4:
            put("<p>", say(_pick(rng, brief(), long()), 0), "</p>")
        if rng.random() < 0.4:
            navigation()
        put("</header>" if top == "<header>" else "</div>")
    for _ in range(rng.choice([0, 1, 1, 1, 2])):
        navigation()
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        rng.choice(asides)()
    article()
    if rng.random() < 0.4:
        comments()
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        rng.choice(asides)()
    if rng.random() < 0.8:
        put(bottom := _pick(rng, "<footer>", "<footer>", _named(rng, ht.HINTS["footer"])))
        put(_pick(rng, "", "<p>"), "&copy; " if rng.random() < 0.6 else "", say(_pick(rng, brief(), long()), 0), "</p>" if rng.random() < 0.3 else "")
        if rng.random() < 0.3:
            put("<ul>")
            links(0)
            put("</ul>")
        put("</footer>" if bottom == "<footer>" else "</div>")
    put("</div>" if wrapped else "", "</body></html>")
    return "".join(out)


def _pick_call(rng: random.Random, *calls):
    return lambda: rng.choice(calls)()


def labels_by_marks(tree: ht.Tree) -> list[int]:
    """Labels of a composed page's nodes: those of their own texts; a node without any is content where most of the text below it is."""
    own, yes, every = [-1] * len(tree.tags), [0] * len(tree.tags), [0] * len(tree.tags)
    for piece in tree.pieces:
        if piece and (CONTENT in piece[1] or ASIDE in piece[1]):
            own[piece[0]] = int(CONTENT in piece[1])
            yes[piece[0]] += len(piece[1]) * own[piece[0]]
            every[piece[0]] += len(piece[1])
    for node in range(len(own) - 1, 0, -1):
        yes[tree.parent[node]] += yes[node]
        every[tree.parent[node]] += every[node]
    most = [int(y > 0.6 * n and k != _KIND["root"]) for y, n, k in zip(yes, every, tree.kind, strict=True)]
    return [m if o < 0 else o for o, m in zip(own, most, strict=True)]
