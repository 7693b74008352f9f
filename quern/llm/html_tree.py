"""Pages as trees of block elements, their texts and what can be seen of each element."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = set("script style template noscript svg math iframe object canvas audio video head title select textarea button datalist".split())
ENDS_BEFORE = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"},
}
LIST_LIKE = set("ul ol dl table tbody thead tfoot".split())
# What may stand in a head; anything else ends it, as does text.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())

TAGS = {
    "p": "p", "h1": "h1", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "article": "article", "main": "article", "section": "section", "div": "div", "body": "body", "html": "body", "#root": "body",
    "nav": "nav", "menu": "nav", "aside": "aside", "footer": "footer", "header": "header", "form": "form", "fieldset": "form", "dialog": "form",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tbody": "table", "tr": "table", "td": "table", "th": "table",
    "pre": "quote", "blockquote": "quote", "figure": "figure", "figcaption": "figure", "address": "address",
}
_WORDS = {
    "body words": r"article|content|post|entry|story|main|body|text|prose|page|wrapper|container",
    "menu words": r"nav|menu|breadcrumb|pagination|pager|toc|skip|toolbar|tabs?\b",
    "edge words": r"header|footer|foot|masthead|banner|topbar|copyright|legal|colophon",
    "side words": r"side|aside|widget|related|recommend|popular|trending|more-|tags?\b|archive|author-bio|teaser",
    "ad words": r"\bads?\b|\bads?[-_]|[-_]ads?\b|advert|sponsor|promo|affiliate|banner-ad|dfp",
    "notice words": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|paywall|subscri|newsletter|signup|login|register|search|form",
    "talk words": r"comment|reply|replies|discuss|disqus|respond|feedback|share|social|follow|rating|review",
}
_WORDS = {k: re.compile(v) for k, v in _WORDS.items()}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…]['\"»”)]*(\s|$)")

FEATURES = [
    "bias", *sorted(f"tag {x}" for x in {*TAGS.values(), "other"}), *_WORDS, "hidden", "rights", "no text", "text under 25", "text under 80", "text over 200",
    "sentences", "links over 0.3", "links over 0.7", "child count over 3", "item with link only",
]
INDEX = {x: i for i, x in enumerate(FEATURES)}
#: Kinds of edges: a child that stands for a part of its own, a text block, or anything else.
KINDS = {x: 0 for x in ("article", "section", "div", "aside", "nav", "footer", "header", "form", "address", "body")} | {x: 1 for x in ("p", "h1", "heading", "quote", "item", "figure")}


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str = ""
    hidden: bool = False
    label: str | None = None
    runs: list[list[str]] = field(default_factory=list)
    links: int = 0
    children: int = 0


class _Reader(HTMLParser):
    """A page as a list of starts, ends and texts."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, list]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append(("start", tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.events.append(("both", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("end", tag, []))

    def handle_data(self, data: str) -> None:
        if data:
            self.events.append(("text", data, []))


class _Silences:
    """Where the silent elements of a page are over.

    That is after their own end tag. One that has none, before an element around it closes, is over with that
    element or where a block starts; a head with anything that can't stand in it. Only an unclosed script
    or style runs to the end of the page, as in browsers, since nothing tells its text from tags.
    """

    def __init__(self, events: list[tuple[str, str, list]]) -> None:
        self.events = events
        self.closed: dict[int, int] = {}
        self.limit: dict[int, int] = {}
        around: list[tuple[str, int]] = []
        count: Counter[str] = Counter()
        for i, (kind, tag, _) in enumerate(events):
            if kind == "start" and tag not in VOID and tag not in INLINE:
                around.append((tag, i))
                count[tag] += 1
            elif kind == "end" and count[tag]:
                while True:
                    last, start = around.pop()
                    count[last] -= 1
                    if last == tag:
                        self.closed[start] = i
                        break
                    self.limit[start] = i

    def over(self, i: int) -> int:
        """The event that is heard next after the start of a silent element."""
        is_head = self.events[i][1] == "head"
        if i in self.closed and not is_head:
            return self.closed[i] + 1
        end = self.closed[i] + 1 if i in self.closed else self.limit.get(i, len(self.events))
        at, unclosed_inside = i + 1, 0
        while at < end:
            kind, tag, _ = self.events[at]
            if kind == "text":
                if is_head and at >= unclosed_inside and tag.strip():
                    return at
            elif kind != "end":
                if tag in TAGS or (is_head and tag not in IN_HEAD):
                    return at
                if kind == "start" and tag in SILENT:
                    if at in self.closed:
                        at = self.closed[at]
                    else:
                        unclosed_inside = max(unclosed_inside, self.limit.get(at, end))
            at += 1
        return end


class _Builder:
    def __init__(self, html: str) -> None:
        self.nodes = [Node("#root", -1)]
        self.stack = [0]
        self.order: list[tuple[int, list[str]]] = []  # runs of text and whose they are, in page order
        self.run: list[str] | None = None
        self.in_link = False
        events = _Reader(html).events
        silences = _Silences(events)
        at = 0
        while at < len(events):
            kind, tag, attrs = events[at]
            if kind == "text":
                self.handle_data(tag)
            elif kind == "end":
                self.handle_endtag(tag)
            elif tag not in SILENT:
                self.handle_starttag(tag, attrs)
                if kind == "both" and tag not in VOID and tag not in INLINE:
                    self.handle_endtag(tag)
            elif kind == "start":
                at = silences.over(at)
                continue
            at += 1

    def _break(self) -> None:
        self.run, self.in_link = None, False

    def _pop(self, depth: int) -> None:
        del self.stack[depth:]
        self._break()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = True
            if tag in ("br", "wbr", "img"):
                self.handle_data(" " if tag == "br" else "")
            return
        if tag in VOID:
            self._break()
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.nodes[self.stack[depth]].tag
            if open_tag == "p" or open_tag in ENDS_BEFORE.get(tag, ()):
                self._pop(depth)
            elif tag not in ENDS_BEFORE or open_tag in LIST_LIKE:
                break
        values = {k: v or "" for k, v in attrs}
        if tag in ("html", "body") and len(self.nodes) > 1 and any(n.tag == tag for n in self.nodes):
            return
        parent = self.stack[-1]
        self.nodes[parent].children += 1
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or bool(_HIDDEN.search(values.get("style", "")))
        about = " ".join(values.get(k, "") for k in ("id", "class", "role", "aria-label")).lower()
        self.nodes.append(Node(tag, parent, about, hidden, values.get("data-label")))
        self.stack.append(len(self.nodes) - 1)
        self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.in_link = self.in_link and tag != "a"
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.nodes[self.stack[depth]].tag == tag:
                self._pop(depth)
                return

    def handle_data(self, data: str) -> None:
        if not data:
            return
        node = self.nodes[self.stack[-1]]
        if self.run is None:
            self.run = []
            node.runs.append(self.run)
            self.order.append((self.stack[-1], self.run))
        self.run.append(data)
        if self.in_link:
            node.links += len(data.strip())


def clean(run: list[str]) -> str:
    """A block's text: each run of white space one space, none at the ends."""
    return _SPACE.sub(" ", "".join(run)).strip()


class Page:
    """Nodes in order of their start, parents first; ``blocks`` are (node, text) in page order."""

    def __init__(self, html: str):
        builder = _Builder(html)
        self.nodes = builder.nodes
        self.parent = [n.parent for n in self.nodes]
        self.blocks = [(i, t) for i, run in builder.order if (t := clean(run))]
        texts: list[list[str]] = [[] for _ in self.nodes]
        for i, t in self.blocks:
            texts[i].append(t)
        self.features = [self._seen(n, " ".join(t)) for n, t in zip(self.nodes, texts)]
        self.kind = [KINDS.get(TAGS.get(n.tag, "other"), 2) for n in self.nodes]

    @staticmethod
    def _seen(node: Node, text: str) -> list[int]:
        """The features that hold for a node."""
        tag = TAGS.get(node.tag, "other")
        share = node.links / max(1, len(text))
        holds = {
            "bias": True, f"tag {tag}": True, "hidden": node.hidden, "rights": "©" in text or "all rights reserved" in text.lower(), "no text": not text,
            "text under 25": 0 < len(text) < 25, "text under 80": 0 < len(text) < 80, "text over 200": len(text) > 200, "sentences": bool(_SENTENCE.search(text)),
            "links over 0.3": share > 0.3, "links over 0.7": share > 0.7, "child count over 3": node.children > 3, "item with link only": tag == "item" and share > 0.7,
        }
        if node.attributes:
            holds |= {k: bool(p.search(node.attributes)) for k, p in _WORDS.items()}
        return [INDEX[k] for k, v in holds.items() if v]
