"""A forgiving HTML tree: block elements as nodes, text runs and block breaks as events in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
NEVER_TEXT = {"script", "style", "textarea", "title", "head", "noscript", "template", "iframe", "noembed", "noframes", "svg", "math", "select", "button", "object", "canvas", "audio", "video"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: What may stand in a head; any other element ends it, as text does.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Elements without page text that hold only what lies before their end tag, and those of them that can't nest.
SHUT = {"noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video"}
FLAT = {"noscript", "select", "button"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_SHUT = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)({'|'.join(sorted(SHUT))})(?=[\s/>])", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BREAK = -1


@dataclass
class Page:
    """Node 0 is the root. events: (node, text), or (BREAK, "") where a block begins or ends."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    events: list[tuple[int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=lambda: [0])
    link_text: list[int] = field(default_factory=lambda: [0])
    inline: list[int] = field(default_factory=lambda: [0])
    controls: list[int] = field(default_factory=lambda: [0])


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    out = []
    for _, value in _ATTRIBUTE.findall(attributes):
        out += [w.lower() for w in _WORD.findall(html.unescape(value.strip("\"'")))]
    return tuple(out)


def shut(text: str) -> set[int]:
    """Where the start tags of SHUT elements stand that have an end tag of their own."""
    out, held = set(), {}
    for m in _SHUT.finditer(text):
        if not m[3]:
            continue
        name = m[3].lower()
        begun = held.setdefault(name, [])
        if m[2]:
            if begun:
                out.add(begun.pop())
        else:
            if name in FLAT:
                begun.clear()
            begun.append(m.start())
    return out


def parse(text: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their block nodes
    at, depth_a = 0, 0
    match, end_of_text = _TOKEN.search, len(text)
    ended: set[int] | None = None

    def add(piece: str) -> None:
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            if stack[-1][0] == "head" and piece.strip():
                close(len(stack) - 1)
            node = stack[-1][1]
            page.events.append((node, piece))
            if depth_a:
                page.link_text[node] += len(piece.strip())

    def close(until: int) -> None:
        nonlocal depth_a
        while len(stack) > until:
            name, _ = stack.pop()
            if name == "a":
                depth_a -= 1
            elif name not in INLINE:
                page.events.append((BREAK, ""))

    while at < end_of_text:
        m = match(text, at)
        if not m:
            add(text[at:])
            break
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in ("table", "td", "th") and name in INLINE | {"p", "li", "div"}:
                    break
            continue
        attributes = m[3] or m[6] or ""
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in SIBLINGS:
            same, scope = SIBLINGS[name]
            found = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in same:
                    found = i
            if found:
                close(found)
        node = stack[-1][1]
        if name in VOID:
            if name in ("br", "hr"):
                page.events.append((BREAK, ""))
            elif name == "input":
                page.controls[node] += 1
            continue
        if name in INLINE:
            page.inline[node] += 1
            if name == "a":
                page.links[node] += 1
                depth_a += 1
            stack.append((name, node))
            continue
        page.events.append((BREAK, ""))
        page.tag.append(name)
        page.parent.append(node)
        page.tokens.append(attribute_tokens(attributes) if "=" in attributes else ())
        for counts in (page.links, page.link_text, page.inline, page.controls):
            counts.append(0)
        own = len(page.tag) - 1
        if name in ("button", "select", "textarea", "label"):
            page.controls[node] += 1
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
            at = stop.end() if stop else end_of_text
            page.events.append((BREAK, ""))
        elif not attributes.rstrip().endswith("/") or name not in ("svg", "path"):
            if name in SHUT:
                ended = shut(text) if ended is None else ended
                if m.start() not in ended:
                    continue
            stack.append((name, own))
    close(1)
    return page


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """Texts of kept nodes, block by block in page order, with single spaces."""
    out, run = [], []
    for node, piece in page.events:
        if node == BREAK:
            if run:
                block = " ".join("".join(run).split())
                if block:
                    out.append(block)
                run = []
        elif kept[node]:
            run.append(piece)
    if run:
        block = " ".join("".join(run).split())
        if block:
            out.append(block)
    return out
