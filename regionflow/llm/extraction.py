"""Main text of HTML pages: boosted trees over DOM nodes, decoded so that no kept node stands in a dropped one.

The trees learn from pages that this module composes itself, with the part of every block known.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regionflow.llm import dom
from regionflow.llm.common import map_batches

TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "tr", "h1", "h2", "h3", "h4", "blockquote", "pre", "figure", "figcaption", "dl", "fieldset", "body", "html", "#root")
GUIDES = ("article", "main", "nav", "header", "footer", "aside", "form")

#: Pages that the model learns from, and the seed that composes them.
TRAIN_PAGES, SEED = 500, 20240229


# --- features --------------------------------------------------------------------------------------------


def features(page: dom.Page, weight: dict[str, float]) -> np.ndarray:
    """A row for each node: density of its subtree, attribute tokens, depth, siblings, ancestors."""
    n = len(page.tag)
    own_text, stops = np.zeros(n), np.zeros(n)
    first = np.full(n, -1.0)
    seen = 0
    for node, piece in page.events:
        if node >= 0:
            size = len(piece) - piece.count(" ")
            if size:
                own_text[node] += size
                stops[node] += piece.count(".") + piece.count(",")
                if first[node] < 0:
                    first[node] = seen
                seen += size
    parent = page.parent
    text, links, link_text = own_text.copy(), np.array(page.links, float), np.array(page.link_text, float)
    inline, controls, nodes = np.array(page.inline, float), np.array(page.controls, float), np.ones(n)
    paragraphs = np.array([t == "p" for t in page.tag], float)
    items = np.array([t == "li" for t in page.tag], float)
    children, below = np.zeros(n), np.zeros(n)
    sums = (text, links, link_text, inline, controls, nodes, paragraphs, items, stops)
    for i in range(n - 1, 0, -1):  # children follow their parents
        p = parent[i]
        children[p] += 1
        for x in sums:
            x[p] += x[i]
        below[p] = max(below[p], below[i] + 1)
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    depth, index = np.zeros(n), np.zeros(n)
    token, token_up, token_low = np.zeros(n), np.zeros(n), np.zeros(n)
    guide = np.zeros((n, len(GUIDES)))
    count: dict[int, int] = {}
    for i in range(n):
        p = parent[i]
        own = [weight.get(t, 0.0) for t in page.tokens[i]]
        token[i] = max(own, key=abs) if own else 0.0
        if p >= 0:
            depth[i] = depth[p] + 1
            index[i] = count.get(p, 0)
            count[p] = count.get(p, 0) + 1
            guide[i] = guide[p]
            token_up[i] = max(token_up[p], token[i])
            token_low[i] = min(token_low[p], token[i])
        else:
            token_up[i] = max(token[i], 0)
            token_low[i] = min(token[i], 0)
        if page.tag[i] in GUIDES:
            guide[i, GUIDES.index(page.tag[i])] = 1
    up = np.maximum(parent, 0)
    kind = np.zeros((n, len(TAGS)))
    for i, t in enumerate(page.tag):
        if t in TAGS:
            kind[i, TAGS.index(t)] = 1
    whole = max(text[0], 1)
    most = max(text[1:].max() if n > 1 else 1, 1)
    return np.column_stack(
        [
            np.log1p(text), text / whole, text / np.maximum(text[up], 1), own_text / np.maximum(text, 1), text / nodes, link_text / np.maximum(text, 1),
            links / nodes, np.log1p(links), np.log1p(inline), controls, np.log1p(nodes), paragraphs, items / nodes, stops / np.maximum(text, 1), text / np.maximum(paragraphs, 1),
            depth, below, index, children[up], index / np.maximum(children[up], 1), np.maximum(first, 0) / whole, (np.maximum(first, 0) + text) / whole, text / most,
            token, token_up, token_low, *guide.T, *kind.T,
        ]
    )


# --- trees -----------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of one depth, as arrays: at each inner place a feature and a threshold, at each leaf a value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - (len(v) - 1)]
        return z


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Logistic gradient boosting on histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    places = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    width = bins
    shift = places + np.arange(x.shape[1]) * width
    start = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    z = np.full(len(x), start)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = weight * (y - q), weight * q * (1 - q)
        f, t = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            base = (1 << level) - 1
            for node in range(base, 2 * base + 1):
                own = np.flatnonzero(at == node)
                if len(own) < 8:
                    continue
                flat = shift[own].ravel()
                size = x.shape[1] * width
                gs = np.bincount(flat, np.repeat(g[own], x.shape[1]), size).reshape(-1, width).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[own], x.shape[1]), size).reshape(-1, width).cumsum(1)
                gt, ht = g[own].sum(), h[own].sum()
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    f[node], t[node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
        leaf = at - ((1 << depth) - 1)
        v = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
        z += v[leaf]
        out_f.append(f)
        out_t.append(t)
        out_v.append(v)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_v), start)


@dataclass
class Model:
    weight: dict[str, float]
    trees: Trees


def decode(page: dom.Page, margin: np.ndarray) -> list[bool]:
    """The likeliest labels under which a dropped node has no kept descendant; the root is kept."""
    n = len(page.tag)
    log_keep, log_drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    keep, drop = log_keep.tolist(), log_drop.tolist()
    for i in range(n - 1, 0, -1):
        if page.tag[i] in dom.NEVER_TEXT:
            keep[i] = -1e9
        p = page.parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    out = [True] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] and keep[i] >= drop[i]
    return out


def main_text(text: str, model: Model) -> str:
    page = dom.parse(text)
    return " ".join(dom.blocks(page, decode(page, model.trees.margin(features(page, model.weight)))))


# --- composed pages --------------------------------------------------------------------------------------

_SYLLABLES = "an be ca de el fi go ha in ka lo me no or pa qui re su ta un ver wo zi ch er en és ón au".split()

#: Names that sites give to the parts of their pages; a composed page draws some of them, or none.
PARTS = {
    "menu": ("nav", "menu", "navbar", "main-nav", "topbar", "breadcrumb", "breadcrumbs", "nav-links", "site-menu", "pagination", "toc"),
    "header": ("header", "masthead", "site-header", "top", "banner", "logo", "page-header", "branding"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "legal", "colophon", "footer-links"),
    "side": ("sidebar", "aside", "side", "widget", "related", "recommended", "popular", "rail", "more-stories", "tags", "recent-posts"),
    "notice": ("notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "ad-slot", "adsense"),
    "form": ("form", "search", "login", "signup", "contact-form", "search-box", "feedback"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses", "reader-comments", "user-comment"),
    "share": ("share", "social", "share-buttons", "follow", "social-links", "toolbar"),
}
_MAIN_NAMES = ("content", "article", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "body-text", "page-content", "text")
_WRAPPERS = ("wrapper", "container", "page", "site", "layout", "row", "outer", "col", "grid")


class _Composer:
    """One random page; every block node's label in document order."""

    def __init__(self, rng: random.Random) -> None:
        self.r, self.out = rng, []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 14) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.3:
            words.insert(len(words) // 2, words.pop() + ",")
        mark = self.r.choice([".", ".", ".", "!", "?", ""])
        return " ".join(words).capitalize() + mark

    def prose(self, low: int = 1, high: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def name(self, names: tuple[str, ...]) -> str:
        x = self.r.random()
        if x < 0.25:
            return ""
        value = self.r.choice(names) + (f" {self.r.choice(('x1', 'clearfix', 'block', 'inner', 'mod'))}" if self.r.random() < 0.2 else "")
        return f' {"class" if x < 0.8 else "id"}="{value}"'

    def links(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        one = lambda: f'<a href="/{self.word()}">{self.sentence(1, 3)}</a>'
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", "")).join(one() for _ in range(n))

    def clutter(self, kind: str) -> str:
        r = self.r
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        tag = tag if r.random() < 0.55 else r.choice(("div", "div", "section", "ul") if kind != "form" else ("div",))
        attributes = self.name(PARTS[kind])
        if tag in ("div", "section", "ul") and not attributes:
            attributes = f' class="{r.choice(PARTS[kind])}"'
        if kind == "menu":
            body = self.links(3, 12)
        elif kind == "header":
            body = r.choice((f"<h1>{self.sentence(1, 3)}</h1>", f'<a href="/">{self.word()}</a>', f"<p>{self.sentence(2, 6)}</p>")) + (self.links(2, 6) if r.random() < 0.4 else "")
        elif kind == "footer":
            body = r.choice(("&copy; ", "", "Copyright ")) + f"{self.word()}.com &middot; {self.prose(1, 2)}" + (self.links(2, 8) if r.random() < 0.5 else "")
        elif kind == "side":
            body = f"<h3>{self.sentence(1, 3)}</h3>" * (r.random() < 0.7) + r.choice((self.links(3, 9), f"<p>{self.prose(1, 3)}</p>", "".join(f"<p>{self.prose(1, 2)}</p>" for _ in range(3))))
        elif kind == "notice":
            body = r.choice((f"<p>{self.prose(1, 2)}</p>", self.prose(1, 3))) + r.choice(("<button>OK</button>", f'<a href="#">{self.word()}</a>', ""))
        elif kind == "advert":
            body = r.choice((self.prose(1, 3), f'<a href="http://{self.word()}.com">{self.sentence()}</a>', f"<p>{self.prose(1, 2)}</p>", f"<div>{self.sentence()}</div>"))
        elif kind == "form":
            body = f'<label>{self.word()}</label><input type="text"><button>{self.word()}</button>' + (f"<p>{self.sentence()}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            one = lambda: f'<{(t := r.choice(("div", "li", "article")))}{self.name(("comment", "reply", "comment-body"))}>{r.choice((f"<b>{self.word()}</b> ", f"<p>{self.word()}</p>", ""))}<p>{self.prose(1, 4)}</p></{t}>'
            body = f"<h3>{r.choice(('Comments', self.sentence(1, 2)))}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6)))
        else:
            body = self.links(2, 5)
        return f"<{tag}{attributes} data-k=0>{body}</{tag}>"

    def hidden(self) -> str:
        """What a page holds beside its text: metadata, styles, and scripts with markup in their strings."""
        r, tag = self.r, self.r.choice(("p", "div", "a", "li"))
        return r.choice((
            f'<meta name="{self.word()}" content="{self.sentence()}">', f'<link rel="{self.word()}" href="/{self.word()}.css">', f"<!-- {self.sentence()} -->",
            f"<style>.{self.word()} {{ color: #{r.randint(100, 999)} }}</style>", f"<script>function {self.word()}(x) {{ return x < {r.randint(0, 9)}; }}</script>",
            f'<script>document.write("<{tag}>{self.word()}</{tag}>");</script>', f'<script type="application/ld+json">{{"{self.word()}": "{self.sentence()}"}}</script>', f"<noscript>{self.sentence()}</noscript>",
        ))

    def article(self) -> str:
        r, out = self.r, []
        heading = self.sentence(2, 9)
        out.append(f"<h1>{heading}</h1>" if r.random() < 0.8 else "")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 25))):
            x = r.random()
            if x < 0.62:
                inner = self.prose(1, r.choice((1, 3, 12)))
                if r.random() < 0.3:
                    inner = f"<b>{self.word()}</b> {inner}"
                if r.random() < 0.3:
                    inner += f' <a href="/{self.word()}">{self.sentence(1, 3)}</a> {self.sentence()}'
                open_ = r.choice(("b", "i", "em", "strong", "span", "font"))
                out.append(r.choice((f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<p><{open_}>{inner}{r.choice(('', '<br>', '</p>'))}", f"<div>{inner}</div>")))
            elif x < 0.72:
                out.append(f"<h2>{self.sentence(1, 6)}</h2>")
            elif x < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                out.append(self.clutter(r.choice(("advert", "share", "side", "notice"))))
        if r.random() < 0.2:
            out.append(self.clutter(r.choice(("share", "comments", "side"))))
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        attributes = self.name(_MAIN_NAMES)
        return f"<{tag}{attributes}>" + "".join(out) + f"</{tag}>"

    def nameless(self) -> str:
        """A page of blocks whose classes say nothing: links around text."""
        r = self.r
        own = lambda: f'class="{self.word()}{r.randint(0, 99)}"'
        menu = lambda: f'<div {own()} data-k=0>{self.links(4, 12)}</div>'
        inner = own()
        text = "".join(f"<{t}>{self.prose(1, 4)}</{t.split()[0]}>" for t in [r.choice((f"div {inner}", "p"))] * r.randint(2, 9))
        parts = [menu() for _ in range(r.randint(1, 2))] + [f"<div {own()}>{text}</div>"] + [menu() for _ in range(r.randint(0, 2))]
        return f"<html><head><title>{self.sentence(1, 4)}</title></head><body>{''.join(parts)}</body></html>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.12:  # names without meaning: menus and text in plain blocks
            return self.nameless()
        if r.random() < 0.1:  # a fragment: text alone, without a page around it
            return r.choice((f'<div class="{self.word()}">{self.word()}</div>', f"<p>{self.prose(1, 2)}</p>", f"<div>{self.sentence()}</div>", self.sentence(), f"<p>{self.sentence()}</p>\n<p>{self.sentence()}<br>{self.word()}", self.article()))
        before = [k for k, p in (("notice", 0.3), ("header", 0.6), ("menu", 0.75), ("form", 0.25), ("advert", 0.5)) if r.random() < p]
        after = [k for k, p in (("comments", 0.35), ("share", 0.3), ("side", 0.45), ("advert", 0.25), ("form", 0.2), ("footer", 0.8), ("notice", 0.2)) if r.random() < p]
        if r.random() < 0.5:
            r.shuffle(before)
        body = "".join(self.clutter(k) for k in before) + self.article()
        side = [k for k in after if k in ("side", "comments", "advert", "share")]
        if r.random() < 0.3:
            body = f'<div class="{r.choice(_WRAPPERS)}">{body}{"".join(self.clutter(k) for k in side)}</div>'
            after = [k for k in after if k not in side]
        body += "".join(self.clutter(k) for k in after)
        if r.random() < 0.3:
            body = f'<div{self.name(_WRAPPERS)}>{body}</div>'
        head = f"<head><title>{self.sentence(1, 6)}</title>{''.join(self.hidden() for _ in range(r.randint(0, 3)))}</head>"
        if r.random() < 0.3:
            body += self.hidden()
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def composed(pages: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Pages whose clutter carries the attribute data-k=0."""
    rng = random.Random(seed)
    return [_Composer(rng).page() for _ in range(pages)]


def labelled(text: str) -> tuple[dom.Page, np.ndarray]:
    """A composed page without its marks, and for each node whether it holds main text (1), none (0), or nothing (-1)."""
    marked = dom.parse(text.replace(" data-k=0>", ' role="kzero">'))
    page = dom.parse(text.replace(" data-k=0>", ">"))
    n = len(page.tag)
    clutter = [False] * n
    has, main = [False] * n, [False] * n
    for i in range(1, n):
        clutter[i] = clutter[page.parent[i]] or "kzero" in marked.tokens[i] or page.tag[i] in dom.NEVER_TEXT
    for node, piece in page.events:
        if node >= 0 and piece.strip():
            has[node] = True
            main[node] |= not clutter[node]
    for i in range(n - 1, 0, -1):
        has[page.parent[i]] |= has[i]
        main[page.parent[i]] |= main[i]
    return page, np.array([1 if m else 0 if h else -1 for h, m in zip(has, main, strict=True)])


@cache
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    """Fit to composed pages: first a weight for each attribute token, then the trees."""
    rows = [labelled(t) for t in composed(pages, seed)]
    counts: dict[str, list[float]] = {}
    for page, y in rows:
        for tokens, label in zip(page.tokens, y.tolist(), strict=True):
            if label >= 0:
                for t in set(tokens):
                    counts.setdefault(t, [1.0, 1.0])[label] += 1
    weight = {t: float(np.log(b / a)) for t, (a, b) in counts.items()}
    x = np.vstack([features(page, weight) for page, _ in rows])
    y = np.concatenate([y for _, y in rows])
    use = y >= 0
    return Model(weight, boost(x[use], y[use].astype(float), np.ones(use.sum())))


def extract(df: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars). A null or empty page has an empty text; markup that never closes is read to its end."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = [dom.parse(t or "") for t in batch.column(2).to_pylist()]
        x = [features(p, model.weight) for p in pages]
        margin = model.trees.margin(np.vstack(x)) if x else np.zeros(0)
        cuts = np.cumsum([len(p.tag) for p in pages])
        texts = [" ".join(dom.blocks(p, decode(p, m))) for p, m in zip(pages, np.split(margin, cuts[:-1]), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, url_col, html_col), run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
