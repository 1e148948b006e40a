from __future__ import annotations

import re

import numpy as np
import pytest

from regionflow.llm import dom, extraction


def test_composed_pages_that_training_never_saw():
    model, hits = extraction.trained(), 0
    for source in extraction.composed(120, seed=99):
        page, y = extraction.labelled(source)
        want = " ".join(dom.blocks(page, [v == 1 for v in y]))
        hits += extraction.main_text(source.replace(" data-k=0>", ">"), model) == want
    assert hits >= 114


def test_driver_pages(spark):
    """On pages with an article element the result is that element's text, block by block."""
    import html

    model = extraction.trained()
    rows = extraction.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), model).collect()
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", sources[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r["text"] == " ".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""), ("plain text only", "plain text only"), ("<p>a&amp;b&nbsp; c</p>\n<p>d<br>e", "a&b c d e"), ("<p>x <b>y</b>z</p>", "x yz"),
        ("<article><p>Text of the article stands here.</p><!-- <p>no</p> --><script>if (a<b) '</p>'</script></article>", "Text of the article stands here."),
        ("<body><nav><a href=x>one</a> <a href=y>two</a></nav><article><p>Main words are here, all of them.</p></article><footer>&copy; z</footer>", "Main words are here, all of them."),
        ("<p>a < b and <3", "a < b and <3"), ("<div class='x>y'>z</div>", "z"), ("<unclosed attr=\"", ""),
    ],
)
def test_markup(source, want):
    assert extraction.main_text(source, extraction.trained()) == want


@pytest.mark.parametrize(
    "before",
    ["<html><head><title>t</title><meta charset=x><body>", "<html><head><title>t</title>", "<html><head><noscript><title>t</title><body>", "<html><head></head><body><select><option>x", "<body><noscript>", "<body><object>", "<body><template>",
     "<body><noscript><p>no</p></noscript><noscript>", "<body><select><option>x</select><button>", "<html><head><noscript><p>no</p></noscript><body>"],
)
def test_what_never_closes_takes_no_text(before):
    words = "Main words are here, all of them."
    got = extraction.main_text(f"{before}<article><p>{words}</p></article></body></html>", extraction.trained())
    assert words in got and "no" not in got.split()


def test_text_ends_an_open_head():
    assert extraction.main_text("<head><title>t</title>Words of the page stand here.", extraction.trained()) == "Words of the page stand here."


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        page = dom.Page()
        for i in range(1, n):
            page.tag.append("div")
            page.parent.append(int(rng.integers(0, i)))
        margin = rng.normal(size=n) * 2
        keep = extraction.decode(page, margin)
        score = lambda k: sum(-np.logaddexp(0, -m) if x else -np.logaddexp(0, m) for x, m in zip(k, margin, strict=True))  # noqa: B023, E731
        best = max(score(k) for k in _choices(page.parent, n))
        assert keep[0] and all(keep[page.parent[i]] or not keep[i] for i in range(1, n)) and np.isclose(score(keep), best)


def _choices(parent, n):
    for bits in range(1 << (n - 1)):
        k = [True, *(bool(bits >> i & 1) for i in range(n - 1))]
        if all(k[parent[i]] or not k[i] for i in range(1, n)):
            yield k


def test_tables(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "a", "b"), (None, None, "<p>x</p>", None, None), (2, "u", "", "", ""), (2, "u", "", "", ""), (3, "v", "<p>" * 3000 + "deep", None, None), (4, "w", "<b>" * 5000 + "&#x110000; &#0;", None, None)]
    out = extraction.extract(spark.createDataFrame(rows, schema), extraction.trained()).collect()
    assert len(out) == 6 and out[0]["text"] == "" and sum(r["text"] == "" for r in out) == 3
    assert extraction.extract(spark.createDataFrame([], schema), extraction.trained()).count() == 0


def other_shapes(seed):
    """Pages unlike the composed ones: tables for layout, classes without meaning, names in other languages, old markup."""
    import random

    r = random.Random(seed)
    words = "der wind trägt das boot über den stillen see while the keeper counts lamps le soir tombe sur la ville and nobody answers".split()
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    prose = [line(r.randint(8, 40)) for _ in range(r.randint(3, 9))]
    links = [line(2).rstrip(".") for _ in range(r.randint(4, 10))]
    note = line(6)
    nav = "".join(f"<a href=#>{x}</a> " for x in links)
    text = " ".join(prose)
    shapes = [
        f"<table><tr><td width=120>{'<br>'.join(f'<a href=#>{x}</a>' for x in links)}</td><td>{''.join(f'<p>{x}</p>' for x in prose)}</td></tr></table><center><small>{note}</small></center>",
        f"<div class=c1>{nav}</div><div class='x7 q'>{''.join(f'<div class=z3>{x}</div>' for x in prose)}</div><div class=c9>{nav}{note}</div>",
        f"<div id=navigation><ul>{''.join(f'<li><a href=#>{x}</a></li>' for x in links)}</ul></div><div id=inhalt>{''.join(f'<p>{x}</p>' for x in prose)}</div><div id=fusszeile><p>{note}</p></div>",
        f"<main><section>{''.join(f'<p>{x}</p>' for x in prose[:2])}</section><section>{''.join(f'<p>{x}</p>' for x in prose[2:])}</section></main><aside><p>{note}</p>{nav}</aside>",
        f"<body bgcolor=white>{nav}<hr><font size=3>{'<p>'.join(['', *prose])}</font><hr><font size=1>{nav}</font>",
    ]
    return [(x, text) for x in shapes]


def test_pages_of_other_shapes():
    from collections import Counter

    model, scores = extraction.trained(), []
    for seed in range(20):
        for shape, (source, want) in enumerate(other_shapes(seed)):
            a, b = Counter(extraction.main_text(source, model).split()), Counter(want.split())
            common = sum((a & b).values())
            scores.append((shape, 2 * common / max(1, sum(a.values()) + sum(b.values()))))
    by_shape = [sum(f for s, f in scores if s == k) / 20 for k in range(5)]
    print("F1 by shape", [round(x, 3) for x in by_shape])
    assert sum(by_shape) / 5 > 0.8


def test_string_ids_and_very_long_pages(spark):
    words = " ".join(f"word{i}" for i in range(60_000))
    rows = [("a-1", "u", f"<nav><a href=x>menu</a></nav><article><p>{words}</p></article>"), (None, "u", "<div>" * 40_000 + "deep"), ("a-1", None, "<p>" + "<i>x</i> " * 20_000)]
    out = {(r["page_id"], r["url"]): r for r in extraction.extract(spark.createDataFrame(rows, "page_id string, url string, html string"), extraction.trained()).collect()}
    assert len(out) == 3 and out["a-1", "u"]["text"] == words and out["a-1", "u"]["n_chars"] == len(words)
