from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow.llm import perplexity as px


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup, before = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


class BruteModel:
    """Modified Kneser-Ney by its definition, over symbols."""

    def __init__(self, texts):
        grams = Counter()
        for t in texts:
            s = [px.START] * (px.ORDER - 1) + [int(px._SYMBOL[b]) for b in t.encode()]
            for i in range(px.ORDER - 1, len(s)):
                grams[tuple(s[i - px.ORDER + 1 : i + 1])] += 1
        self.counts = {px.ORDER: grams}
        for n in range(px.ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d = {}
        for n, c in self.counts.items():
            k = [max(sum(v == i for v in c.values()), 1e-9) for i in (1, 2, 3, 4)]
            y = k[0] / (k[0] + 2 * k[1])
            raw = [1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2]]
            self.d[n] = [min(max(v, 0.05), m) for v, m in zip(raw, (0.95, 1.9, 2.9), strict=True)]

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / px.SYMBOLS
        c, d = self.counts[n], self.d[n]
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not own:
            return self.p(gram[1:])
        total = sum(own.values())
        gamma = sum(d[min(v, 3) - 1] for v in own.values()) / total
        have = c.get(gram, 0)
        return max(have - (d[min(have, 3) - 1] if have else 0), 0) / total + gamma * self.p(gram[1:])


def test_model_equals_the_definition(spark):
    texts = ["the cat sat on the mat.", "a cat ran; the dog sat!", "no 42 cats ### here", "the theme of the cat"]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    model, brute = px.train(px.count(df))["en"], BruteModel(texts)
    for probe in ["the cat", "zebra (1)", "", "CAT sat\n###"]:
        g = px.grams(np.frombuffer(probe.encode(), np.uint8), np.array([0, len(probe.encode())]))
        got = model.log_probability(g.astype(np.int64))
        s = [px.START] * 3 + [int(px._SYMBOL[b]) for b in probe.encode()]
        want = [math.log(brute.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))]
        assert got == pytest.approx(want, abs=1e-4)
    total = sum(math.exp(model.log_probability(np.array([(g // px.SYMBOLS) * px.SYMBOLS + s]))[0]) for g in [int(px.grams(np.frombuffer(b"the ", np.uint8), np.array([0, 4]))[-1])] for s in range(px.SYMBOLS))
    assert total == pytest.approx(1, abs=1e-3)


def test_arrays_are_sorted(spark):
    df = spark.createDataFrame([("some text here, and more of it", "en")], "text string, lang string")
    m = px.train(px.count(df))["en"]
    assert all((np.diff(k.astype(np.int64)) > 0).all() for k in (*m.keys, *m.context_keys))


def test_base_rules(hard):
    rows = px.judge(hard).collect()
    want = sorted((str(r["doc_id"]), *brute_base(r["text"])) for r in hard.collect())
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_driver_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in px.judge(docs).collect()}
    for r in docs.collect():
        g = rows[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == brute_base(r["text"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [rows[i] for i, q in labels.items() if q == 1 and not rows[i]["base_failed"]]
    junk = [rows[i] for i, q in labels.items() if q == 0]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.35 * len(junk)


def test_copies_do_not_narrow_the_band(spark):
    """One text is more than three quarters of a language's rows: it covers the median and both quartiles of the rows."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(80)]
    rows = [(i, t, "en") for i, t in enumerate(texts + [texts[0]] * 300)]
    judged = px.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert all(r["low"] < r["high"] for r in judged)
    assert sum(r["kept"] for r in judged if 0 < r["doc_id"] < 80) >= 75


def test_scrambled_capitals_are_rejected(spark):
    """Texts in capitals, in Latin and in Cyrillic letters, beside some whose every letter is a random capital."""
    rng = np.random.default_rng(6)
    for letters in ("ETAOINSHRDLUCMFWYPVBGK", "ОЕАИНТСРВЛКМДПУЯЫЬГЗБЧ"):
        words = ["".join(rng.choice(list(letters[:9]), rng.integers(2, 8))) for _ in range(300)]
        texts = [" ".join(rng.choice(words, 70)) for _ in range(300)]
        junk = ["".join(c if c == " " else rng.choice(list(letters)) for c in t) for t in texts[:10]]
        df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts + junk)], "doc_id bigint, text string, lang string")
        kept = {r["doc_id"]: r["kept"] for r in px.judge(df).collect()}
        assert sum(kept[i] for i in range(300)) >= 290 and not any(kept[i] for i in range(300, 310)), letters


def test_pruning_drops_the_lowest_counts(spark):
    rows = [("a", g, n) for g, n in enumerate([1, 1, 1, 2, 2, 3, 9])] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "lang string, gram bigint, n bigint")
    got = {k: sorted((r["lang"], r["n"]) for r in px.pruned(df, k).collect()) for k in (7, 6, 2)}
    assert len(got[7]) == 8 and got[6] == [("a", 2), ("a", 2), ("a", 3), ("a", 9), ("b", 1)] and got[2] == [("a", 3), ("a", 9), ("b", 1)]


def test_symbols_are_code_points():
    texts = ["aé", "", "я😀한", "z"]
    raw = [t.encode() for t in texts]
    s, at = px.symbols(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert s.tolist() == [ord(c) % px.START for t in texts for c in t] and at.tolist() == [0, 2, 2, 5, 6]


def test_empty_and_clashing(empty, clashing):
    assert px.judge(empty).count() == 0
    assert px.judge(clashing).count() == clashing.count()


def test_large_languages_keep_all_grams(spark):
    """More 4-grams of one count than the model was once cut to."""
    counts = spark.range(px.LARGEST + 100_000).select(F.lit("xx").alias("lang"), (F.col("id") * 1_000_003).alias("gram"), F.lit(1).cast("bigint").alias("n"))
    assert len(px.train(counts)["xx"].keys[-1]) == px.LARGEST + 100_000


class CodePoints(str):
    def encode(self):
        return [ord(c) for c in self]


@pytest.mark.parametrize("largest", [0, 150, px.TABLE])
def test_perplexity_equals_the_definition_whatever_is_broadcast(spark, monkeypatch, largest):
    """Also where most 4-grams go through the join, in rows with equal ids, and no count is pruned."""
    monkeypatch.setattr(px.pruned, "__defaults__", (20,))
    texts = {"en": ["the cat sat on the mat.", "a cat ran; the dog sat!", "no 42 cats ### here", "the theme of the cat", "zq"], None: ["один два", "два кота", "x"]}
    rows = [(1, t, lang) for lang, of in texts.items() for t in of] + [(1, "", "en"), (None, None, None), (1, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    want = []
    for lang in texts:
        of = [t for _, t, own in rows if own == lang and t]
        brute = BruteModel([CodePoints(t) for t in of])
        for s in ([px.START] * 3 + CodePoints(t).encode() for t in of):
            want.append(math.exp(-sum(math.log(brute.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3)))
    got = [r["perplexity"] for r in px.judge(df, largest=largest).collect()]
    assert got.count(None) == 2 and sorted(p for p in got if p is not None) == pytest.approx(sorted(want), rel=1e-5)
