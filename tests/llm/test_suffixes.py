from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regionflow.llm import suffixes as sx

W = sx.WINDOW


def brute(texts):
    """For each text the mask of bytes that a string of W bytes covers which starts elsewhere too."""
    counts = Counter(b[i : i + W] for b in texts for i in range(len(b) - W + 1))
    out = []
    for b in texts:
        mask = np.zeros(len(b) + 1, int)
        for i in range(len(b) - W + 1):
            if counts[b[i : i + W]] > 1:
                mask[i] += 1
                mask[i + W] -= 1
        out.append(np.cumsum(mask)[: len(b)] > 0)
    return out


def expected(rows):
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), b, gone in zip(rows, raw, brute(raw), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((str(doc_id), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sx.dedup(df).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(symbols):
    t = [*symbols, 0]
    assert sx.suffix_array(np.array(t, np.uint16)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_classes(symbols):
    t = [*symbols, 0]
    s, leftmost = sx.classify(np.array(t, np.uint16))
    assert s.tolist() == [i == len(t) - 1 or t[i:] < t[i + 1 :] for i in range(len(t))]
    assert leftmost.tolist() == [i for i in range(1, len(t)) if s[i] and not s[i - 1]]


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [text(rng.randint(150, 400)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 300)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 4))]
        rows.append((i, "".join(parts)))
    return [*rows, (60, "abc " * 200), (61, "z" * 199), (62, "z" * 200), (63, "y" * 201), (64, rows[0][1]), (None, rows[1][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_corpus(spark, seed):
    rows = corpus(seed)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == expected(rows)


def test_groups_too_large_for_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sx, "SHARD_BYTES", 600)
    rows = corpus(3)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(rows)


def test_rows_longer_than_a_sort_key(spark, monkeypatch):
    monkeypatch.setattr(sx, "_LONGEST", 1 << 12)
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    rows = [(1, body), (2, "x" + body[3000:9000] + "y"), (3, body[500:900])]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(rows)


def test_hard_rows(hard):
    rows = [(r["doc_id"], r["text"] if r["doc_id"] != 7 else "long") for r in hard.collect()]
    df = hard.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == expected(rows)
    whole = {r["doc_id"]: r for r in sx.dedup(hard).collect()}
    assert whole[7]["n_removed"] == 0 and whole[3]["n_bytes"] == 0


def test_cleaned_keeps_columns(hard, clashing):
    clean = {(r["doc_id"]): r for r in sx.cleaned(hard).collect()}
    assert clean[1]["emptied"] and clean[1]["text"] == ""
    assert clean[7]["text"] == next(r["text"] for r in hard.collect() if r["doc_id"] == 7)
    assert clean[3]["text"] is None and not clean[3]["emptied"]
    assert sx.dedup(clashing).count() == clashing.count()


def test_empty(empty):
    assert sx.dedup(empty).count() == 0
    assert sx.cleaned(empty).count() == 0
