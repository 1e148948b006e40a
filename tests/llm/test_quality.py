from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from regionflow.llm import quality
from regionflow.llm.queries import op1_quality_classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    hits = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("quality")).alias("ok")).first()
    assert hits["n"] > 50 and hits["ok"] >= 0.95 * hits["n"]


def test_score_is_the_sum_of_tables():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # needs a pair
    model = quality.fit(x, y, pairs=3)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95
    z = model.intercept
    for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)):
        z += t[np.searchsorted(e, x[7, j], "right")]
    for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
        z += t[np.searchsorted(model.pair_edges[a], x[7, a], "right"), np.searchsorted(model.pair_edges[b], x[7, b], "right")]
    assert np.isclose(model.score(x[7:8])[0], 1 / (1 + np.exp(-z)))


def test_degenerate_training():
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).min() > 0.99
    one = quality.fit(np.ones((5, 3)), np.zeros(5))
    assert one.score(np.ones((1, 3)))[0] < 0.3


def test_labels_of_the_held_out_fifth_have_no_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_hard_rows(spark, hard, empty, clashing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None), (11, 0), (12, 1), (12, 0)], "doc_id bigint, quality int")
    model = quality.train(hard, labels)
    rows = quality.score(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    out = quality.score(clashing, model)
    assert out.columns[-1] == "quality_score_" and out.count() == clashing.count()
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0


def test_features_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["one two three.\nfour!!", "", "A| B| %%% %%%", "é" * 10]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    both = quality.text_features(np.frombuffer(b"".join(raw), np.uint8), at)
    for i, b in enumerate(raw):
        assert np.allclose(both[i], quality.text_features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0])


def test_copies_of_a_labelled_document_count_once(spark):
    """However often the documents repeat and in whatever order they come, the model is the same."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.train(docs, labels, rows=100)
    b = quality.train(docs.union(docs).union(docs).repartition(5, "n_chars"), labels, rows=100)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_boosted_tables_against_plain_boosting():
    """One feature and no pairs: the table is the sum of the steps of a plain loop over the same bins."""
    rng = np.random.default_rng(6)
    x = rng.random((400, 1))
    y = (x[:, 0] + rng.normal(0, 0.2, 400) > 0.5).astype(float)
    model = quality.fit(x, y, pairs=0)
    bins = np.searchsorted(model.edges[0], x[:, 0], "right")
    shown = model.tables[0][bins] + model.intercept
    rate = np.array([y[bins == b].mean() for b in np.unique(bins)])
    of = np.array([shown[bins == b][0] for b in np.unique(bins)])
    assert np.corrcoef(rate, 1 / (1 + np.exp(-of)))[0, 1] > 0.9
    assert np.isclose((1 / (1 + np.exp(-shown))).mean(), y.mean(), atol=0.05)
