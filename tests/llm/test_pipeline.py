from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from regionflow.llm import ngram_join, quality


def test_stages_on_the_driver_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    counts = [docs.count()]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.schema.simpleString() == before.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[5]
    quality_kept = spark.read.parquet(f"{tmp_path}/0")
    scored = quality.score(before, quality.train(before, spark.read.parquet(f"{sf}/labels.parquet")))
    assert {r[0] for r in quality_kept.select("doc_id").collect()} == {r[0] for r in scored.filter("quality_score >= 0.3").select("doc_id").collect()}
    near = spark.read.parquet(f"{tmp_path}/1")
    groups = ngram_join.join(quality_kept, ngram_join.Rule(5, (80, 100)))
    assert sorted(r[0] for r in near.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    again = ngram_join.join(near, ngram_join.Rule(5, (80, 100)))
    assert again.filter("doc_id != component_id").count() == 0
    clean = spark.read.parquet(f"{tmp_path}/2")
    assert clean.filter("n_chars != length(text)").count() == 0
    mixed = spark.read.parquet(f"{tmp_path}/3")
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_run(spark, sf):
    rows = cp.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 50


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_hard_and_empty_rows(spark, sf, hard, empty, k):
    stage = cp.STAGES[k][1]
    assert stage(spark, empty, sf).count() == 0
    out = stage(spark, hard, sf)
    out.collect()
    if k == 1:
        ids = [r["doc_id"] for r in out.collect()]
        assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
        assert 1 in ids and 2 not in ids and 3 in ids and 4 in ids


def test_unlinked_texts_of_one_id_stay(spark, sf):
    """Of each group one row stays, also where groups share their smallest id or have none."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (1, b), (2, b + " end"), (3, a), (None, c), (None, c + " end"), (None, a), (4, ""), (4, " "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {(r["doc_id"], r["text"]) for r in cp.ngram_jaccard_join(spark, docs, sf).collect()}
    assert {(1, a), (1, b), (4, ""), (4, " "), (None, None)} <= got
    assert len(got) == 6 and len(got & {(None, c), (None, c + " end")}) == 1
