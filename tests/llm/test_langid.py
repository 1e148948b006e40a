from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionflow.llm import langid
from regionflow.llm.queries import op3_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out")
    hits = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("ok")).first()
    assert hits["n"] > 100 and hits["ok"] >= 0.97 * hits["n"]


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    best = [list(scores[0])]
    back = []
    for t in range(1, n):
        row, come = [], []
        for j in range(k):
            options = [best[-1][i] - (penalty if i != j else 0) for i in range(k)]
            i = int(np.argmax(options))
            row.append(options[i] + scores[t, j])
            come.append(i)
        best.append(row)
        back.append(come)
    total = max(best[-1])
    return total


def path_score(scores, path, penalty):
    return sum(scores[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=6), st.integers(0, 5), st.integers(0, 10_000))
def test_viterbi(sizes, penalty, seed):
    of = np.cumsum([0, *sizes])
    scores = np.random.default_rng(seed).normal(size=(of[-1], 3)) * 3
    label = langid.viterbi(scores, of, float(penalty))
    for a, b in zip(of[:-1], of[1:], strict=True):
        if b > a:
            assert np.isclose(path_score(scores[a:b], label[a:b].tolist(), penalty), brute_viterbi(scores[a:b], penalty))


ROWS = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and the dog ran with them", "en"), ("der Hund und die Katze sind nicht auf dem Dach", "de"), ("кошка сидит на столе и смотрит в окно", "ru")] * 40)]


def test_spans_of_mixed_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert model.langs == ["de", "en", "ru"]
    text = "the dog and the cat ran on the mat die Katze und der Hund sind nicht auf dem Dach кошка сидит на столе"
    mixed = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = langid.spans(mixed, model).orderBy("start").collect()
    assert [r["lang"] for r in rows] == ["en", "de", "ru"]
    raw = text.encode()
    assert raw[rows[2]["start"] : rows[2]["end"]].decode().startswith("кошка")
    assert raw[rows[1]["start"] : rows[1]["end"]].decode().endswith("Dach")


def test_script_narrows_the_languages(spark):
    model = langid.train(spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string"))
    data = np.frombuffer("ошибка".encode(), np.uint8)
    scores, *_ = model.word_scores(data, np.array([0, len(data)]))
    assert int(scores[0].argmax()) == model.langs.index("ru") and (scores[0, :2] < -30).all()


def test_hard_rows(hard, empty, clashing):
    model = langid.train(hard)
    rows = {r["doc_id"]: r for r in langid.predict(hard, model).collect()}
    assert len(rows) == hard.select("doc_id").distinct().count()
    for i in (3, 4, 5, 6):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert rows[8]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    odd = hard.sparkSession.createDataFrame([(1, "ℂ ª"), (2, "× ÷ — “”"), (3, "٣٤"), (4, "2")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] != "und" for r in langid.predict(odd, model).collect()} == {1: True, 2: False, 3: False, 4: False}
    nothing = langid.train(empty)
    assert nothing.langs == [] and {r["lang_pred"] for r in langid.predict(hard, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0 and langid.predict(clashing, model).count() == clashing.count()
    assert langid.spans(hard, nothing).count() == 0
