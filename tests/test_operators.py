from __future__ import annotations

import hashlib
import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow.functions import canonical
from regionflow.operators import decoding, detect, export, matching, panel, recognise, stats, tokenizer, validate, vocab

BOX = "page_id bigint, idx bigint, x bigint, y bigint, w bigint, h bigint"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], BOX)


def test_vocabulary(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "text string")
    r = vocab.report(lines("ああああ", "き"), 2).first()
    assert (r["distinct_characters"], r["admitted"], r["dropped_rare"], r["characters_scanned"], r["empty_lines"]) == (2, 1, 1, 5, 0)
    r = vocab.report(lines("", "   ", "あ", None), 1).first()
    assert (r["empty_lines"], r["characters_scanned"]) == (3, 1)
    a, b = (vocab.build(lines(*x)).orderBy("id").collect() for x in (("だれ HELLO", "だれ 世界"), ("だれ 世界", "だれ HELLO")))
    assert a == b and [x["token"] for x in a[:5]] == list(vocab.SPECIALS) and [x["id"] for x in a] == list(range(len(a)))
    with pytest.raises(ValueError, match="no character"):
        vocab.require(vocab.build(lines("あ"), 99))


HAND = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "hello", "##world", "こん", "##にちは", "猫", "##が", "好", "##き"]


def test_tokenizer(spark):
    table = spark.createDataFrame(list(enumerate(HAND)), "id bigint, token string")
    ids = spark.createDataFrame([(1, [2, 5, 6, 7, 8, 3]), (2, [99, 9]), (3, []), (4, [6, 9, 10])], "doc_id bigint, ids array<bigint>")
    assert {r["doc_id"]: r["text"] for r in tokenizer.decode(ids, table).collect()} == {1: "helloworldこんにちは", 2: "猫", 3: "", 4: "world猫が"}
    words = {(r["doc_id"], r["word"]): r["text"] for r in tokenizer.words(ids, table).collect()}
    assert words == {(1, 1): "helloworld", (1, 2): "こんにちは", (2, 1): "猫", (4, 1): "world", (4, 2): "猫が"}
    with pytest.raises(Exception, match="no token has id 99"):
        tokenizer.decode(ids, table, strict=True).collect()


def report(spark, truth, found, least=0.5):
    return matching.recall_report(boxes(spark, truth), boxes(spark, found), least).first()


def test_matching(spark):
    r = report(spark, [(0, 0, 100, 20)], [(0, 0, 100, 20), (0, 0, 90, 20), (5, 0, 95, 20)])
    assert (r["matched"], r["recall"]) == (1, 1) and r["precision"] < 0.4
    r = report(spark, [(0, 0, 50, 50), (200, 200, 50, 50)], [(0, 0, 50, 50)])
    assert (r["recall"], r["precision"], r["mean_iou"]) == (0.5, 1, 1)
    r = matching.recall_report(boxes(spark, [(0, 0, 5, 5)]), boxes(spark, []), 0.5).first()
    assert (r["found_count"], r["precision"], r["mean_iou"]) == (0, 0, 0)


def test_the_grid_loses_and_repeats_nothing(spark):
    rng = np.random.default_rng(0)
    a, b = ([tuple(int(v) for v in (*rng.integers(0, 500, 2), *rng.integers(5, 90, 2))) for _ in range(60)] for _ in range(2))
    plain = sorted(map(tuple, matching.iou_pairs(boxes(spark, a), boxes(spark, b), 0.05).collect()))
    assert plain and plain == sorted(map(tuple, matching.iou_pairs(boxes(spark, a), boxes(spark, b), 0.05, cell=64).collect()))


def test_containers(spark):
    b = boxes(spark, [(0, 0, 100, 100), (10, 10, 5, 5), (10, 10, 5, 5)])
    assert sorted(r["idx"] for r in matching.without_containers(b).collect()) == [1, 2]
    inner = {r["idx"]: r["container"] for r in matching.innermost(boxes(spark, [(0, 0, 100, 100), (0, 0, 50, 50), (10, 10, 4, 4)])).collect()}
    assert inner == {0: None, 1: 0, 2: 1}


def test_panel(spark):
    c = spark.createDataFrame([(1, 0, "こんにちは", 0.95, 0.05), (1, 1, "こんばんは", 0.80, 0.20), (1, 2, None, None, 0.1), (2, 0, "x", 0.5, None)], "region_id bigint, engine bigint, answer string, confidence double, brier double")
    d = {r["region_id"]: r for r in panel.decide(c).collect()}
    assert d[1]["selected_text"] == "こんにちは" and d[1]["weighted_confidence"] > 0.85 and d[1]["needs_review"] and d[1]["is_validated"]
    assert d[2]["divergence"] is None and not d[2]["needs_review"] and d[2]["weighted_confidence"] == pytest.approx(0.5)


def test_validation(spark):
    p = spark.createDataFrame([(1, 745, 860, 265, 275)], "page_id bigint, x bigint, y bigint, w bigint, h bigint")
    assert validate.containment(boxes(spark, [(875, 580, 115, 110)]), p).first()["overflow"] == 280
    assert validate.containment(boxes(spark, [(745, 810, 10, 10)]), p).count() == 0
    pages = spark.createDataFrame([(1, 10, "rtl")], "page_id bigint, declared_total bigint, declared string")
    assert validate.cardinality(pages, boxes(spark, [(0, 0, 1, 1)] * 13)).first()["actual"] == 13
    again = validate.duplicate_ids(boxes(spark, [(0, 0, 1, 1), (5, 0, 1, 1), (0, 0, 1, 1)]), "page_id", "x", "idx").collect()
    assert [(r["idx"], r["occurrence"]) for r in again] == [(2, 2)]
    t = spark.createDataFrame([(1, 500, 500, 480, 500, 520, 500), (2, 5, 5, 5, 5, 5, 5), (3, 0, 0, 1, 0, 9, 0)], "id bigint, tx bigint, ty bigint, ax bigint, ay bigint, bx bigint, by bigint")
    s = {r["id"]: r for r in validate.speakers(t).collect()}
    assert s[1]["status"] == "human-review-required" and s[2]["speaker"] == "b" and s[2]["status"] == "resolved" and s[3]["speaker"] == "a"
    roles = spark.createDataFrame([(3, 2, 3, True), (3, 4, 3, False), (3, None, 3, False), (3, 2, 4, False)], "c int, n int, b int, want boolean")
    assert all(r[0] == r[1] for r in roles.select(validate.role_conflict(F.col("c"), F.col("n"), F.col("b")), "want").collect())


@pytest.mark.parametrize(("direction", "flipped", "bad"), [("ltr", False, 0), ("ltr", True, 1), ("rtl", False, 1), ("rtl", True, 0), ("diagonal", True, 0)])
@pytest.mark.parametrize("listed", [False, True])
def test_reading_order_check(spark, direction, flipped, bad, listed):
    left, right = (100, 2 if flipped else 1), (500, 1 if flipped else 2)
    rows = [(1, i, x, 10, 50, o) for i, (x, o) in enumerate([right, left] if listed else [left, right])]
    p = spark.createDataFrame(rows, "page_id bigint, idx bigint, x bigint, y bigint, h bigint, reading_order bigint")
    d = spark.createDataFrame([(1, direction)], "page_id bigint, declared string")
    assert validate.order_violations(p, d).count() == bad


def test_art_penalty(spark):
    texts = boxes(spark, [(0, 0, 10, 10)]).withColumn("panel", F.lit(1).cast("long"))
    art = spark.createDataFrame([(1, 1, "hard", None, 5, 5, 10, 10), (1, 2, "hard", None, 0, 0, 9, 9), (1, None, "soft", 0.5, None, None, None, None)], "page_id bigint, panel bigint, protection string, weight double, x bigint, y bigint, w bigint, h bigint")
    r = validate.art_penalty(texts, art).first()
    assert (r["penalty"], r["hard"]) == (25_000 + 50, True)


READING = "region_id bigint, text string, language string, state string, confidence double, l double, t double, r double, b double, intentional boolean"
GOLD = export.Request(reviewed_by="someone", min_crop_px=8)


def reading(i, text="テスト", state="accepted", confidence=0.85, bounds=(0.1, 0.1, 0.5, 0.5), language="ja", intentional=False):
    return (i, text, language, state, confidence, *bounds, intentional)


def counts(spark, rows, request):
    return export.report(export.reasons(spark.createDataFrame(rows, READING), request.check(), 100, 100)).first().asDict()


def test_export_gates(spark):
    r = counts(spark, [reading(1, state="candidate"), reading(2)], GOLD)
    assert (r["pairs_written"], r["skipped_candidate"], r["skipped_wrong_class"]) == (1, 1, 1)
    r = counts(spark, [reading(1, state="candidate")], export.Request(dataset_class="silver"))
    assert r["pairs_written"] == 1
    r = counts(spark, [reading(1, text=""), reading(2, bounds=(0.0, 0.0, 0.01, 0.01)), reading(3, text="", intentional=True), reading(4, confidence=None), reading(5, confidence=float("nan")), reading(6, state="rejected"), reading(7, bounds=(0.5, 0.5, 0.1, 0.9))], GOLD)
    assert (r["skipped_empty_label"], r["skipped_too_small"], r["pairs_written"], r["skipped_missing_confidence"], r["skipped_rejected"], r["skipped_no_geometry"]) == (1, 1, 1, 2, 1, 1)
    r = counts(spark, [reading(1), reading(2, state="verified")], export.Request(dataset_class="evaluation", split="test", reviewed_by="x"))
    assert (r["pairs_written"], r["skipped_wrong_class"]) == (1, 1)
    with pytest.raises(Exception, match="language fr"):
        counts(spark, [reading(1, language="fr")], GOLD)


@pytest.mark.parametrize("change", [{"min_confidence": 2.0}, {"min_crop_px": 0}, {"direction": "up"}, {"source": "web"}, {"item_id": " "}, {"split": "test"}, {"reviewed_by": None}, {"dataset_class": "evaluation"}])
def test_requests_are_refused(change):
    with pytest.raises(ValueError):
        export.Request(**{"reviewed_by": "x"} | change).check()


def test_manifests(spark):
    def made(request, rows, digests="region_id"):
        judged = export.reasons(spark.createDataFrame(rows, READING), request, 100, 100).withColumn("page_id", F.floor(F.col("region_id") / 10))
        return {r["page_id"]: r for r in export.manifests(judged, request, "page_id", F.col(digests).cast("string")).collect()}

    a = made(GOLD, [reading(1), reading(2), reading(11, state="rejected")])
    assert a == made(GOLD, [reading(11, state="rejected"), reading(2), reading(1)]) and (a[0]["pairs"], a[1]["pairs"]) == (2, 0)
    assert a != made(export.Request(reviewed_by="someone", page_digest="other"), [reading(1), reading(2)])
    manifest = json.loads(a[0]["manifest"])
    signed, manifest["manifest_digest"] = manifest["manifest_digest"], ""
    assert a[0]["manifest"] == json.dumps(manifest | {"manifest_digest": signed}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert signed == "sha256:" + hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() == a[0]["manifest_digest"]
    assert [r["crop"] for r in manifest["records"]] == ["crops/pair_0000_000001.png", "crops/pair_0000_000002.png"] and manifest["report"]["pairs_written"] == 2
    with pytest.raises(Exception, match="share a crop"):
        made(GOLD, [reading(1), reading(2)], "language")


def test_records_are_canonical(spark):
    def record(request, row):
        return export.records(export.reasons(spark.createDataFrame([row], READING), request, 100, 100), request).first()["record"]

    text = 'é"\\ \n\x01\x1f漢'
    out = record(GOLD, reading(1, text=text, confidence=1.0, bounds=(0.0, 1e-7, 1.0, 0.25)))
    assert json.loads(out)["text"] == text and '"confidence":1,' in out and '{"x":0,"y":1e-7}' in out and "\\u0001\\u001f" in out
    assert '"reviewed_by":"someone"' in out and "reviewed_by" not in record(export.Request(dataset_class="silver"), reading(1, state="candidate"))


def ecmascript(x: float) -> str:
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    n = len(whole) + int(power or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    d = (whole + part).strip("0")
    if len(d) <= n <= 21:
        out = d.ljust(n, "0")
    elif 0 < n <= 21:
        out = d[:n] + "." + d[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + d
    else:
        out = d[0] + ("." + d[1:] if d[1:] else "") + f"e{n - 1:+d}"
    return "0" if x == 0 else ("-" if x < 0 else "") + out


def test_canonical_numbers(spark):
    rng = random.Random(3)
    found = [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)]
    xs = [0.0, -0.0, 1.0, 1e21, 1e20, 1e-6, 1e-7, 2e23, 8.41e21, 5e-324, 1.7976931348623157e308, 333333333.33333329, -1.8379700992931924e18] + [k / 100 for k in range(101)]
    xs += [x for x in found if math.isfinite(x)] + [rng.random() for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", canonical.number(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == [ecmascript(r["x"]) for r in rows]
    assert spark.range(1).select(canonical.number(F.lit(None))).first()[0] == "null"
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(math.inf,)], "x double").select(canonical.number(F.col("x"))).collect()


def test_first_panel_and_texts(spark):
    regions = boxes(spark, [(0, 0, 10, 10), (90, 90, 4, 4)])
    panels = spark.createDataFrame([(1, 2, 0, 0, 50, 50), (1, 1, 0, 0, 20, 20)], "page_id bigint, panel bigint, x bigint, y bigint, w bigint, h bigint")
    assert sorted(r["panel"] or 0 for r in matching.first_panel(regions, panels).collect()) == [0, 1]
    layers = spark.createDataFrame([(7, "ja", [(1, "a"), (9, "b")])], "layer_id bigint, language string, regions array<struct<region_id: bigint, text: string>>")
    rows = matching.region_texts(spark.range(1, 3).withColumnRenamed("id", "region_id"), layers).orderBy("region_id").collect()
    assert [(r["region_id"], r["text"]) for r in rows] == [(1, "a"), (2, None)]


def test_beams(spark):
    beams = spark.createDataFrame([(1, 0, [2], -1.0, False), (1, 1, [2, 3], -0.5, True)], "vec_id bigint, beam bigint, tokens array<bigint>, logprob double, finished boolean")
    cands = spark.createDataFrame([(1, 0, 0, 7, -0.1), (1, 1, 0, 3, -3.0), (1, 2, 1, 9, 0.0), (1, 3, 5, 9, 0.0)], "vec_id bigint, pos bigint, beam bigint, token bigint, logprob double")
    out = decoding.select_beams(beams, cands, 2, 3).orderBy("beam").collect()
    assert [(r["tokens"], r["finished"]) for r in out] == [([2, 3], True), ([2, 7], False)]
    tied = spark.createDataFrame([(1, 0, [1, 1], -4.0, True), (1, 1, [1, 1], -4.0, True)], beams.schema)
    assert decoding.best_beam(tied).first()["beam"] == 1
    assert not decoding.stopped(beams, 3, 10) and decoding.stopped(beams, 10, 10) and decoding.stopped(tied, 0, 10)


def test_rolling(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.10, 0.12, 0.08, 0.09])], "k bigint, i bigint, v double")
    rows = decoding.rolling(df, "k", ["i"], "v").orderBy("i").collect()
    assert [r["truncate"] for r in rows] == [False, False, False, True] and rows[2]["mean"] is None


def test_a_gate_without_rows_fails(spark):
    df = spark.createDataFrame([], "status string, cer double")
    assert not stats.gate(df).first()["ok"]


def test_detector_kernels():
    page = np.full((60, 80), 240, np.uint8)
    page[10:20, 10:30] = 10
    page[40:50, 50:70] = 10
    assert detect.text_boxes(page, radius=1) == [(10, 10, 19, 9), (50, 40, 19, 9)]
    mask = np.zeros((4, 5), bool)
    mask[0, 0] = mask[1, 1] = mask[3, 4] = True
    labels = detect.label(mask)
    assert labels[0, 0] == labels[1, 1] != labels[3, 4] and labels.max() == 2
    assert detect.components({(0, 0), (1, 1), (3, 3)}) == [(0, 0, 1, 1), (3, 3, 3, 3)]
    ring = np.full((100, 100), 240, np.uint8)
    ring[10, 10:90] = ring[89, 10:90] = ring[10:90, 10] = ring[10:90, 89] = 0
    ring[40:45, 40:45] = 0
    assert detect.enclosures(ring, most_share=0.9) == [(10, 10, 80, 80)]


def test_recognisers(spark):
    class Reader:  # in here, as workers can't import test modules
        def predict(self, images):
            if images[0] == b"bad":
                raise ValueError("no page")
            return [(images[0].decode().upper(), 0.9, [0.9, 0.8])]

    crops = spark.createDataFrame([("a", b"one"), ("b", b"bad")], "key string, png binary")
    rows = {(r["key"], r["engine"]): r for r in recognise.panel(crops, [("x", Reader, 0.05), ("y", Reader, None)]).collect()}
    assert rows["a", 0]["answer"] == "ONE" and rows["b", 1]["confidence"] is None and "no page" in rows["b", 1]["error"]
    assert panel.decide(recognise.panel(crops, [("x", Reader, 0.05)]), key="key").count() == 1
    with pytest.raises(ValueError):
        recognise.panel(crops, [])


def test_recognisers_get_whole_batches():
    from regionflow.operators import recognise as rec

    class Engine:
        calls: list[int] = []

        def predict(self, images):
            self.calls.append(len(images))
            if b"bad" in images:
                raise RuntimeError("no text")
            return [(i.decode(), 0.5, [0.5]) for i in images]

    engine = Engine()
    assert [r[0] for r in rec.answers(engine, [b"a", b"b", b"c"])] == ["a", "b", "c"] and engine.calls == [3]
    mixed = rec.answers(engine, [b"a", b"bad", b"c"])
    assert [r[0] for r in mixed] == ["a", None, "c"] and mixed[1][3] == "RuntimeError: no text"


def test_boxes_of_components_against_a_loop():
    rng = np.random.default_rng(1)
    labels = detect.label(rng.random((40, 60)) < 0.2)
    left, right, top, bottom, n = detect.bounds(labels)
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        assert (left[k - 1], right[k - 1], top[k - 1], bottom[k - 1], n[k - 1]) == (x.min(), x.max(), y.min(), y.max(), len(x))
    box = np.array([[0, 0, 10, 10], [2, 2, 3, 3], [0, 0, 10, 10], [20, 20, 4, 4]])
    assert detect.holding_others(box).tolist() == [True, False, True, False]
    assert detect.text_boxes(np.full((20, 20), 255, np.uint8), drop_containers=True, most_share=0.1) == []


def test_medians_of_counted_values(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 5.0), ("b", 3.0), ("b", None)]
    out = {r["k"]: r for r in stats.deltas(spark.createDataFrame(rows, "k string, v double"), F.col("v"), "k").collect()}
    assert (out["a"]["n"], out["a"]["mean"], out["a"]["median"], out["a"]["least"], out["a"]["most"]) == (4, 2.25, 2.0, 1.0, 5.0)
    assert (out["b"]["n"], out["b"]["median"]) == (1, 3.0)


def test_labels_without_a_kind_are_excluded(spark):
    kept, report = stats.of_kind(spark.createDataFrame([("x", "dialogue"), ("y", "sfx"), ("z", None)], "text string, label_kind string"), "dialogue")
    assert [r["text"] for r in kept.collect()] == ["x"] and tuple(report.first()) == (1, 2)
