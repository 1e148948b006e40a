from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow.operators import detect, export, matching
from regionflow.sources import images, readers, schema, sinks, synth
from regionflow.streaming import ingest


def test_images(spark, tmp_path):
    page = np.arange(600, dtype=np.uint8).reshape(20, 30)
    (tmp_path / "a.png").write_bytes(images.encode(page))
    (tmp_path / "b.pgm").write_bytes(b"P5\n# note\n30 20\n255\n" + page.tobytes())
    (tmp_path / "c.png").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("x")
    found = readers.images(spark, [str(tmp_path)])
    assert [r["path"][-5:] for r in found.collect()] == ["a.png", "b.pgm", "c.png"]
    rows = readers.pages(found).orderBy("path").collect()
    assert bytes(rows[0]["pixels"]) == bytes(rows[1]["pixels"]) == page.tobytes() and rows[2]["error"]
    crop = spark.createDataFrame([("k", 30, 20, bytearray(page.tobytes()), 2, 3, 4, 5)], "key string, width bigint, height bigint, pixels binary, x bigint, y bigint, w bigint, h bigint")
    assert (images.decode(bytes(images.crops(crop).first()["png"])) == page[3:8, 2:6]).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import struct
    import zlib

    rng = np.random.default_rng(kind)
    page = rng.integers(0, 256, (9, 7)).astype(np.uint8)
    rows, above = b"", np.zeros(7, int)
    for line in page.astype(int):
        left, corner = np.r_[0, line[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, near][kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (images.decode(png) == page).all()


def test_page_kernels():
    page = synth.draw([(50, 60, 40, 30)])
    assert (images.degrade(page, noise=9, seed=3) == images.degrade(page, noise=9, seed=3)).all()
    assert (images.degrade(page) == page).all() and images.degrade(page, blur=2.0).std() < page.std()
    planes = images.normalise(page)
    assert planes.shape == (3, 224, 224) and -1 <= planes.min() and planes.max() <= 1
    assert images.normalise(np.full((10, 10), 255, np.uint8)).min() == 1


def test_labels(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"text": "ねこ"}\n\n  \n{"text": "", "empty_is_intentional": true}\n')
    (tmp_path / "in" / "b.json").write_text('{\n "text": "いぬ",\n "provenance": {"state": "accepted"}}')
    (tmp_path / "in" / "c.txt").write_text("no")
    rows = sorted((r["line"], r["text"], r["intentional"]) for r in readers.labels(spark, str(tmp_path / "in")).collect())
    assert rows == [(1, "いぬ", False), (1, "ねこ", False), (4, "", True)]
    for bad, what in (('{"text": "x", "provenance": {"state": "rejected"}}', "rejected"), ('{"text": 5}', "not a string"), ("{nope", "not a record")):
        (folder / "a.jsonl").write_text('{"text": "ok"}\n' + bad)
        with pytest.raises(Exception, match=f"a.jsonl:2: .*{what}"):
            readers.labels(spark, str(tmp_path / "in")).collect()


def test_vocabulary_file(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_bytes("[PAD]\r\n[UNK]\r\n[CLS]\r\n[SEP]\r\n[MASK]\r\n\r\na\r\na\r\nb\r\n".encode())
    assert {r["token"]: r["id"] for r in readers.vocabulary(spark, str(path)).collect()} == {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4, "a": 6, "b": 8}
    path.write_text("[PAD]\na\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.vocabulary(spark, str(path))


def test_ledger_and_settings(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"filename": "1.png", "status": "success", "cer_divergence": 0.01}, {"filename": "2.png"}]))
    rows = {r["filename"]: r for r in readers.ledger(spark, str(tmp_path / "l.json")).collect()}
    assert (rows["2.png"]["status"], rows["2.png"]["cer_divergence"], rows["2.png"]["label_kind"]) == ("fail", 1.0, "crop")
    (tmp_path / "s.csv").write_text('path,chars\nx.ttf,"a""b,c"\n')
    assert readers.settings(spark, str(tmp_path / "s.csv"), "path string, chars string").first()["chars"] == 'a"b,c'


def test_scenes(spark, tmp_path):
    dual = lambda x: {"px": {"x": x, "y": 0, "width": 10, "height": 10}}
    page = {"id": "p1", "pageNumber": 1, "panels": [{"id": "a", "logicalOrder": 1, "frame": {"bounds": dual(0)}}], "containers": [{"id": "c", "panelId": "a", "type": "speech-balloon"}], "text_regions": [{"id": "t", "panelId": "a", "translation": {"displayText": " "}, "geometry": {"bounds": dual(3)}}], "art_regions": []}
    (tmp_path / "s.json").write_text(json.dumps({"id": "d", "pages": [page]}))
    tables = readers.scene_tables(readers.scenes(spark, str(tmp_path / "s.json")))
    assert tables["pages"].first()["text_regions"] == 1 and tables["panels"].first()["w"] == 10 and tables["art"].count() == 0
    from regionflow.operators import validate

    issues = validate.page_issues(tables["panels"], tables["texts"])
    assert validate.page_status(tables["pages"], issues).first()["status"] == "warning"
    assert validate.masks(tables["containers"]).first()["mask_type"] == "clean-balloon"


RULES = {
    "required": ["text", "state"],
    "properties": {"text": {"minLength": 1}, "state": {"enum": ["a", "b"]}, "score": {"minimum": 0, "maximum": 1}, "digest": {"pattern": "^sha256:"}, "box": {"minItems": 2, "maxItems": 2, "items": {"minimum": 0}}, "p": {"required": ["k"], "properties": {"k": {"const": 3}}}},
    "if": {"properties": {"state": {"const": "b"}}, "required": ["state"]},
    "then": {"required": ["score"]},
}


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("x", "a", None, "sha256:0", [0.0, 1.0], (3,)), True), (("x", "a", None, None, None, None), True), (("", "a", None, None, None, None), False), ((None, "a", None, None, None, None), False),
        (("x", "c", None, None, None, None), False), (("x", "b", None, None, None, None), False), (("x", "b", 0.5, None, None, None), True), (("x", "a", 1.5, None, None, None), False),
        (("x", "a", None, "md5:0", None, None), False), (("x", "a", None, None, [0.0, -1.0], None), False), (("x", "a", None, None, [0.0], None), False), (("x", "a", None, None, None, (4,)), False), (("x", "a", None, None, None, (None,)), False),
    ],
)
def test_schema_rules(spark, row, want):
    df = spark.createDataFrame([row], "text string, state string, score double, digest string, box array<double>, p struct<k: int>")
    assert df.select(schema.conforms(RULES, F.col)).first()[0] is want


def test_synthetic_pages_are_found_again(spark):
    pages = synth.pages(spark.newSession(), 6, regions=5)
    assert pages.count() == 6
    truth = pages.select("page_id", F.posexplode("regions").alias("i", "r")).select("page_id", F.col("i").cast("long").alias("idx"), "r.x", "r.y", "r.w", "r.h")
    found = detect.detect_pages(pages).withColumnRenamed("place", "idx")
    r = matching.recall_report(truth, found, 0.5).agg(F.avg("recall"), F.avg("precision")).first()
    assert r[0] > 0.85 and r[1] > 0.85
    again = synth.pages(spark, 6, regions=5).repartition(3)
    assert sorted(bytes(r["pixels"]) for r in pages.collect()) == sorted(bytes(r["pixels"]) for r in again.collect())


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("ねこ ねこ",)], "text string")
    sinks.write_vocabulary(lines, str(tmp_path / "v"), 1)
    assert readers.vocabulary(spark, str(tmp_path / "v" / "vocab")).count() == 8
    with pytest.raises(ValueError):
        sinks.write_vocabulary(lines, str(tmp_path / "w"), 99)
    assert not (tmp_path / "w").exists()
    with pytest.raises(Exception, match="already exists"):
        sinks.write_vocabulary(lines, str(tmp_path / "v"), 1)
    pages = synth.pages(spark, 3)
    sinks.write_detection_set(pages, str(tmp_path / "d"), F.col("width") > 0)
    assert spark.read.json(str(tmp_path / "d" / "samples")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_detection_set(pages, str(tmp_path / "e"), F.col("width") < 0)
    assert not (tmp_path / "e").exists()


def test_export_sink(spark, tmp_path):
    rows = [(1, "テスト", "ja", "accepted", 0.9, 0.1, 0.1, 0.9, 0.9, False), (2, "x", "ja", "rejected", 0.9, 0.1, 0.1, 0.9, 0.9, False)]
    df = spark.createDataFrame(rows, "region_id bigint, text string, language string, state string, confidence double, l double, t double, r double, b double, intentional boolean")
    request = export.Request(reviewed_by="x")
    page = np.arange(100 * 120, dtype=np.uint32).reshape(100, 120).astype(np.uint8)
    out = tmp_path / "out"
    sinks.write_export(df, request, page, str(out))
    assert spark.read.json(str(out / "report")).first()["skipped_rejected"] == 1
    record = spark.read.json(str(out / "records")).collect()
    crop = spark.read.parquet(str(out / "crops")).collect()
    assert len(record) == len(crop) == 1 and json.loads(record[0]["record"])["crop"] == crop[0]["key"]
    assert (images.decode(bytes(crop[0]["png"])) == page[10:90, 12:108]).all()
    manifest = json.loads(spark.read.json(str(out / "manifest")).first()["manifest"])
    assert manifest["records"][0]["crop_digest"] == "sha256:" + hashlib.sha256(crop[0]["png"]).hexdigest()
    again = spark.createDataFrame([rows[0], (3, *rows[0][1:])], df.schema)
    with pytest.raises(Exception, match="share a crop"):
        sinks.write_export(again, request, page, str(tmp_path / "twice"))
    assert not (tmp_path / "twice" / "records").exists()


def test_resize_averages(spark):
    page = np.random.default_rng(1).integers(0, 256, (40, 60)).astype(np.uint8)
    assert (images.resize(page, 60, 40) == page).all()
    assert (images.resize(np.full((9, 7), 200, np.uint8), 3, 20) == 200).all()
    small = images.resize(page, 6, 4)

    def brute(line, size):
        scale = len(line) / size
        out = []
        for i in range(size):
            w = [max(0.0, 1 - abs(k + 0.5 - (i + 0.5) * scale) / max(scale, 1)) for k in range(len(line))]
            out.append(round(sum(a * b for a, b in zip(w, map(float, line), strict=True)) / sum(w)))
        return out

    across = [brute(row, 6) for row in page]
    want = np.array([brute([r[c] for r in across], 4) for c in range(6)]).T
    assert np.abs(small.astype(int) - want).max() <= 1


def test_model_files(spark, tmp_path):
    for name in readers.MODEL_FILES[:-1]:
        (tmp_path / name).write_bytes(b"x")
    with pytest.raises(ValueError, match="vocab.txt is missing"):
        readers.model_files(spark, str(tmp_path))
    (tmp_path / "vocab.txt").write_text("[PAD]")
    assert list(readers.model_files(spark, str(tmp_path))) == list(readers.MODEL_FILES)


def test_page_results(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 0.5), (2, 1, "c", None)], "page_id bigint, idx bigint, text string, confidence double")
    timed = sinks.page_results(df.withColumn("duration_ms", F.lit(1.5))).orderBy("page_id").collect()
    assert [r["duration_ms"] for r in timed] == [3.0, 1.5]
    rows = {r["page_id"]: r for r in sinks.page_results(df).collect()}
    assert rows[1]["text"] == "a\nb" and rows[1]["confidence"] == 0.5 and rows[2]["confidence"] is None


def test_streaming_ingest(spark, tmp_path):
    landing, target = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    row = {"page_id": 1, "language": "en", "confidence": 0.9, "l": 0.1, "t": 0.1, "r": 0.9, "b": 0.9, "intentional": False, "arrived": "2024-01-01T00:00:00Z"}
    write = lambda name, *rows: (landing / name).write_text("\n".join(json.dumps(row | r) for r in rows))
    request = export.Request(reviewed_by="x")

    def run():
        stream = ingest.judged(ingest.readings(spark, str(landing)), request, (100, 100))
        ingest.ingest(stream, target, str(tmp_path / "ck")).awaitTermination()
        return sorted((r["region_id"], r["reason"], r["text"]) for r in spark.read.parquet(target).collect())

    write("1.json", {"region_id": 1, "text": "im here", "state": "accepted"}, {"region_id": 2, "text": "x", "state": "rejected"})
    assert run() == [(1, "kept", "I'm here"), (2, "rejected", "x")]
    write("2.json", {"region_id": 3, "text": "y", "state": "candidate"})
    assert run() == [(1, "kept", "I'm here"), (2, "rejected", "x"), (3, "wrong_class", "y")]
