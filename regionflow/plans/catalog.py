"""Registered queries: name to a function of (spark, sf_dir). The SQL that must agree stands in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionflow.functions import geometry as g
from regionflow.functions import numeric as m
from regionflow.functions import text as t
from regionflow.operators import decoding, detect, export, layout, matching, panel, stats, tokenizer, validate, vocab
from regionflow.plans.views import PAGE, boxes, candidates, detections, logits, panels, readings, table
from regionflow.sources import schema, synth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}



def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- vocabularies and tokens -----------------------------------------------------------------------------


@query
def vocab_build(spark, sf):
    return vocab.build(table(spark, sf, "documents"), 20)


@query
def vocab_report(spark, sf):
    return vocab.report(table(spark, sf, "documents").unionByName(table(spark, sf, "conversations").select("text"), allowMissingColumns=True), 20)


@query
def char_frequency(spark, sf):
    return vocab.character_counts(table(spark, sf, "conversations"))


def _pieces(spark, sf) -> DataFrame:
    """A small word-piece vocabulary: syllables of the corpus, half of them continuations."""
    rows = [*enumerate(vocab.SPECIALS), *((5 + i, ("##" if i % 2 else "") + s) for i, s in enumerate(("the", "and", "er", "on", "tion", "an", "re", "ed", "ha", "ing")))]
    return spark.createDataFrame(rows, "id bigint, token string")


def _ids(spark, sf) -> DataFrame:
    """Token ids of each document, some special and some out of the vocabulary."""
    at = F.sequence(F.lit(1), (F.col("doc_id") % 12 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.transform(at, lambda i: (F.col("doc_id") * 7 + i * 5) % 18).alias("ids"))


@query
def wordpiece_decode(spark, sf):
    return tokenizer.decode(_ids(spark, sf), _pieces(spark, sf))


@query
def wordpiece_words(spark, sf):
    return tokenizer.words(_ids(spark, sf), _pieces(spark, sf))


@query
def special_tokens(spark, sf):
    return _pieces(spark, sf).select("id", "token", tokenizer.is_special(F.col("token")).alias("is_special"))


@query
def tensor_layers(spark, sf):
    i = F.col("n_nationkey")
    names = F.concat(F.when(i % 2 == 0, "past_key_values.").otherwise("present."), (i % 7).cast("string"), F.lit(".decoder.key"))
    return tokenizer.tensor_layers(table(spark, sf, "nation").select(names.alias("name")))


# --- text ------------------------------------------------------------------------------------------------


@query
def normalize_en(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.normalize_en(F.concat(F.lit("  im sure, dont  "), F.col("text"), F.lit(" “its” … ok !"))).alias("out"))


@query
def normalize_ja(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.normalize_ja(F.col("text")).alias("out"))


@query
def normalize_by_language(spark, sf):
    return readings(spark, sf).select("region_id", "language", t.normalize_by_language(F.col("text"), F.col("language")).alias("out"))


@query
def furigana_brackets(spark, sf):
    i = F.col("doc_id")
    made = F.concat(F.lit("漢字(かん"), i.cast("string"), F.lit(")は"), F.when(i % 3 == 0, "字【じ】 x").when(i % 3 == 1, "生…読（").otherwise("ab"), F.when(i % 5 == 0, "]!").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", t.furigana(made).alias("out"))


@query
def kanji_flags(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.expr("char(65 + n_nationkey)").alias("latin"))
    return rows.select(*_long("n_nationkey"), t.is_kanji(F.when(F.col("n_nationkey") % 2 == 0, F.lit("漢")).otherwise(F.col("latin"))).alias("kanji"))


@query
def direction_parse(spark, sf):
    p = panels(spark, sf)
    mode = F.when(F.col("page_id") % 2 == 0, "vertical-rl").otherwise("horizontal-tb")
    return p.select("page_id", t.reading_direction(F.col("declared")).alias("direction"), t.text_direction(mode).alias("writing"))


@query
def path_sanitise(spark, sf):
    made = F.concat(F.lit("see file:///data/x/flow/"), F.col("url"), F.lit(" file:///data/y/z.txt in /Users/user"), F.col("page_id").cast("string"), F.lit("/Projects/flow/a /Users/me/Projects/b /Users/x-y/c"))
    return table(spark, sf, "pages").select("page_id", t.clean_path(made, "flow").alias("out"))


@query
def id_formats(spark, sf):
    i = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", t.object_name(i).alias("co"), t.pair_name(i % 50, i).alias("pair"), t.mask_name(i).alias("mask"))


@query
def visible_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.visible_length(F.col("text")).cast("long").alias("n"), F.array_join(t.uncovered(F.col("text"), F.lit("abcdefghijklmnopqrstuvwxyz.,")), "").alias("uncovered"))


# --- error rates and gates -------------------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    return candidates(spark, sf).withColumn("cer", t.cer(F.col("expected"), F.col("answer")))


@query
def cer_per_item(spark, sf):
    return _scored(spark, sf).select("region_id", "engine", F.round("cer", 6).alias("cer"), t.verdict(F.col("expected"), F.col("answer")).alias("verdict"))


@query
def cer_summary(spark, sf):
    return _scored(spark, sf).groupBy("engine").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("answer") == F.col("expected")).alias("exact"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.max("cer"), 6).alias("worst"))


@query
def gate_status(spark, sf):
    judged = _scored(spark, sf).withColumn("status", F.when(F.col("region_id") % 10 == 3, "fail").otherwise("success"))
    return stats.gate(judged).withColumn("mean_cer", F.round("mean_cer", 6))


@query
def known_failures(spark, sf):
    known = table(spark, sf, "benchmark").filter("item_id % 7 = 0").select(F.col("item_id").alias("region_id"), F.lit(True).alias("known"))
    joined = _scored(spark, sf).join(known, "region_id", "left")
    kind = F.when(F.col("cer") <= stats.PASS_CER, "PASS").when(F.col("known"), "KNOWN FAIL").otherwise("UNEXPECTED FAIL")
    return joined.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def divergence_review(spark, sf):
    c = candidates(spark, sf)
    a, b = c.filter("engine = 0").select("region_id", F.col("answer").alias("a")), c.filter("engine = 2").select("region_id", F.col("answer").alias("b"))
    d = t.divergence(F.col("a"), F.col("b"))
    return a.join(b, "region_id").select("region_id", F.round(d, 6).alias("divergence"), F.coalesce(d >= 0.02, F.lit(False)).alias("needs_review"))


@query
def panel_decision(spark, sf):
    d = panel.decide(candidates(spark, sf))
    return d.select("region_id", "selected_text", "confidence", F.round("weighted_confidence", 6).alias("weighted_confidence"), "is_validated", F.round("divergence", 6).alias("divergence"), "needs_review")


@query
def brier_weights(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(m.brier_weight((F.col("value") - 20) / 50), 6).alias("weight"))


@query
def confidence_geomean(spark, sf):
    return readings(spark, sf).groupBy("page_id").agg(F.round(m.mean_confidence(F.col("confidence")), 6).alias("confidence"), F.count("confidence").alias("n"))


@query
def page_rollup(spark, sf):
    i, n = F.col("conv_id"), F.col("turn")
    tiles = table(spark, sf, "conversations").select(F.floor(i / 8).alias("page_id"), i.alias("region"), n.alias("tile"), "text", ((i * 13 + n) % 100 / 100.0).alias("confidence"), ((i * 7 + n) % 50 / 10.0).cast("double").alias("duration_ms"))
    return stats.rollup_pages(tiles).withColumns({"confidence": F.round("confidence", 6), "duration_ms": F.round("duration_ms", 2)})


# --- geometry --------------------------------------------------------------------------------------------


@query
def box_metrics(spark, sf):
    b = g.box()
    n = g.normalized(b, F.lit(PAGE[0]), F.lit(PAGE[1]))
    return boxes(spark, sf).select("page_id", "idx", g.area(b).alias("area"), F.round(g.aspect(b.w, b.h), 6).alias("aspect"), *(F.round(v, 6).alias(f"n{c}") for v, c in zip(n, "xywh", strict=True)))


@query
def dual_rect(spark, sf):
    p = panels(spark, sf)
    n = g.normalized(g.box(), F.col("page_id") % 3 * 500, F.col("page_id") % 2 * 700)
    return p.select("page_id", *(F.round(v, 6).alias(f"n{c}") for v, c in zip(n, "xywh", strict=True)))


def _polygon(x, y, w, h):
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(point(x, y), point(x + w, y + h / 4), point(x + w / 2, y + h), point(x, y + h / 2))


@query
def polygon_area(spark, sf):
    shape = _polygon(*(F.col(c).cast("double") for c in "xywh"))
    return boxes(spark, sf).select("page_id", "idx", F.round(g.polygon_area(shape), 4).alias("area"))


@query
def point_in_polygon(spark, sf):
    shape = _polygon(*(F.col(c).cast("double") for c in "xywh"))
    return boxes(spark, sf).select("page_id", "idx", g.in_polygon(shape, F.col("x") + F.col("p") % 200 + 0.5, F.col("y") + F.col("s") % 160 + 0.5).alias("inside"))


@query
def enclosure_bounds(spark, sf):
    kind = F.when(F.col("idx") % 3 == 0, "balloon").when(F.col("idx") % 3 == 1, "caption-box").otherwise("none")
    e = g.enclosure_bounds(g.box(), kind)
    return boxes(spark, sf).select("page_id", "idx", *(v.cast("long").alias(f"e{c}") for v, c in zip(e, "xywh", strict=True)))


@query
def crop_box(spark, sf):
    c = g.crop(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(PAGE[0]), F.lit(PAGE[1]))
    return readings(spark, sf).select("region_id", *(c[k].alias(f"c{k}") for k in "xywh"))


@query
def rect_corners(spark, sf):
    return boxes(spark, sf).select("page_id", "idx", F.posexplode(g.corners(g.box())).alias("k", "p")).select("page_id", "idx", *_long("k"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query
def reading_order_bands(spark, sf):
    order = Window.partitionBy("page_id").orderBy("band", F.col("x").desc(), "idx")
    return boxes(spark, sf).withColumn("band", layout.band(F.col("y"))).select("page_id", "idx", "band", F.row_number().over(order).cast("long").alias("place"))


@query
def reading_order_rows(spark, sf):
    known = panels(spark, sf).select("page_id", t.reading_direction(F.col("declared")).alias("direction"))
    return layout.rows(boxes(spark, sf).join(known, "page_id"))


@query
def tile_windows(spark, sf):
    strips = boxes(spark, sf).select("page_id", "idx", F.when(F.col("idx") % 2 == 0, F.col("w") * 5).otherwise(F.col("w")).alias("w"), F.when(F.col("idx") % 3 == 0, F.col("h") * 6).otherwise(F.col("h")).alias("h"))
    return layout.tiles(strips)


# --- joins and matching ----------------------------------------------------------------------------------


@query
def iou_pairs(spark, sf):
    return matching.iou_pairs(boxes(spark, sf), detections(spark, sf), 0.3).withColumn("iou", F.round("iou", 6))


@query
def iou_pairs_grid(spark, sf):
    return matching.iou_pairs(boxes(spark, sf), detections(spark, sf), 0.3, cell=256).withColumn("iou", F.round("iou", 6))


@query
def drop_containers(spark, sf):
    b = boxes(spark, sf).select("page_id", "idx", "x", "y", F.when(F.col("idx") % 4 == 0, F.col("w") * 6).otherwise(F.col("w")).alias("w"), F.when(F.col("idx") % 4 == 0, F.col("h") * 6).otherwise(F.col("h")).alias("h"))
    return matching.without_containers(b)


@query
def box_occupancy(spark, sf):
    big = detections(spark, sf).withColumns({"w": F.col("w") * 3, "h": F.col("h") * 3})
    return matching.occupancy(big, boxes(spark, sf))


@query
def occupancy_summary(spark, sf):
    return box_occupancy(spark, sf).agg(F.count_if(F.col("held") > 1).alias("crowded"), F.sum(F.when(F.col("held") > 1, F.col("held"))).alias("crowded_sum"), F.max("held").alias("worst"), F.count_if(F.col("held") == 0).alias("empty"))


@query
def innermost_container(spark, sf):
    b = boxes(spark, sf).select("page_id", "idx", "x", "y", (F.col("w") * 4).alias("w"), (F.col("h") * 4).alias("h"))
    return matching.innermost(b)


def _reason() -> F.Column:
    a = g.area(g.box())
    return F.when(a < 2500, "small").when(a > 20000, "large").when(F.col("w") > 4 * F.col("h"), "thin").otherwise("kept")


@query
def filter_cost(spark, sf):
    return matching.filter_cost(detections(spark, sf), boxes(spark, sf), _reason())


@query
def loss_by_stage(spark, sf):
    found = detections(spark, sf).withColumn("reason", _reason())
    report = matching.recall_report(boxes(spark, sf), found.filter("reason = 'kept'").drop("reason"), 0.5)
    return report.agg(F.sum("truth_count").alias("truth"), F.sum("found_count").alias("filtered"), F.sum("matched").alias("matched")).select("truth", "filtered", "matched", (F.col("truth") - F.col("matched")).alias("lost"))


@query
def greedy_match(spark, sf):
    return matching.greedy(matching.iou_pairs(boxes(spark, sf), detections(spark, sf), 0.3)).withColumn("iou", F.round("iou", 6))


@query
def detection_recall(spark, sf):
    r = matching.recall_report(boxes(spark, sf), detections(spark, sf), 0.5)
    return r.select("page_id", "truth_count", "found_count", "matched", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mean_iou")))


@query
def recall_by_density(spark, sf):
    """Mean over pages of equal density of the pages' recall, precision and IoU."""
    r = matching.recall_report(boxes(spark, sf), detections(spark, sf), 0.5)
    return r.groupBy("truth_count").agg(F.count(F.lit(1)).alias("pages"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "mean_iou")))


@query
def false_positive_classes(spark, sf):
    """Detections without a match: split in two, oversized, or isolated."""
    truth, found = boxes(spark, sf), detections(spark, sf)
    matched = matching.greedy(matching.iou_pairs(truth, found, 0.8)).select("page_id", F.col("found").alias("idx"))
    loose = found.join(matched, ["page_id", "idx"], "left_anti")
    paired = matching.split_matches(loose, truth).select("page_id", "idx").withColumn("paired", F.lit(True))
    kind = F.when(F.col("paired"), "paired").when(g.area(g.box()) > 15000, "oversized").otherwise("isolated")
    return loose.join(paired, ["page_id", "idx"], "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max(g.area(g.box())).alias("largest"))


@query
def region_panel_assign(spark, sf):
    """The first panel that contains a region's centre; four overlapping columns on each page."""
    pages_ = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("panel"))
    columns = pages_.select("page_id", "panel", (F.col("panel") * 300).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(350).cast("long").alias("w"), F.lit(2 * PAGE[1]).cast("long").alias("h"))
    return matching.first_panel(boxes(spark, sf), columns)


# --- validation ------------------------------------------------------------------------------------------


@query
def spatial_containment(spark, sf):
    return validate.containment(boxes(spark, sf), panels(spark, sf)).withColumn("overflow", F.round("overflow", 1))


@query
def panel_order_violations(spark, sf):
    return validate.order_violations(boxes(spark, sf).withColumn("reading_order", F.col("p") % 10), panels(spark, sf))


@query
def order_status(spark, sf):
    bad = panel_order_violations(spark, sf).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    joined = panels(spark, sf).select("page_id", "declared").join(bad, "page_id", "left")
    return joined.select("page_id", "declared", F.col("declared").alias("inferred"), F.when(F.col("n") > 0, "contradiction").otherwise("consistent").alias("status"), F.coalesce("n", F.lit(0)).alias("violations"))


@query
def cardinality_check(spark, sf):
    return validate.cardinality(panels(spark, sf), boxes(spark, sf))


@query
def duplicate_ids(spark, sf):
    b = boxes(spark, sf).withColumn("panel_id", F.concat(F.lit("p"), F.col("p") % 5))
    return validate.duplicate_ids(b, "page_id", "panel_id", "idx")


@query
def semantic_roles(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    chapter, badge, following = F.when(o % 5 != 0, o % 7), F.when(c % 6 != 0, c % 7), F.when(o % 3 != 0, o % 9)
    return table(spark, sf, "orders").select(o.alias("page_id"), validate.role_conflict(chapter, following, badge).alias("conflict"))


@query
def art_penalty(spark, sf):
    texts = boxes(spark, sf).withColumn("panel", F.when(F.col("idx") % 5 != 0, F.col("idx") % 2))
    p = F.col("page_id")
    bounds = [F.when(p % 7 != 0, F.col(c)).alias(c) for c in "xywh"]
    art = panels(spark, sf).select("page_id", F.when(p % 3 != 0, p % 2).alias("panel"), F.when(p % 4 == 0, "hard").when(p % 4 == 3, "none").otherwise("soft").alias("protection"), F.when(p % 5 != 0, p % 5 / 2).alias("weight"), *bounds)
    return validate.art_penalty(texts, art).withColumn("penalty", F.round("penalty", 3))


@query
def cleanup_masks(spark, sf):
    c = boxes(spark, sf).select(F.concat("page_id", F.lit("-"), "idx").alias("id"), F.col("page_id").alias("panel_id"), F.when(F.col("idx") % 2 == 0, "speech-balloon").otherwise("caption").alias("type"))
    return validate.masks(c)


def _issues(spark, sf) -> DataFrame:
    b = boxes(spark, sf)
    flat = b.select("page_id", "idx", F.when(F.col("p") % 40 == 0, 0).otherwise(F.col("w")).alias("w"), "h")
    shown = b.select("page_id", "idx", F.when(F.col("s") % 9 == 0, "  ").when(F.col("s") % 9 == 1, None).otherwise("x").alias("display"))
    return validate.page_issues(flat, shown)


@query
def scene_issues(spark, sf):
    return _issues(spark, sf)


@query
def scene_status(spark, sf):
    return validate.page_status(panels(spark, sf), _issues(spark, sf))


@query
def scene_counts(spark, sf):
    """Pages, regions and masks of the scene, and its worst status."""
    b, status = boxes(spark, sf), scene_status(spark, sf)
    rank = F.max(F.when(F.col("status") == "invalid", 2).when(F.col("status") == "warning", 1).otherwise(0))
    worst = status.agg(F.count(F.lit(1)).alias("pages"), rank.alias("r"))
    return b.agg(F.count(F.lit(1)).alias("regions"), F.count_if(F.col("idx") % 2 == 0).alias("balloon_masks")).crossJoin(worst).select("pages", "regions", "balloon_masks", F.when(F.col("r") == 2, "invalid").when(F.col("r") == 1, "warning").otherwise("valid").alias("status"))  # one row each


@query
def speaker_attribution(spark, sf):
    b = boxes(spark, sf)
    tails = b.select((F.col("page_id") * 100 + F.col("idx")).alias("id"), F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("x") + F.col("p") % 40).alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("s") % 30).alias("bx"), (F.col("y") - F.col("s") % 4).alias("by"))
    return validate.speakers(tails).select("id", "speaker", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "status")


@query
def ambiguity_margin(spark, sf):
    """The first engine's reading against the others' in order; a fifth of the regions have no alternative."""
    c = candidates(spark, sf).groupBy("region_id").agg(F.max(F.when(F.col("engine") == 0, F.col("confidence"))).alias("primary"), F.array_sort(F.collect_list(F.when(F.col("engine") > 0, F.struct("engine", "confidence")))).alias("others"))
    others = F.when(F.col("region_id") % 5 == 0, F.array().cast("array<double>")).otherwise(F.col("others.confidence"))
    margin, status = validate.ambiguity(F.col("primary"), others)
    return c.select("region_id", F.round(margin, 6).alias("margin"), status.alias("status"))


# --- export ----------------------------------------------------------------------------------------------

_GOLD = export.Request(reviewed_by="reviewer", min_confidence=0.2, min_crop_px=60).check()
_SILVER = export.Request(dataset_class="silver", min_confidence=0.2, min_crop_px=60).check()


def _judged(spark, sf, request=_GOLD) -> DataFrame:
    return export.reasons(readings(spark, sf), request, *PAGE)


@query
def export_reasons(spark, sf):
    return _judged(spark, sf).select("region_id", "reason")


@query
def export_report(spark, sf):
    return export.report(_judged(spark, sf))


@query
def export_report_silver(spark, sf):
    return export.report(_judged(spark, sf, _SILVER))


@query
def export_pairs(spark, sf):
    kept = _judged(spark, sf).filter("reason = 'kept'")
    return kept.select("region_id", "state", F.col("crop.x").alias("cx"), F.col("crop.y").alias("cy"), F.col("crop.w").alias("cw"), F.col("crop.h").alias("ch"), t.digest(F.col("text")).alias("text_digest"))


@query
def export_record_digest(spark, sf):
    return export.records(_judged(spark, sf), _GOLD).select("region_id", "record_digest")


@query
def export_records(spark, sf):
    return export.records(_judged(spark, sf), _GOLD).select("region_id", "record")


@query
def manifest_digest(spark, sf):
    """A manifest for each page of 50 regions. The tables have no pixels, so a crop's digest is that of its page and box."""
    judged = _judged(spark, sf).withColumn("page_id", F.floor(F.col("region_id") / 50)).withColumn("page_digest", F.concat(F.lit("page-"), "page_id"))
    box = t.digest(F.concat_ws("|", "page_id", "crop.x", "crop.y", "crop.w", "crop.h"))
    return export.manifests(judged, _GOLD, "page_id", box).select("page_id", "pairs", "manifest_digest")


@query
def cap_split(spark, sf):
    """What a cap on generated length keeps and discards."""
    n = t.visible_length(F.col("text"))
    return table(spark, sf, "conversations").agg(F.sum(F.least(n, F.lit(120))).alias("kept"), F.sum(F.greatest(n - 120, F.lit(0))).alias("discarded"))


# --- decoding --------------------------------------------------------------------------------------------


@query
def softmax_topk(spark, sf):
    top = decoding.top_logprobs(logits(spark, sf), 5, banned=F.array(F.lit(0), F.lit(1), F.col("vec_id") % 64).cast("array<bigint>"))
    return top.withColumn("logprob", F.round("logprob", 6))


@query
def token_entropy(spark, sf):
    p = m.softmax(F.transform("logits", lambda x: x * 20))
    return logits(spark, sf).select("vec_id", F.round(m.entropy(p), 6).alias("bits"), F.round(F.array_max(p), 6).alias("top"))


@query
def loop_truncation(spark, sf):
    return decoding.rolling(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", below=8.0).select("event_id", F.round("mean", 6).alias("mean"), "truncate")


@query
def ngram_ban(spark, sf):
    tokens = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 25).cast("int")), lambda i: ((F.col("doc_id") + i * i) % 4).cast("long"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(m.banned_next(tokens).cast("array<string>"), ",").alias("banned"))


def _beams(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = logits(spark, sf)
    i = F.col("vec_id")
    one = lambda k: F.struct(F.lit(k).cast("long").alias("beam"), F.array(F.lit(2).cast("long"), (i + k) % 50).alias("tokens"), F.round(F.get("logits", F.lit(k)) * 10 - k, 4).alias("logprob"), ((i + k) % 4 == 0).alias("finished"))
    beams = v.select("vec_id", F.explode(F.array(*(one(k) for k in range(4)))).alias("b")).select("vec_id", "b.*")
    cand = lambda k: F.struct(F.lit(k).cast("long").alias("pos"), F.lit(k % 5).cast("long").alias("beam"), (i * 3 + k) % 6, F.round(F.get("logits", F.lit(8 + k)) * 5, 4).alias("logprob"))
    found = v.select("vec_id", F.explode(F.array(*(cand(k) for k in range(10)))).alias("c")).select("vec_id", "c.pos", "c.beam", F.col("c.col3").alias("token"), "c.logprob")
    return beams, found


@query
def beam_select(spark, sf):
    out = decoding.select_beams(*_beams(spark, sf), 4, 3)
    return out.select("vec_id", "beam", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"), F.round("logprob", 4).alias("logprob"), "finished")


@query
def beam_best(spark, sf):
    return decoding.best_beam(_beams(spark, sf)[0]).withColumn("score", F.round("score", 6))


@query
def sequence_confidence(spark, sf):
    b, _ = _beams(spark, sf)
    return b.select("vec_id", "beam", F.round(m.sequence_confidence(F.col("logprob"), F.size("tokens")), 6).alias("confidence"))


# --- statistics ------------------------------------------------------------------------------------------


@query
def delta_stats(spark, sf):
    """Differences of two engines' confidences, paired by the text that both should read, by the text's length."""
    c = candidates(spark, sf)
    both = stats.paired(c.filter("engine = 0"), c.filter("engine = 1"), "expected", "confidence").withColumn("k", F.length("expected") % 3)
    d = stats.deltas(both, F.round(F.col("real") - F.col("made"), 6), "k")
    return d.select(*_long("k"), "n", *(F.round(x, 6).alias(x) for x in ("mean", "median", "least", "most")))


@query
def length_buckets(spark, sf):
    words = F.size(F.split(F.col("text"), " "))
    s = table(spark, sf, "conversations").select(words.alias("label_len"), (words + F.col("turn") % 3 * (F.col("conv_id") % 2)).alias("out_len")).withColumn("exact", F.col("label_len") == F.col("out_len"))
    b = stats.length_buckets(s)
    return b.select("low", "high", "n", F.round("mean_out", 6).alias("mean_out"), F.round("mean_over", 6).alias("mean_over"), "exact")


@query
def sweep_best(spark, sf):
    s = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).alias("density"), F.col("l_linenumber").cast("long").alias("radius"), (F.col("l_partkey") % 11).alias("score"))
    return stats.best_setting(s.withColumn("ord", F.col("radius")), "density", "radius", "ord", "score").withColumn("mean", F.round("mean", 6))


@query
def sweep_pivot(spark, sf):
    s = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).alias("density"), F.concat(F.lit("r"), F.col("l_linenumber")).alias("radius"), (F.col("l_partkey") % 11).alias("score"))
    return s.groupBy("density").pivot("radius", [f"r{k}" for k in range(1, 8)]).agg(F.round(F.avg("score"), 6))


@query
def arm_errors(spark, sf):
    """Mean error rate by arm, with a row for each item that the arm gets wrong."""
    s = _scored(spark, sf)
    means = s.groupBy("engine").agg(F.round(F.avg("cer"), 6).alias("mean_cer"))
    return means.join(s.filter("cer > 0.02").select("engine", "region_id"), "engine", "left")


@query
def distinct_readings(spark, sf):
    return candidates(spark, sf).groupBy("region_id").agg(F.countDistinct("answer").alias("readings"))


@query
def overrun_counts(spark, sf):
    v = t.verdict(F.col("answer"), F.col("expected"))
    return candidates(spark, sf).agg(F.count_if(v == "exact").alias("exact"), F.count_if(v == "OVERRUN").alias("overrun"), F.count_if(v == "misread").alias("misread"))


@query
def chunked_labels(spark, sf):
    """Labels, and concatenations of two to four neighbouring labels."""
    base = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("label"))
    out = base.select(F.lit(1).cast("long").alias("width"), F.col("item_id").alias("chunk"), "label")
    for w in (2, 3, 4):
        g_ = base.groupBy(F.floor(F.col("item_id") / w).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("item_id", "label")))["label"], "").alias("label"))
        out = out.unionByName(g_.select(F.lit(w).cast("long").alias("width"), "chunk", "label"))
    return out


@query
def panel_shape_stats(spark, sf):
    a = g.area(g.box())
    size = F.format_string("%04dx%04d", "w", "h")
    return boxes(spark, sf).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(size).alias("shapes"), F.min(a).alias("least"), F.max(a).alias("most"), F.array_join(F.array_sort(F.collect_list(size)), ",").alias("sizes"))


@query
def large_thin_boxes(spark, sf):
    ink = F.col("p") % 100
    large = 500 * g.area(g.box()) >= PAGE[0] * PAGE[1]
    per = boxes(spark, sf).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(large).alias("large"), F.count_if(large & (ink < 10)).alias("large_thin"), F.max(g.area(g.box())).alias("largest"))
    return per.agg(F.count_if(F.col("large_thin") > 0).alias("pages_affected"), F.sum("large_thin").alias("total"), F.max("largest").alias("largest"), F.sum("n").alias("boxes"))


@query
def enclosure_counts(spark, sf):
    kind = F.when(F.col("p") % 3 == 0, "Balloon").when(F.col("p") % 3 == 1, "CaptionBox").otherwise("None")
    return boxes(spark, sf).groupBy(g.enclosure_name(kind).alias("enclosure")).agg(F.count(F.lit(1)).alias("n"))


@query
def hypothesis_union(spark, sf):
    """Containers, loose boxes and outlines as one set of masks; containers that hold another one are left out."""
    b = boxes(spark, sf).select("page_id", "idx", "x", "y", "w", "h")
    big = b.filter("idx % 2 = 0").withColumns({"w": F.col("w") * 4, "h": F.col("h") * 4})
    masks = matching.without_containers(big).select("page_id", "idx").union(b.filter("idx % 3 = 0").select("page_id", "idx")).distinct()
    return masks.groupBy("page_id").agg(F.count(F.lit(1)).alias("masks"))


# --- pixels ----------------------------------------------------------------------------------------------


@query
def mean_luma(spark, sf):
    return detect.mean_level(_pixels(spark, sf))


@query
def otsu_level(spark, sf):
    return detect.otsu(_pixels(spark, sf))


@query
def ground_mode(spark, sf):
    return detect.ground(_pixels(spark, sf))


@query
def ink_coverage(spark, sf):
    return detect.ink_coverage(_pixels(spark, sf)).withColumn("ink", F.round("ink", 6))


@query
def active_cells(spark, sf):
    return detect.active_cells(_pixels(spark, sf))


@query
def grid_components(spark, sf):
    return detect.grid_components(detect.active_cells(_pixels(spark, sf)))


@query
def grid_regions(spark, sf):
    return detect.grid_regions(_pixels(spark, sf))


@query
def rgb_luma(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    r, g_, b = p % 256, s * 7 % 256, (p + s) % 256
    return table(spark, sf, "lineitem").groupBy(m.luma(r, g_, b).alias("luma")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(m.rescaled(r)), 6).alias("top"))


def _pixels(spark, sf) -> DataFrame:
    """Pages of 64 by 64 grey pixels from events: bright ground, dark strokes."""
    e = table(spark, sf, "events").select((F.col("event_id") % 4096).alias("k"), F.floor(F.col("event_id") / 4096).alias("page_id"), F.col("user_id"))
    v = F.when((F.col("k") * 7 + F.col("page_id") * 13) % 97 < 30, F.col("user_id") * 3 % 60).otherwise(215 + F.col("user_id") % 40)
    block = (F.floor(F.col("k") / 1024) + F.floor(F.col("k") % 64 / 16) + F.col("page_id")) % 3 == 0
    return e.select("page_id", (F.col("k") % 64).alias("x"), F.floor(F.col("k") / 64).alias("y"), F.when(block, v).otherwise(235 + F.col("k") % 3).cast("long").alias("v"))


# --- sources ---------------------------------------------------------------------------------------------


@query
def input_discovery(spark, sf):
    """Distinct inputs by pattern, in order, each with its first mention."""
    urls = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^(?:https?)://([^/]+)", 1).alias("host"))
    listed = urls.unionByName(urls.filter(F.col("host").rlike(r"\.org$"))).groupBy("host").agg(F.min("page_id").alias("first"))
    return listed.select("host", "first", F.row_number().over(Window.orderBy("host")).cast("long").alias("place"))


@query
def schema_conformance(spark, sf):
    """Readings against the schema's rules: the names of those that fail."""
    r = readings(spark, sf)
    rules = {"confidence": m.settled(F.col("confidence")), "state": F.col("state").isin("candidate", "accepted", "verified"), "language": F.col("language").isin("ja", "en"), "bounds": (F.col("r") > F.col("l")) & (F.col("b") > F.col("t")), "text": (F.length("text") > 0) | F.col("intentional")}
    failed = F.array_compact(F.array(*(F.when(~rule, F.lit(n)) for n, rule in sorted(rules.items()))))
    return r.select("region_id", F.array_join(failed, ",").alias("failed")).filter("failed != ''")


@query
def ledger_defaults(spark, sf):
    """Ledger rows out of JSON, missing fields defaulted."""
    row = F.from_json("props", "k bigint, status string, cer double")
    return table(spark, sf, "events").select("event_id", row.alias("r")).select("event_id", F.coalesce("r.status", F.lit("fail")).alias("status"), F.coalesce("r.cer", F.lit(1.0)).alias("cer"), F.coalesce("r.k", F.lit(0)).alias("k"))


@query
def missing_names(spark, sf):
    """Tensor names that a contract expects and a graph lacks."""
    axes = spark.range(6).select(F.col("id").alias("layer"))
    kinds = F.explode(F.array(*(F.lit(x) for x in ("decoder.key", "decoder.value", "encoder.key", "encoder.value")))).alias("part")
    expected = axes.select("layer", kinds).select(F.concat(F.lit("present."), "layer", F.lit("."), "part").alias("name"))
    nation = table(spark, sf, "nation").select(F.concat(F.lit("present."), F.col("n_nationkey") % 6, F.lit("."), F.when(F.col("n_nationkey") % 2 == 0, "decoder.key").otherwise("encoder.value")).alias("name"))
    return expected.join(nation, "name", "left_anti")


@query
def schema_choice(spark, sf):
    """The schema of an example: by its declared id, else by its file name."""
    n = table(spark, sf, "nation")
    declared = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("r"), F.col("n_regionkey")))
    examples = n.select(*_long("n_nationkey"), declared.alias("declared"), F.concat(F.lit("R"), F.col("n_regionkey") % 3).alias("stem"))
    schemas = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("file"), "r_name")
    by_id, by_file = schemas.select("id", F.col("r_name").alias("a")), schemas.select("file", F.col("r_name").alias("b"))
    out = examples.join(by_id, F.col("declared") == F.col("id"), "left").join(by_file, F.col("stem") == F.col("file"), "left")
    return out.select("n_nationkey", F.coalesce("a", "b").alias("schema"))


@query
def expected_labels(spark, sf):
    """Expected text by item, `...` where the ground truth has none."""
    truth = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("expected"))
    return table(spark, sf, "documents").select("doc_id").join(truth, "doc_id", "left").select("doc_id", F.coalesce("expected", F.lit("...")).alias("expected"))


@query
def flatten_layers(spark, sf):
    """Layers of regions flattened twice, with both indexes."""
    layers = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("regions"))
    nested = layers.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", "regions"))).alias("layers"))
    outer = nested.select("conv_id", F.posexplode("layers").alias("li", "layer"))
    return outer.select("conv_id", *_long("li"), F.col("layer.role").alias("role"), F.posexplode("layer.regions").alias("ri", "r")).select("conv_id", "li", "role", *_long("ri"), F.col("r.text").alias("text"))


@query
def beam_parents(spark, sf):
    before, found = _beams(spark, sf)
    return decoding.parents(decoding.select_beams(before, found, 4, 3), before)


@query
def type_sizes(spark, sf):
    vertical = F.col("idx") % 2 == 0
    along, across = F.when(vertical, F.col("h")).otherwise(F.col("w")), F.when(vertical, F.col("w")).otherwise(F.col("h"))
    runs, size = layout.type_size(F.col("p") % 40 + 1, along, across)
    return boxes(spark, sf).select("page_id", "idx", runs.alias("runs"), F.round(size, 4).alias("size"))


@query
def scan_defects(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", *synth.scan_defects(F.col("page_id"), "poor"))
    return rows.select("page_id", "jpeg_quality", *(F.round(c, 6).alias(c) for c in ("rotate_deg", "blur_sigma", "noise_sd")))


@query
def provenance_lookup(spark, sf):
    """The record that a field's provenance names, by pointer, with its engine."""
    i = F.col("region_id")
    pointers = F.create_map(F.lit("/text"), F.concat(F.lit("r"), i % 3), F.lit("/bounds"), F.lit("r9"))
    records = F.create_map(*(x for k in range(3) for x in (F.lit(f"r{k}"), F.lit(f"engine-{k}"))))
    out = readings(spark, sf).select("region_id", F.explode(pointers).alias("pointer", "record"))
    return out.select("region_id", "pointer", "record", F.try_element_at(records, F.col("record")).alias("engine"))


@query
def nested_ledger(spark, sf):
    """Series, volumes, pages, panels and regions nested in one record, written as JSON and read again."""
    levels = {"series": 400, "volume": 200, "page": 50, "panel": 5}
    keys = list(levels)
    nested = readings(spark, sf).select(*(F.floor(F.col("region_id") / size).alias(k) for k, size in levels.items()), F.struct("region_id", "state", "confidence").alias("item"))
    shape = "array<struct<region_id: bigint, state: string, confidence: double>>"
    while keys:
        inner = nested.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
        key = keys.pop()
        nested = inner.select(*keys, F.struct(F.col(key).alias("id"), "items").alias("item"))
        shape = f"struct<id: bigint, items: {shape}>" if not keys else f"array<struct<id: bigint, items: {shape}>>"
    flat = nested.select(F.from_json(F.to_json("item", {"ignoreNullFields": "false"}), shape).alias("item")).select(F.col("item.id").alias("series"), F.col("item.items").alias("items"))
    for k in ("volume", "page", "panel"):
        done = [x for x in flat.columns if x != "items"]
        flat = flat.select(*done, F.explode("items").alias("i")).select(*done, F.col("i.id").alias(k), F.col("i.items").alias("items"))
    return flat.select(*levels, F.posexplode("items").alias("k", "r")).select(*levels, *_long("k"), "r.region_id", "r.state", "r.confidence")


@query
def label_kinds(spark, sf):
    """Labels of one kind, and how many others are left out."""
    labels = table(spark, sf, "conversations").select("text", F.col("role").alias("label_kind"))
    return stats.of_kind(labels, "user")[1]


@query
def tensor_names(spark, sf):
    """The cache input that each cache output feeds."""
    n = F.col("n_nationkey")
    part = F.when(n % 2 == 0, "key").otherwise("value")
    side = F.when(n % 3 == 0, "encoder").otherwise("decoder")
    out = F.concat(F.lit("present."), n % 6, F.lit("."), side, F.lit("."), part)
    return table(spark, sf, "nation").select(*_long("n_nationkey"), out.alias("output"), F.regexp_replace(out, r"^present\.", "past_key_values.").alias("input"))


@query
def clip_fixture(spark, sf):
    """Pages of readings against a cap of 120 regions: what is kept and what is discarded."""
    drawn = readings(spark, sf).groupBy(F.floor(F.col("region_id") / 150).alias("page_id")).agg(F.count(F.lit(1)).alias("rendered_regions"))
    return stats.clip(drawn, "rendered_regions").select(F.format_string("page_%05d.png", "page_id").alias("file"), F.format_string("page_%05d.json", "page_id").alias("truth"), "rendered_regions", "expected_kept", "expected_discarded")


@query
def smallest_boxes(spark, sf):
    return matching.smallest(boxes(spark, sf))


@query
def region_texts(spark, sf):
    """Regions with the readings of two text layers, as far as a layer has them."""
    geometry = readings(spark, sf).select("region_id", "l", "t", "r", "b")
    turns = table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 20).alias("layer_id"), F.col("role").alias("language"), F.struct((F.col("conv_id") * 5 + F.col("turn")).alias("region_id"), "text").alias("reading"))
    layers = turns.groupBy("layer_id", "language").agg(F.collect_list("reading").alias("regions"))
    return matching.region_texts(geometry, layers)


@query
def placeholder_scan(spark, sf):
    """Lines that return a placeholder, in texts with made lines of code after them."""
    i = F.col("doc_id")
    code = F.concat(F.lit("\n  // names PLACEHOLDER above\n"), F.when(i % 3 == 0, 'return PLACEHOLDER + "STUB"').when(i % 3 == 1, "return read(page)").otherwise('\t"DUMMY"'))
    return validate.placeholders(table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), code).alias("code")), "doc_id", "code")


@query
def props_conformance(spark, sf):
    """JSON objects against a schema that allows no further properties."""
    rules = {"required": ["k"], "properties": {"k": {"minimum": 0, "maximum": 90}, "kind": {"enum": ["a", "b"]}}, "additionalProperties": False}
    i = F.col("event_id")
    more = F.when(i % 4 == 0, '{"kind": "a", ').when(i % 4 == 1, '{"kind": "c", ').when(i % 4 == 2, '{"extra": 1, ').otherwise("{")
    made = table(spark, sf, "events").select("event_id", F.concat(more, F.substr("props", F.lit(2))).alias("body"))
    row = made.select("event_id", F.json_object_keys("body").alias("keys"), F.from_json("body", "k bigint, kind string").alias("r"))
    return row.select("event_id", schema.conforms(rules, lambda n: F.col("r")[n], F.col("keys")).alias("ok"))
