"""Spatial joins and matching of detections with truth. All joins have an equality, so none becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.functions import geometry as g


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keep))


def pairs(a: DataFrame, b: DataFrame, condition: Column, how: str = "inner", cell: int | None = None) -> DataFrame:
    """Join boxes a (columns a_*) and b (b_*) of one page. On crowded pages `cell` adds a grid to the key: boxes meet
    in the cells that both touch, and a pair counts in the one that holds its intersection's corner."""
    if cell is None:
        return a.join(b, (a["page_id"] == b["page_id"]) & condition, how).drop(b["page_id"])
    span = lambda p, s: F.sequence(F.floor(F.col(f"{p}{s}") / cell), F.floor((F.col(f"{p}{s}") + F.col(f"{p}{'w' if s == 'x' else 'h'}")) / cell))
    grid = lambda df, p: df.withColumn(f"{p}cx", F.explode(span(p, "x"))).withColumn(f"{p}cy", F.explode(span(p, "y")))
    left, right = grid(a, "a_"), grid(b, "b_")
    own = (F.col("a_cx") == F.floor(F.greatest("a_x", "b_x") / cell)) & (F.col("a_cy") == F.floor(F.greatest("a_y", "b_y") / cell))
    on = (left["page_id"] == right["page_id"]) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & own
    return left.join(right, on & condition, "inner").drop(right["page_id"]).drop("a_cx", "a_cy", "b_cx", "b_cy")


def iou_pairs(truth: DataFrame, found: DataFrame, least: float, cell: int | None = None) -> DataFrame:
    """(page_id, truth, found, iou) for boxes (page_id, idx, x, y, w, h) whose IoU reaches `least`."""
    a, b = prefixed(truth.select("page_id", "idx", "x", "y", "w", "h"), "a_"), prefixed(found.select("page_id", "idx", "x", "y", "w", "h"), "b_")
    touching = g.overlaps(g.box("a_"), g.box("b_"))
    iou = g.iou(g.box("a_"), g.box("b_"))
    return pairs(a, b, touching, cell=cell).select("page_id", F.col("a_idx").alias("truth"), F.col("b_idx").alias("found"), iou.alias("iou")).filter(F.col("iou") >= least)


def greedy(candidates: DataFrame) -> DataFrame:
    """One-to-one matches, best IoU first, ties by truth, then by detection."""
    listed = candidates.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("cost"), "truth", "found"))).alias("c"))
    none = F.array().cast("array<struct<cost:double,truth:bigint,found:bigint>>")

    def step(taken: Column, c: Column) -> Column:
        used = F.exists(taken, lambda t: (t["truth"] == c["truth"]) | (t["found"] == c["found"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(c)))

    chosen = listed.select("page_id", F.explode(F.aggregate("c", none, step)).alias("m"))
    return chosen.select("page_id", F.col("m.truth").alias("truth"), F.col("m.found").alias("found"), (-F.col("m.cost")).alias("iou"))


def recall_report(truth: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """A row for each page: counts, recall, precision and mean IoU of the matches; 0 where there is nothing to divide by."""
    matched = greedy(iou_pairs(truth, found, least)).groupBy("page_id").agg(F.count(F.lit(1)).alias("matched"), F.avg("iou").alias("mean_iou"))
    counts = truth.groupBy("page_id").agg(F.count(F.lit(1)).alias("truth_count"))
    seen = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("found_count"))
    out = counts.join(seen, "page_id", "full").join(matched, "page_id", "left").na.fill(0, ["truth_count", "found_count", "matched"])
    rate = lambda n: F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col(n)), F.lit(0.0))
    return out.select("page_id", "truth_count", "found_count", "matched", rate("truth_count").alias("recall"), rate("found_count").alias("precision"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"))


def without_containers(boxes: DataFrame) -> DataFrame:
    """Boxes that hold no other box that differs from them."""
    a, b = prefixed(boxes, "a_"), prefixed(boxes, "b_")
    differs = (F.col("a_x") != F.col("b_x")) | (F.col("a_y") != F.col("b_y")) | (F.col("a_w") != F.col("b_w")) | (F.col("a_h") != F.col("b_h"))
    left = a.join(b, (a["page_id"] == b["page_id"]) & differs & g.contains(g.box("a_"), g.box("b_")), "left_anti")
    return left.select("page_id", *(F.col("a_" + c).alias(c) for c in boxes.columns if c != "page_id"))


def occupancy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(page_id, idx, held): how many truth boxes have their centre in each detection."""
    a, b = prefixed(found.select("page_id", "idx", "x", "y", "w", "h"), "a_"), prefixed(truth.select("page_id", "idx", "x", "y", "w", "h"), "b_")
    joined = a.join(b, (a["page_id"] == b["page_id"]) & g.centre_inside(g.box("a_"), g.box("b_")), "left").drop(b["page_id"])
    return joined.groupBy("page_id", F.col("a_idx").alias("idx")).agg(F.count("b_idx").alias("held"))


def filter_cost(found: DataFrame, truth: DataFrame, reason: Column, least: float = 0.5) -> DataFrame:
    """(reason, dropped, would_match): what each filter drops, and how much of it a truth box would have matched."""
    a = prefixed(found.withColumn("reason", reason).select("page_id", "idx", "x", "y", "w", "h", "reason"), "a_")
    b = prefixed(truth.select("page_id", "idx", "x", "y", "w", "h"), "b_")
    good = a.join(b, (a["page_id"] == b["page_id"]) & (g.iou(g.box("a_"), g.box("b_")) >= least), "left_semi").select("page_id", "a_idx").withColumn("good", F.lit(1))
    return a.join(good, ["page_id", "a_idx"], "left").groupBy(F.col("a_reason").alias("reason")).agg(F.count(F.lit(1)).alias("dropped"), F.count("good").alias("would_match"))


def innermost(boxes: DataFrame) -> DataFrame:
    """(page_id, idx, container): the smallest other box that holds each box's centre, ties by idx; null if none does."""
    a, b = prefixed(boxes.select("page_id", "idx", "x", "y", "w", "h"), "a_"), prefixed(boxes.select("page_id", "idx", "x", "y", "w", "h"), "b_")
    b = b.withColumnRenamed("page_id", "b_page")
    on = (F.col("page_id") == F.col("b_page")) & (F.col("a_idx") != F.col("b_idx")) & g.centre_inside(g.box("b_"), g.box("a_"))
    joined = a.join(b, on, "left")
    return joined.groupBy("page_id", F.col("a_idx").alias("idx")).agg(F.min(F.when(F.col("b_idx").isNotNull(), F.struct(g.area(g.box("b_")).alias("area"), "b_idx"))).alias("m")).select("page_id", "idx", F.col("m.b_idx").alias("container"))


def split_matches(loose: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(page_id, idx, best): for detections without a match the best IoU that any union with another one reaches."""
    boxes = loose.select("page_id", "idx", "x", "y", "w", "h")
    a, b = prefixed(boxes, "a_"), prefixed(boxes, "b_")
    u = g.union(g.box("a_"), g.box("b_"))
    two = a.join(b, (a["page_id"] == b["page_id"]) & (F.col("a_idx") != F.col("b_idx"))).drop(b["page_id"])
    two = two.select("page_id", F.col("a_idx").alias("idx"), u.x.alias("u_x"), u.y.alias("u_y"), u.w.alias("u_w"), u.h.alias("u_h"))
    t = prefixed(truth.select("page_id", "x", "y", "w", "h"), "t_")
    best = two.join(t, "page_id").groupBy("page_id", "idx").agg(F.max(g.iou(g.box("u_"), g.box("t_"))).alias("best"))
    return best.filter(F.col("best") >= least)


def first_panel(regions: DataFrame, panels: DataFrame) -> DataFrame:
    """(page_id, idx, panel): the lowest-numbered panel of the page that contains a region's centre; null if none does."""
    a = prefixed(regions.select("page_id", "idx", "x", "y", "w", "h"), "a_")
    b = prefixed(panels.select("page_id", "panel", "x", "y", "w", "h"), "b_").withColumnRenamed("page_id", "b_page")
    joined = a.join(b, (F.col("page_id") == F.col("b_page")) & g.centre_inside(g.box("b_"), g.box("a_")), "left")
    return joined.groupBy("page_id", F.col("a_idx").alias("idx")).agg(F.min("b_panel").alias("panel"))


def region_texts(regions: DataFrame, layers: DataFrame) -> DataFrame:
    """Every region with every reading of it: layers (layer_id, language, regions) hold readings by region_id. A region
    that no layer reads has nulls; a reading of an unknown region is left out."""
    texts = layers.select("layer_id", "language", F.explode("regions").alias("reading")).select("layer_id", "language", F.col("reading.region_id").alias("region_id"), F.col("reading.text").alias("text"))
    return regions.join(texts, "region_id", "left")


def smallest(boxes: DataFrame, n: int = 14) -> DataFrame:
    """The n boxes of least area, for a report; ties by page and index."""
    area = g.area(g.box())
    return boxes.select("page_id", "idx", "x", "y", "w", "h", area.alias("area")).orderBy("area", "page_id", "idx").limit(n)
