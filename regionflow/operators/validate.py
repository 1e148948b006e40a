"""Structural checks of pages; each gives one row for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.functions import geometry as g
from regionflow.functions.text import reading_direction

# Fixed values of the rules.
BAND_PX, ORDER_CONFIDENCE, MARGIN = 60.0, 0.98, 0.15
HARD, SOFT, NO_BOUNDS = 1000.0, 100.0, 1.0
MASK_EXPANSION, MASK_FEATHER = 4.0, 1.5


def cardinality(pages: DataFrame, panels: DataFrame) -> DataFrame:
    """(page_id, declared, actual) for pages whose declared panel count is wrong."""
    actual = panels.groupBy("page_id").agg(F.count(F.lit(1)).alias("actual"))
    joined = pages.select("page_id", F.col("declared_total").alias("declared")).join(actual, "page_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.filter("declared != actual")


def duplicate_ids(df: DataFrame, page: str, identifier: str, order: str) -> DataFrame:
    """A row for each occurrence of an id on a page after the first."""
    again = Window.partitionBy(page, identifier).orderBy(order)
    return df.withColumn("occurrence", F.row_number().over(again).cast("long")).filter("occurrence > 1").select(page, identifier, order, "occurrence")


def containment(regions: DataFrame, panels: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """(page_id, idx, overflow, message) for regions that reach more than `tolerance` beyond their panel."""
    t, p = regions.select("page_id", "idx", *(F.col(c).alias("t_" + c) for c in "xywh")), panels.select("page_id", *(F.col(c).alias("p_" + c) for c in "xywh"))
    a, b = g.box("t_"), g.box("p_")
    over = F.greatest(b.x - a.x, a.x + a.w - b.x - b.w, b.y - a.y, a.y + a.h - b.y - b.h, F.lit(0)).cast("double")
    message = F.format_string("Text region '%s' extends %.1fpx outside parent panel '%s' bounds (tolerance: %.1fpx).", F.col("idx"), F.col("overflow"), F.col("page_id"), F.lit(tolerance))
    return t.join(p, "page_id").select("page_id", "idx", over.alias("overflow")).filter(F.col("overflow") > tolerance).withColumn("message", message)


def order_violations(panels: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, first, second, confidence): panels of one band whose order runs against the declared direction.

    Panels (page_id, idx, x, y, h, reading_order) share a band if their centres lie within 60 pixels. Equal x or
    equal order never is a violation; a direction that isn't known checks nothing.
    """
    sign = F.when(F.col("d") == "left-to-right", 1).when(F.col("d") == "right-to-left", -1)
    known = pages.select("page_id", reading_direction(F.col("declared")).alias("d")).withColumn("sign", sign).filter("sign is not null")
    own = panels.join(known, "page_id").withColumn("centre", F.col("y") + F.col("h") / 2)
    side = lambda p: own.select("page_id", *(F.col(c).alias(p + c) for c in ("idx", "x", "centre", "reading_order", "sign")))
    a, b = side("a_"), side("b_")
    joined = a.join(b, (a["page_id"] == b["page_id"]) & (F.col("a_idx") < F.col("b_idx")) & (F.abs(F.col("a_centre") - F.col("b_centre")) < BAND_PX)).drop(b["page_id"])
    wrong = F.signum(F.col("a_x") - F.col("b_x")) * F.signum(F.col("a_reading_order") - F.col("b_reading_order")) * F.col("a_sign") < 0
    return joined.filter(wrong).select("page_id", F.col("a_idx").alias("first"), F.col("b_idx").alias("second"), F.lit(ORDER_CONFIDENCE).alias("confidence"))


def role_conflict(chapter: Column, continuation: Column, badge: Column) -> Column:
    """A badge that repeats the chapter number while the text speaks of an earlier next chapter."""
    return F.coalesce((chapter == badge) & (continuation < chapter), F.lit(False))


def art_penalty(texts: DataFrame, art: DataFrame) -> DataFrame:
    """(page_id, idx, penalty, hard): overlap of text boxes with protected art.

    Art (page_id, panel, protection, weight, x, y, w, h) counts if its panel is the text's or either has none; art
    without bounds overlaps by 1.
    """
    t = texts.select("page_id", "idx", F.col("panel").alias("t_panel"), *(F.col(c).alias("t_" + c) for c in "xywh"))
    a = art.select("page_id", F.col("panel").alias("a_panel"), "protection", "weight", *(F.col(c).alias("a_" + c) for c in "xywh"))
    own = (t["page_id"] == a["page_id"]) & (F.col("t_panel").isNull() | F.col("a_panel").isNull() | (F.col("t_panel") == F.col("a_panel")))
    joined = t.join(a, own, "left").drop(a["page_id"])
    common = F.when(F.col("a_x").isNull(), F.lit(NO_BOUNDS)).otherwise(g.intersection(g.box("t_"), g.box("a_")).cast("double"))
    cost = F.when(F.col("protection") == "hard", common * HARD).when(F.col("protection") == "soft", common * F.coalesce("weight", F.lit(1.0)) * SOFT).otherwise(0.0)
    hard = F.coalesce((F.col("protection") == "hard") & (common > 0), F.lit(False))
    return joined.groupBy("page_id", "idx").agg(F.sum(cost).alias("penalty"), F.max(hard).alias("hard"))


def masks(containers: DataFrame) -> DataFrame:
    """A clean-up mask for each container (id, panel_id, type)."""
    return containers.select(
        F.concat(F.lit("mask-"), F.col("id")).alias("id"), "panel_id", F.when(F.col("type") == "speech-balloon", "clean-balloon").otherwise("erase-text").alias("mask_type"),
        F.lit(MASK_EXPANSION).alias("expansion"), F.lit(MASK_FEATHER).alias("feather"),
    )


def page_issues(panels: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, id, issue_type, severity): panels without extent, texts without display text."""
    flat = panels.filter("w <= 0 or h <= 0").select("page_id", F.concat(F.lit("invalid-panel-"), F.col("idx")).alias("id"), F.lit("invalid-bounds").alias("issue_type"), F.lit("error").alias("severity"))
    blank = texts.filter(F.regexp_replace(F.coalesce("display", F.lit("")), r"(?U)\s", "") == "")
    return flat.unionByName(blank.select("page_id", F.concat(F.lit("missing-translation-"), F.col("idx")).alias("id"), F.lit("missing-translation").alias("issue_type"), F.lit("warning").alias("severity")))


def page_status(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(page_id, status): the worst of a page's issues."""
    rank = F.max(F.when(F.col("severity") == "error", 2).otherwise(1))
    worst = issues.groupBy("page_id").agg(rank.alias("rank"))
    return pages.select("page_id").join(worst, "page_id", "left").select("page_id", F.when(F.col("rank") == 2, "invalid").when(F.col("rank") == 1, "warning").otherwise("valid").alias("status"))


def resolution(margin: Column) -> Column:
    """A margin that isn't a number resolves."""
    safe = F.when(~F.isnan(margin), margin)
    return F.when(safe < MARGIN, "human-review-required").otherwise("resolved")


def ambiguity(primary: Column, alternatives: Column) -> tuple[Column, Column]:
    """(margin, status) of a hypothesis against the first of its alternatives' confidences; without one there is no margin,
    and it is resolved."""
    margin = F.abs(primary - F.get(alternatives, F.lit(0)))
    return margin, resolution(margin)


def speakers(tails: DataFrame) -> DataFrame:
    """Nearest of two speakers for tails (id, tx, ty, ax, ay, bx, by): choice, confidence, margin, status.

    The probabilities are complements of the distances' shares; with both distances 0 they are unknown and b is taken.
    """
    da = g.distance(F.col("tx"), F.col("ty"), F.col("ax"), F.col("ay"))
    db = g.distance(F.col("tx"), F.col("ty"), F.col("bx"), F.col("by"))
    d = tails.withColumns({"da": da, "db": db}).withColumns({"pa": 1 - F.try_divide(F.col("da"), F.col("da") + F.col("db")), "pb": 1 - F.try_divide(F.col("db"), F.col("da") + F.col("db"))})
    a = F.coalesce(F.col("pa") >= F.col("pb"), F.lit(False))
    margin = F.abs(F.col("pa") - F.col("pb"))
    return d.select("id", F.when(a, "a").otherwise("b").alias("speaker"), F.when(a, F.col("pa")).otherwise(F.col("pb")).alias("confidence"), margin.alias("margin"), resolution(F.coalesce(margin, F.lit(float("nan")))).alias("status"))


# Words that stand for a result that was never computed.
PLACEHOLDERS = ("ONNX_NATIVE_PREDICTION", "PLACEHOLDER", '"STUB"', '"DUMMY"')


def placeholders(sources: DataFrame, name: str, text: str) -> DataFrame:
    """(name, line, word) of lines that hold a placeholder; comment lines may name one."""
    lines = sources.select(name, F.posexplode(F.split(text, "\n")).alias("k", "body")).withColumn("body", F.trim("body")).filter(~F.startswith("body", F.lit("//")))
    words = F.filter(F.array(*(F.lit(w) for w in PLACEHOLDERS)), lambda w: F.contains(F.col("body"), w))
    return lines.select(name, (F.col("k") + 1).cast("long").alias("line"), F.explode(words).alias("word"))
