"""Views that give the driver's tables the shape of pages, regions, readings and detections.

All geometry is integer arithmetic, so that any SQL engine makes the same rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionflow.session import reachable

#: Size of a page in pixels.
PAGE = (1000, 1400)

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region readings from documents: language, state, confidence, bounds in hundredths of the page."""
    i = F.col("doc_id")
    left, top = i * 13 % 70, i * 29 % 60
    states = ["candidate", "accepted", "verified", "rejected"]
    state = F.lit(None).cast("string")
    for k, s in enumerate(states):
        state = F.when(i % 4 == k, F.lit(s)).otherwise(state)
    return table(spark, sf_dir, "documents").select(
        i.alias("region_id"),
        (i % 97).alias("page_id"),
        "text",
        F.when(F.col("lang") == "en", "en").otherwise("ja").alias("language"),
        state.alias("state"),
        F.when(i % 17 != 0, (i * 37 % 101) / 100.0).alias("confidence"),
        (left / 100.0).alias("l"),
        (top / 100.0).alias("t"),
        ((left + i * 7 % 31) / 100.0).alias("r"),
        ((top + i * 11 % 41) / 100.0).alias("b"),
        (i % 23 == 0).alias("intentional"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth boxes of pages from line items: page_id, idx from 1, x, y, w, h and the keys they come from."""
    order = Window.partitionBy("l_orderkey").orderBy(*(c.strip() for c in _ORDER.split(",")))
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        F.row_number().over(order).cast("long").alias("idx"),
        ((p * 37 + n * 211) % 900).alias("x"),
        ((s * 53 + n * 131) % 1300).alias("y"),
        (F.lit(20) + p % 180).alias("w"),
        (F.lit(20) + s % 140).alias("h"),
        p.alias("p"),
        s.alias("s"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as a detector might see them: shifted a little, some missing, some halved."""
    b = boxes(spark, sf_dir)
    p, s = F.col("p"), F.col("s")
    half = (p + s) % 11 == 0
    return b.filter((p + s) % 6 != 0).select(
        "page_id", "idx", (F.col("x") + p % 9).alias("x"), (F.col("y") + s % 7).alias("y"), F.when(half, F.floor(F.col("w") / 2)).otherwise(F.col("w")).alias("w"), "h"
    )


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel rectangle, a declared panel count and a declared direction for each page, from orders."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    declared = F.when(o % 4 == 0, "right_to_left").when(o % 4 == 1, " LTR ").when(o % 4 == 2, "vertical-rl").otherwise("top_to_bottom")
    return table(spark, sf_dir, "orders").select(
        o.alias("page_id"), (o * 17 % 300).alias("x"), (c * 13 % 400).alias("y"), F.lit(500).cast("long").alias("w"), F.lit(700).cast("long").alias("h"), declared.alias("declared"), (o % 8).alias("declared_total")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pseudo-engines' answers for each benchmark item: as it is, with a to z upper-cased, cut short."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")

    def engine(k: int, answer, confidence, brier):
        values = (("engine", F.lit(k).cast("long")), ("answer", answer), ("confidence", (confidence / 100.0).cast("double")), ("brier", F.lit(brier).cast("double")))
        return F.struct(*(v.alias(n) for n, v in values))

    engines = F.array(
        engine(0, F.col("text"), i * 31 % 50 + 50, 0.05),
        engine(1, F.when(i % 3 == 0, F.col("text")).otherwise(F.translate("text", ascii_lowercase, ascii_uppercase)), i * 17 % 60 + 40, 0.2),
        engine(2, F.expr("substring(text, 1, length(text) - cast(item_id % 9 as int))"), i * 7 % 70 + 30, None),
    )
    return b.select(i.alias("region_id"), F.col("text").alias("expected"), F.explode(engines).alias("e")).select("region_id", "expected", "e.*")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
