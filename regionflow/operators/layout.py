"""Reading order and tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the layout rules, in pixels.
BAND, LEAST_ROW, ROW_SHARE = 200, 40.0, 0.75


def rows(df: DataFrame, page: str = "page_id", direction: str = "direction") -> DataFrame:
    """(page, idx, row, place): boxes (page, idx, x, y, h, direction) in reading order, place from 1.

    Boxes in order of y join the current row while they lie within three quarters of its mean height, 40 at
    least, of its mean y. Rows read by x. A direction that isn't known gives no order.
    """
    ordered = df.groupBy(page, direction).agg(F.array_sort(F.collect_list(F.struct("y", "idx", "x", "h"))).alias("boxes"))
    empty = F.array().cast("array<struct<row:bigint,x:bigint,y:bigint,idx:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sh"), empty.alias("out"))

    def step(s: Column, b: Column) -> Column:
        reach = F.greatest(F.try_divide(s["sh"], s["n"]) * ROW_SHARE, F.lit(LEAST_ROW))
        same = (s["n"] > 0) & (F.abs(b["y"] - F.try_divide(s["sy"], s["n"])) <= reach)
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        keep = lambda name: F.when(same, s[name]).otherwise(F.lit(0))
        item = F.struct(row.alias("row"), b["x"].alias("x"), b["y"].alias("y"), b["idx"].alias("idx"))
        return F.struct(row.alias("row"), (keep("n") + 1).cast("long").alias("n"), (keep("sy") + b["y"]).cast("double").alias("sy"), (keep("sh") + b["h"]).cast("double").alias("sh"), F.concat(s["out"], F.array(item)).alias("out"))

    placed = ordered.withColumn("out", F.aggregate("boxes", start, step, lambda s: s["out"]))
    sign = F.when(F.col(direction) == "right-to-left", -1).when(F.col(direction) == "left-to-right", 1)
    keyed = F.transform("out", lambda o: F.struct(o["row"].alias("row"), (o["x"] * F.col("sign")).alias("side"), o["y"].alias("y"), o["idx"].alias("idx")))
    flat = placed.withColumn("sign", sign).filter("sign is not null").select(page, F.posexplode(F.array_sort(keyed)).alias("k", "o"))
    return flat.select(page, F.col("o.idx").alias("idx"), F.col("o.row").alias("row"), (F.col("k") + 1).cast("long").alias("place"))


def band(y: Column) -> Column:
    """Fixed bands of the page from the top."""
    return F.floor(y / BAND).cast("long")


def tiles(df: DataFrame, width: str = "w", height: str = "h", most: int = 3, keep: tuple[int, int] = (4, 5)) -> DataFrame:
    """df with tile, tile_x, tile_y, tile_w, tile_h: one tile, or for a strip beyond `most` to 1 square tiles whose
    stride is keep[0]/keep[1] of the short side, the last one clipped."""
    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    short, long = F.least(w, h), F.greatest(w, h)
    strip = long > most * short
    stride = F.greatest(F.floor(short * keep[0] / keep[1]), F.lit(1))
    count = F.when(strip, F.greatest(F.ceil((long - short) / stride), F.lit(0)) + 1).otherwise(1).cast("long")
    out = df.withColumn("_n", count).withColumn("_s", stride).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = F.col("tile") * F.col("_s")
    side = F.least(short, long - at)
    down, across = strip & (h > w), strip & (w > h)
    return out.select(
        *df.columns, "tile",
        F.when(across, at).otherwise(0).cast("long").alias("tile_x"), F.when(down, at).otherwise(0).cast("long").alias("tile_y"),
        F.when(across, side).otherwise(w).cast("long").alias("tile_w"), F.when(down, side).otherwise(h).cast("long").alias("tile_h"),
    )


def type_size(chars: Column, along: Column, across: Column) -> tuple[Column, Column]:
    """Runs and type size (12 to 64 pixels) of `chars` characters in a crop, along and across the writing direction."""
    runs = F.greatest(F.round(F.sqrt(chars * across / along)), F.lit(1.0))
    per_run = F.greatest(F.ceil(chars / runs), F.lit(1))
    return runs.cast("long"), F.least(F.greatest(along / per_run, F.lit(12.0)), F.lit(64.0))
