"""Mixing sources to target weights along a curriculum.

A source's weight schedule is a broken line over training time 0 to 1. Its integral, scaled to the source's
target, is the source's cumulative token demand; inverting it gives each stretch of the source's token line
its training time, and the sum of all demands at that time its position.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from regionflow.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a source that one bucket of its token line holds on average.
BUCKET_ROWS = 2000
#: Sources up to which their settings are broadcast; beyond, rows are shuffled to them.
BROADCAST_SOURCES = 100_000

#: Schedules by weight: (time, relative rate) corners. Heavy sources fall, light ones rise.
SCHEDULES = {5: ((0.0, 1.0), (1.0, 0.6)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def shares(sizes: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """sizes (source, size, ...) with weight and target: `total` times all sizes by weight, none above `most` times its size,
    the excess shared anew.

    In order of the share of weight at which a source is full, all before the first that isn't full are; that
    one tells what a unit of weight gives. The windows without a key hold a row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    each = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place)).withColumn("cap", F.lit(float(most)) * F.col("size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0.0))
    level = (F.lit(float(total)) * F.sum("size").over(whole) - so_far("cap")) / (F.sum("weight").over(whole) - so_far("weight"))
    each = each.withColumn("level", level).withColumn("turn", F.row_number().over(by))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(whole)
    target = F.coalesce(F.least("cap", first["level"] * F.col("weight")), F.col("cap"))
    return each.withColumn("target", target).drop("cap", "level", "turn")


def _integral(corners: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Pieces (start time, rate at start, slope, integral before), the whole integral scaled to 1."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(corners, corners[1:], strict=False))
    out, before = [], 0.0
    for a, b in zip(corners, corners[1:], strict=False):
        slope = (b[1] - a[1]) / (b[0] - a[0])
        out.append((a[0], a[1] / whole, slope / whole, before))
        before += (b[0] - a[0]) * (a[1] + b[1]) / 2 / whole
    return out


def _time(share: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Inverse of the integral: when a source has given this share of its target."""
    out = None
    for start, rate, slope, before in _integral(corners):
        y = F.greatest(share - F.lit(before), F.lit(0.0))
        step = y / rate if abs(slope) < 1e-12 else (F.sqrt(F.greatest(F.lit(rate * rate) + 2 * slope * y, F.lit(0.0))) - rate) / slope
        now = F.lit(start) + step
        out = now if out is None else F.when(share >= before, now).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _given(time: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """The integral: what share of its target a source has given by then."""
    out = None
    for start, rate, slope, before in _integral(corners):
        dt = time - F.lit(start)
        now = F.lit(before) + rate * dt + slope / 2 * dt * dt
        out = now if out is None else F.when(time >= start, now).otherwise(out)
    return out


def mix(
    df: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    most: float = 2.0,
    schedules: Mapping[float, Sequence[tuple[float, float]]] = SCHEDULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (id, source, text_hash, size, source_size, target, taken, passes, position, positions), one for each row of df.

    size: words (null text: 0). A source's rows stand in a fixed pseudo-random order on a line as long as its
    size; the mix reads the line from its start, over and over, until the target is reached, so a source's
    taken words add up to its target but for less than a word, and the last row may be taken in part. passes:
    how often a row is begun. positions: where in the mixed stream its passes begin; position: the first of them,
    null if it is not taken. Equal rows have equal sizes but places of their own; empty tables give no rows.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    base = cut(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            text_hash.alias("text_hash"),
            F.xxhash64(F.lit("mixing order"), F.col(id_col), text_hash).alias("order"),
        )
    )
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    plan = cut(shares(found, weights, total, most))
    settings = plan.select("source", F.col("size").alias("source_size"), "weight", "target", F.col("target").cast("bigint").alias("goal"), F.greatest(F.lit(1), F.floor(F.col("rows") / BUCKET_ROWS)).alias("buckets"))
    if settings.count() <= BROADCAST_SOURCES:
        settings = F.broadcast(settings)
    # The line of a source in buckets of its order: sums of whole buckets first, then places inside each bucket.
    placed = base.join(settings, base["source"].eqNullSafe(settings["source"])).drop(settings["source"])
    unit = F.shiftrightunsigned("order", 11).cast("double") / float(1 << 53)
    placed = placed.withColumn("bucket", F.least(F.floor(unit * F.col("buckets")), F.col("buckets") - 1))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(F.col("source").alias("head_source"), F.col("bucket").alias("head_bucket"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = (
        placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(heads, F.col("source").eqNullSafe(F.col("head_source")) & (F.col("bucket") == F.col("head_bucket")))
        .withColumn("start", F.col("bucket_start") + F.col("inner"))
    )
    rounds = math.ceil(most)
    part = lambda goal: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("start")))
    taken = sum((part(F.col("goal") - k * F.col("source_size")) for k in range(1, rounds)), part(F.col("goal")))
    passes = sum(((F.col("goal") - k * F.col("source_size") > F.col("start")) & (F.col("size") > 0)).cast("int") for k in range(rounds))
    lined = lined.withColumn("taken", taken).withColumn("passes", passes)
    demand = {r["weight"]: r["target"] for r in plan.groupBy("weight").agg(F.sum("target").alias("target")).collect()}  # as many as there are weights
    kinds = sorted(demand)
    flat = ((0.0, 1.0), (1.0, 1.0))

    def position(k: int) -> Column:
        share = F.least((F.col("start") + k * F.col("source_size")) / F.col("target"), F.lit(1.0))
        time = F.lit(None).cast("double")
        for w in kinds:
            time = F.when(F.col("weight") == w, _time(share, schedules.get(w, flat))).otherwise(time)
        at = sum((F.lit(demand[w]) * _given(time, schedules.get(w, flat)) for w in kinds), F.lit(0.0))
        return F.when(F.col("passes") > k, F.round(at, 3))

    lined = lined.withColumn("positions", F.filter(F.array(*(position(k) for k in range(rounds))), lambda x: x.isNotNull()))
    return lined.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "text_hash", "size", "source_size", "target",
        F.col("taken").cast("long").alias("taken"), "passes", F.get("positions", F.lit(0)).alias("position"), "positions",
    )


def stream(df: DataFrame, parts: int | None = None, position_col: str = "position") -> DataFrame:
    """Rows range-sorted by position: partition after partition is the training order. Rows without a position follow,
    dealt by a hash so that they don't meet in one partition."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    simple = [f.name for f in df.schema.fields if isinstance(f.dataType, (LongType, StringType))] or df.columns
    after = F.lit(1e18) + F.pmod(F.xxhash64(*simple), F.lit(1 << 40)).cast("double") * 1e6
    place = F.coalesce(F.col(position_col), after)
    return df.repartitionByRange(n, place).sortWithinPartitions(place)
