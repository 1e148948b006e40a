"""Summaries of scored readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Length buckets, and the error rate that passes the gate.
BUCKETS = ((1, 8), (9, 14), (15, 22), (23, 34), (35, 200))
PASS_CER = 0.05


def length_buckets(samples: DataFrame, label: str = "label_len", out: str = "out_len", exact: str = "exact") -> DataFrame:
    """(low, high, n, mean_out, mean_over, exact) for buckets that have samples."""
    bucket = F.lit(None).cast("struct<low:bigint,high:bigint>")
    for low, high in reversed(BUCKETS):
        bucket = F.when(F.col(label).between(low, high), F.struct(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))).otherwise(bucket)
    rows = samples.withColumn("bucket", bucket).filter("bucket is not null")
    return rows.groupBy("bucket.low", "bucket.high").agg(F.count(F.lit(1)).alias("n"), F.avg(out).alias("mean_out"), F.avg(F.col(out) - F.col(label)).alias("mean_over"), F.count_if(F.col(exact)).alias("exact"))


def deltas(df: DataFrame, value: Column, key: str) -> DataFrame:
    """(key, n, mean, median, least, most) of values that aren't null; the median is the upper of the middle two.

    Equal values are counted before anything is ordered, so a window holds a row for each different value.
    """
    counts = df.select(key, value.alias("d")).filter("d is not null").groupBy(key, "d").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(key).orderBy("d")
    counts = counts.withColumn("upto", F.sum("c").over(by)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("d")))
    return counts.groupBy(key).agg(F.sum("c").alias("n"), (F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("mean"), middle.alias("median"), F.min("d").alias("least"), F.max("d").alias("most"))


def of_kind(labels: DataFrame, kind: str, kind_col: str = "label_kind") -> tuple[DataFrame, DataFrame]:
    """(the labels of a kind, one row: how many are kept and how many excluded). A label without a kind is excluded."""
    wanted = F.coalesce(F.col(kind_col) == kind, F.lit(False))
    return labels.filter(wanted), labels.agg(F.count_if(wanted).alias("kept"), F.count_if(~wanted).alias("excluded"))


def gate(scored: DataFrame, status: str = "status", cer: str = "cer") -> DataFrame:
    """One row: total, passed, failed, mean CER, and whether any row was scored: none is a failure."""
    passed = (F.col(status) == "success") & (F.col(cer) <= PASS_CER)
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"), F.count_if(~F.coalesce(passed, F.lit(False))).alias("failed"), F.avg(cer).alias("mean_cer"),
        ((F.count(cer) > 0) & (F.count_if(~F.coalesce(passed, F.lit(False))) == 0)).alias("ok"),
    )


def best_setting(df: DataFrame, group: str, setting: str, order: str, value: str) -> DataFrame:
    """(group, setting, mean): the setting with the best mean, the first in order of equals."""
    means = df.groupBy(group, setting, order).agg(F.round(F.avg(value), 9).alias("mean"))
    return means.groupBy(group).agg(F.max(F.struct("mean", (-F.col(order)).alias("o"), setting)).alias("m")).select(group, F.col(f"m.{setting}").alias(setting), F.col("m.mean").alias("mean"))


def rollup_pages(tiles: DataFrame) -> DataFrame:
    """(page_id, regions, text, confidence, duration_ms): tiles joined to regions without a space, regions to a page by line
    breaks; confidences are averaged, durations summed."""
    regions = tiles.groupBy("page_id", "region").agg(F.array_join(F.array_sort(F.collect_list(F.struct("tile", "text")))["text"], "").alias("text"), F.avg("confidence").alias("confidence"), F.sum("duration_ms").alias("duration_ms"))
    return regions.groupBy("page_id").agg(F.count(F.lit(1)).alias("regions"), F.array_join(F.array_sort(F.collect_list(F.struct("region", "text")))["text"], "\n").alias("text"), F.avg("confidence").alias("confidence"), F.sum("duration_ms").alias("duration_ms"))


def paired(real: DataFrame, made: DataFrame, text: str, confidence: str) -> DataFrame:
    """(text, real, made): confidences of real readings beside that of what was made from the same text, the best if made twice."""
    other = made.groupBy(text).agg(F.max(confidence).alias("made"))
    return real.select(text, F.col(confidence).alias("real")).join(other, text)


def clip(pages: DataFrame, count: str, cap: int = 120) -> DataFrame:
    """pages with what a cap on regions keeps and discards, by what was drawn, never by what was asked for."""
    n = F.col(count)
    return pages.withColumns({"expected_kept": F.least(n, F.lit(cap)).cast("long"), "expected_discarded": F.greatest(n - cap, F.lit(0)).cast("long")})
