"""Sinks. All refuse a target that exists, and check what they write before they write it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.operators import export, vocab
from regionflow.sources import images


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """JSON lines, nulls kept, in folders by the given columns."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy(*by).json(path)


def write_vocabulary(df: DataFrame, path: str, floor: int, text: str = "text") -> None:
    """`vocab` (one token a line, in order of id) and `report`; nothing is written if no character is admitted."""
    tokens = vocab.require(vocab.build(df, floor, text))
    tokens.orderBy("id").coalesce(1).select("token").write.mode("errorifexists").text(f"{path}/vocab")
    vocab.report(df, floor, text).write.mode("errorifexists").json(f"{path}/report")


def write_export(readings: DataFrame, request: export.Request, page: np.ndarray, path: str) -> None:
    """Crops, records, a report of every rejection, and a manifest whose digest covers all records, for one page.

    Crops are rows (key, png) of a table, so that a corpus doesn't become as many files; their keys are the paths that the
    records name. A crop that occurs twice is an error before any record is written.
    """
    request.check()
    judged = export.reasons(readings, request, page.shape[1], page.shape[0])
    where = export.records(judged, request).select(F.col("crop_name").alias("key"), "crop.*")
    cut = images.crops_of(where, page)
    cut.write.mode("errorifexists").parquet(f"{path}/crops")
    digests = readings.sparkSession.read.parquet(f"{path}/crops").select(F.col("key").alias("crop_name"), F.concat(F.lit("sha256:"), F.sha2("png", 256)).alias("crop_digest"))
    named = export.named(judged).join(digests, "crop_name", "left").withColumn("page_id", F.lit(0))
    manifest = export.manifests(named, request, "page_id", F.col("crop_digest"))
    manifest.select("pairs", "manifest", "manifest_digest").write.mode("errorifexists").json(f"{path}/manifest")
    export.records(judged, request).select("record_name", "record", "record_digest").write.mode("errorifexists").json(f"{path}/records")
    export.report(judged).write.mode("errorifexists").json(f"{path}/report")


def write_detection_set(pages: DataFrame, path: str, valid: Column) -> None:
    """Detection samples that satisfy `valid`, and a summary by enclosure; one that doesn't is an error before any write."""
    bad = pages.filter(~valid).limit(1).collect()
    if bad:
        raise ValueError(f"page {bad[0]['page_id']} doesn't satisfy the schema")
    samples = pages.select("page_id", F.struct("width", "height", F.concat(F.lit("sha256:"), F.sha2("pixels", 256)).alias("digest")).alias("page"), "panels", "regions")
    write_json(samples, f"{path}/samples")
    kinds = pages.select(F.explode("regions").alias("r")).groupBy(F.col("r.kind").alias("enclosure")).agg(F.count(F.lit(1)).alias("n"))
    write_json(kinds, f"{path}/summary")


def page_results(readings: DataFrame) -> DataFrame:
    """One nested result a page: regions in order, text joined by line breaks, mean confidence (null if nothing is scored),
    and, where readings have `duration_ms`, their sum rounded to 2 digits."""
    item = F.struct("idx", "text", "confidence")
    timed = [F.round(F.sum("duration_ms"), 2).alias("duration_ms")] if "duration_ms" in readings.columns else []
    out = readings.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("regions"), F.round(F.avg("confidence"), 4).alias("confidence"), *timed)
    return out.select("page_id", "regions", F.array_join(F.col("regions.text"), "\n").alias("text"), "confidence", *(["duration_ms"] if timed else []))
