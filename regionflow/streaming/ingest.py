"""Readings that arrive as JSON files: the batch expressions over a stream, with counts of every rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regionflow.functions.text import normalize_by_language
from regionflow.operators import export

READING = "region_id bigint, page_id bigint, text string, language string, state string, confidence double, l double, t double, r double, b double, intentional boolean, arrived timestamp"


def readings(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the readings in files that land in folder."""
    return spark.readStream.schema(READING).option("maxFilesPerTrigger", files_at_once).json(folder)


def judged(stream: DataFrame, request: export.Request, size: tuple[int, int]) -> DataFrame:
    """Normalised readings with the reason why each is kept or not; stateless."""
    text = normalize_by_language(F.col("text"), F.col("language"))
    return export.reasons(stream.withColumn("text", text), request, *size).drop("crop")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet in folders by reason, whatever has arrived, then stop. Files are taken exactly once."""
    return stream.writeStream.format("parquet").partitionBy("reason").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def counts(stream: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by window and reason; a window closes once rows that late can no longer come, which bounds the state."""
    timed = stream.withWatermark("arrived", late)
    return timed.groupBy(F.window("arrived", every), "reason").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "reason", "n")
