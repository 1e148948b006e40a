"""Ensembles of recognisers: weighted confidence, choice and disagreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.functions.numeric import brier_weight
from regionflow.functions.text import divergence

# Fixed value: the Brier score of an engine that has none.
DEFAULT_BRIER = 0.10


def decide(candidates: DataFrame, valid: float = 0.70, review: float = 0.20, key: str = "region_id") -> DataFrame:
    """A row for each region of (region, engine, answer, confidence, brier).

    The most confident answer wins, ties by engine order. Divergence compares the first two answers in that
    order; it is null with fewer than two. Failed engines have null confidence and don't count.
    """
    c = candidates.filter("confidence is not null").withColumn("weight", brier_weight(F.coalesce("brier", F.lit(DEFAULT_BRIER))))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("cost"), "engine", "answer")))
    out = c.groupBy(key).agg(ranked.alias("r"), (F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("weighted"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    apart = divergence(first["answer"], second["answer"])
    return out.select(
        key, first["answer"].alias("selected_text"), (-first["cost"]).alias("confidence"), F.col("weighted").alias("weighted_confidence"),
        (F.col("weighted") >= valid).alias("is_validated"), apart.alias("divergence"), F.coalesce(apart >= review, F.lit(False)).alias("needs_review"),
    )
