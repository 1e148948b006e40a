"""Steps of beam search and checks of token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.functions.numeric import beam_score, log_softmax


def top_logprobs(df: DataFrame, k: int, banned: Column | None = None, key: str = "vec_id", logits: str = "logits") -> DataFrame:
    """(key, rank, token, logprob): the k best tokens that aren't banned; the normaliser covers all. Ties by token."""
    scored = F.transform(log_softmax(F.col(logits)), lambda lp, i: F.struct((-lp).alias("cost"), i.cast("long").alias("token")))
    if banned is not None:
        scored = F.filter(scored, lambda s: ~F.array_contains(banned, s["token"]))
    best = df.select(key, F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("rank", "s"))
    return best.select(key, (F.col("rank") + 1).cast("long").alias("rank"), F.col("s.token").alias("token"), (-F.col("s.cost")).alias("logprob"))


def select_beams(beams: DataFrame, candidates: DataFrame, width: int, end: int, key: str = "vec_id") -> DataFrame:
    """Next beams (key, beam, tokens, logprob, finished): live beams extended, finished ones carried, the best `width` kept.

    Ties go to extensions in input order, then to carried beams. Candidates: (key, pos, beam, token, logprob).
    """
    c = candidates.withColumnRenamed("logprob", "gain")
    extended = beams.filter("not finished").join(c, [key, "beam"]).select(key, F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"), F.concat("tokens", F.array(F.col("token"))).alias("tokens"), (F.col("logprob") + F.col("gain")).alias("logprob"), (F.col("token") == end).alias("finished"))
    carried = beams.filter("finished").select(key, F.lit(1).alias("kind"), F.col("beam").cast("long").alias("pos"), "tokens", "logprob", "finished")
    order = Window.partitionBy(key).orderBy(F.col("logprob").desc(), "kind", "pos")
    ranked = extended.unionByName(carried).withColumn("beam", (F.row_number().over(order) - 1).cast("long"))
    return ranked.filter(F.col("beam") < max(width, 1)).select(key, "beam", "tokens", "logprob", "finished")


def best_beam(beams: DataFrame, penalty: float = 2.0, key: str = "vec_id") -> DataFrame:
    """(key, beam, score): the best length-penalised beam, the last one of equals."""
    score = beam_score(F.col("logprob"), F.size("tokens"), penalty)
    return beams.groupBy(key).agg(F.max(F.struct(score.alias("score"), "beam")).alias("m")).select(key, F.col("m.beam").alias("beam"), F.col("m.score").alias("score"))


def rolling(df: DataFrame, key: str, order: list[str], value: str, size: int = 4, below: float = 0.15) -> DataFrame:
    """df with `mean` of the last `size` values (null before there are as many) and `truncate` where it is below."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    mean = F.when(F.count(value).over(w) == size, F.avg(value).over(w))
    return df.withColumn("mean", mean).withColumn("truncate", F.coalesce(F.col("mean") < below, F.lit(False)))


def stopped(beams: DataFrame, step: int, most: int) -> bool:
    """Is every beam finished, or the cap reached?"""
    return step >= most or (not beams.isEmpty() and beams.filter("not finished").isEmpty())


def parents(beams: DataFrame, before: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, beam, parent): the first earlier beam that a beam extends by one token, 0 if there is none."""
    old = before.select(F.col(key).alias("k"), F.col("beam").alias("b"), F.col("tokens").alias("head"))
    extends = (F.col(key) == F.col("k")) & (F.size("tokens") == F.size("head") + 1) & (F.slice("tokens", 1, F.size("head")) == F.col("head"))
    return beams.join(old, extends, "left").groupBy(key, "beam").agg(F.coalesce(F.min("b"), F.lit(0)).cast("long").alias("parent"))
