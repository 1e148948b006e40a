"""A corpus pipeline of five stages: quality, near duplicates, repeated passages, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm import bpe, mixing, ngram_join, quality, suffixes
from regionflow.llm.common import drop_folder, new_folder, small_batches, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more."""
    small_batches(spark)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col(scored.columns[-1]) >= 0.3).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of 5-word shingles: that with the smallest id.

    Where a group's smallest id has several texts, or the group no id, the text with the smallest hash stays. Texts of
    one id in different groups all stay.
    """
    first = ngram_join.firsts(docs, ngram_join.Rule(5, (80, 100))).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.withColumn("_own", ngram_join.text_hash("text"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; documents that lose everything go."""
    clean = suffixes.cleaned(docs).filter(~F.col("emptied"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix begins them."""
    placed = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.explode("positions").alias("_position"))
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("_own", own).dropDuplicates(["doc_id", "_own"])
    taken = rows.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    each = taken.select(*docs.columns, "_position")
    return mixing.stream(each, position_col="_position").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes that they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again; a table goes once the next one is written.

    Rows with null ids, texts or sources take part as the stages say: a null text counts as empty, scores as such, is
    near nothing and is never taken by the mix, as it has no words. An empty table gives no rows.
    """
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                drop_folder(spark, f"{folder}/{i - 1}")
    return docs
