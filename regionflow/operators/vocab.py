"""Character vocabularies from transcriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Special tokens, ids from 0.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def _blank(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s", "") == ""


def character_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n) over lines that aren't blank, line breaks left out. Characters are combined before the shuffle."""
    chars = df.filter(~_blank(text)).select(F.explode(F.split(text, "")).alias("ch"))
    return chars.filter(~F.col("ch").isin("", "\n", "\r")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def build(df: DataFrame, floor: int = 1, text: str = "text") -> DataFrame:
    """(id, token): the specials, then admitted characters in code point order. At most a row for each code point."""
    spark = df.sparkSession
    admitted = character_counts(df, text).filter(F.col("n") >= floor)
    rank = F.row_number().over(Window.orderBy("ch"))  # as many rows as there are characters
    specials = spark.createDataFrame(list(enumerate(SPECIALS)), "id bigint, token string")
    return specials.unionByName(admitted.select((rank + len(SPECIALS) - 1).cast("long").alias("id"), F.col("ch").alias("token")))


def report(df: DataFrame, floor: int = 1, text: str = "text") -> DataFrame:
    """One row: distinct, admitted and rare characters, characters scanned, blank lines."""
    counts = character_counts(df, text).agg(
        F.count(F.lit(1)).alias("distinct_characters"),
        F.count_if(F.col("n") >= floor).alias("admitted"),
        F.count_if(F.col("n") < floor).alias("dropped_rare"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("characters_scanned"),
    )
    return counts.crossJoin(df.agg(F.count_if(_blank(text)).alias("empty_lines")))  # one row each


def require(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary, or an error if no character was admitted."""
    if vocabulary.filter(F.col("id") >= len(SPECIALS)).isEmpty():
        raise ValueError("no character reaches the floor; nothing is written")
    return vocabulary
