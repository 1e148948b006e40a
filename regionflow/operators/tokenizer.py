"""WordPiece decoding by joins with a vocabulary table (id, token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.functions.text import wordpiece_text
from regionflow.operators.vocab import SPECIALS

#: Vocabularies up to this many tokens are broadcast; a larger one is joined by shuffle.
BROADCAST_TOKENS = 500_000


def _small(vocabulary: DataFrame) -> DataFrame:
    return F.broadcast(vocabulary) if vocabulary.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS else vocabulary


def is_special(token: Column) -> Column:
    return token.isin(*SPECIALS)


def _tokens(df: DataFrame, vocabulary: DataFrame, key: str, ids: str, strict: bool, skip_special: bool) -> DataFrame:
    parts = df.select(key, F.posexplode(ids).alias("pos", "id"))
    joined = parts.join(_small(vocabulary), "id", "left" if strict else "inner")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no token has id "), F.col("id").cast("string"))).cast("string")
        joined = joined.withColumn("token", F.coalesce("token", missing))
    return joined.filter(~is_special(F.col("token"))) if skip_special else joined


def decode(df: DataFrame, vocabulary: DataFrame, key: str = "doc_id", ids: str = "ids", strict: bool = False, skip_special: bool = True) -> DataFrame:
    """(key, text): tokens in order, continuations joined, no spaces. Ids without a token are dropped, or an error if strict."""
    rows = _tokens(df, vocabulary, key, ids, strict, skip_special).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    found = rows.select(key, wordpiece_text(F.col("t.token")).alias("text"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def words(df: DataFrame, vocabulary: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, word, text): a token without the continuation mark begins a word, and so does the first one."""
    order = Window.partitionBy(key).orderBy("pos")
    tokens = _tokens(df, vocabulary, key, ids, False, True)
    starts = (~F.startswith("token", F.lit("##")) | (F.row_number().over(order) == 1)).cast("long")
    marked = tokens.withColumn("start", starts).withColumn("word", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy(key, "word").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return grouped.select(key, "word", wordpiece_text(F.col("t.token")).alias("text"))


def tensor_layers(names: DataFrame, name: str = "name") -> DataFrame:
    """One row: layers that cache tensor names speak of, as highest index + 1 (0 without any)."""
    layer = F.regexp_extract(name, r"(?:past_key_values|present)\.(\d+)\.", 1)
    return names.agg(F.coalesce(F.max(F.when(layer != "", layer.cast("long"))) + 1, F.lit(0)).cast("long").alias("layers"))
