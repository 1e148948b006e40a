from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from regionflow.llm import queries

OPERATORS = [n for n in queries.QUERIES if n.startswith("op")]

COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"], 2: ["doc_id", "n_shingles", "component_id"], 3: ["doc_id", "held_out", "lang_pred", "score"],
    4: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], 5: ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    6: ["doc_id", "size", "source_size", "target", "taken"], 7: ["page_id", "url", "text", "n_chars"],
    8: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], 9: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], 10: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in OPERATORS) == list(range(1, 11))


def test_clips_cover_all_frames(spark, sf):
    clips = queries.QUERIES["media_clips"](spark, sf).groupBy("doc_id").agg(F.sum("n_frames").alias("n"), F.count("error").alias("bad"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 192))
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", size.alias("n"), F.lit(0).cast("long").alias("bad"))
    assert sorted(map(tuple, clips.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_whole_tables_and_columns(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    n = int(re.match(r"op(\d+)_", name)[1])
    assert out.columns[: len(COLUMNS[n])] == COLUMNS[n]
    source = "pages" if n in (4, 7) else "documents"
    assert out.count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
