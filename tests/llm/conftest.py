"""Documents with the cases that every operator has to survive."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 7919} is number {i}" for i in range(30_000))
    prose = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew potions near the old stone bridge at dawn today."
    rows = [
        (1, prose * 3, "en", "a", 10),
        (2, prose * 3, "en", "a", 10),
        (2, prose * 3, "en", "a", 10),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (5, "   \n\t ", "fr", "b", 5),
        (None, "un texte sans numéro pour voir", "fr", "c", 3),
        (None, None, None, None, None),
        (6, "%%% ### 123", "de", "c", 9),
        (7, long, "en", "a", len(long)),
        (8, "é" * 500, "fr", "c", 500),
        (9, "один два три четыре", None, "c", 1),
        (10, "x", "en", "b", 1),
        (11, "ab " * 400, "en", "b", 1200),
        (12, prose * 3 + " One more sentence stands here.", "en", "d", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(hard):
    """Extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "fp", "n", "key", "part", "score", "quality_score", "emptied", "size", "target", "taken", "body", "label", "slot", "gram", "media", "ids", "text_hash", "position", "one", "whole", "start", "digest", "_kept", "capture")
    return hard.withColumns({n: F.lit("clash") for n in names})
