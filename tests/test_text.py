from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionflow.functions import text as t


def one(spark, value, function):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("  Hello ,  world !  ", "Hello, world!"), ("It’s  a   test…", "It's a test..."), ("im sure you dont know", "I'm sure you don't know"), ("ITS hes", "it's he's"), ("", ""), ("a . b", "a. b"), ("x　y", "x y")],
)
def test_english(spark, value, want):
    assert one(spark, value, t.normalize_en) == want


@pytest.mark.parametrize(("value", "want"), [("…", "．．．"), ("テスト 123", "テスト　１２３"), ("Hello!", "Ｈｅｌｌｏ！"), ("  a　", "ａ")])
def test_japanese(spark, value, want):
    assert one(spark, value, t.normalize_ja) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("漢(かん)字(じ)", "漢[かん]字[じ]"), ("漢字【かんじ】x", "漢字[かんじ]ｘ"), ("漢（a b]!", "漢[a b]！"), ("漢(かん", "漢(かん"), ("(a)漢", "（ａ）漢"), ("漢()", "漢[]"), ("漢漢(", "漢漢("), ("", "")],
)
def test_furigana(spark, value, want):
    assert one(spark, value, t.furigana) == want


@pytest.mark.parametrize(("value", "want"), [("RTL", "right-to-left"), (" Left_To_Right ", "left-to-right"), ("vertical-rl", "right-to-left"), ("top_to_bottom", None), ("", None)])
def test_direction(spark, value, want):
    assert one(spark, value, t.reading_direction) == want


def test_an_unknown_writing_mode_is_an_error(spark):
    assert one(spark, "vertical-rl", t.text_direction) == "ttb"
    with pytest.raises(Exception, match="no text direction"):
        one(spark, "sideways", t.text_direction)


@pytest.mark.parametrize(
    ("expected", "actual", "cer", "divergence"),
    [("こんにちは", "こんばんは", 0.4, 0.4), ("", "", 0.0, 0.0), ("", "x", 1.0, 1.0), ("ab", "abcd", 1.0, 0.5), ("abc", "abc", 0.0, 0.0)],
)
def test_error_rates(spark, expected, actual, cer, divergence):
    row = spark.createDataFrame([(expected, actual)], "e string, a string").select(t.cer(F.col("e"), F.col("a")), t.divergence(F.col("e"), F.col("a"))).first()
    assert tuple(row) == (pytest.approx(cer), pytest.approx(divergence))


@pytest.mark.parametrize(("actual", "want"), [("abc", "exact"), ("abcd", "OVERRUN"), ("ab", "misread")])
def test_verdict(spark, actual, want):
    assert one(spark, actual, lambda v: t.verdict(F.lit("abc"), v)) == want


def test_counts(spark):
    assert one(spark, "a b　c\n", t.visible_length) == 3
    assert one(spark, "zebra zoo 猫", lambda v: t.uncovered(v, F.lit("ebra"))) == ["z", "o", "猫"]
    assert one(spark, "漢", t.is_kanji) and not one(spark, "か", t.is_kanji)
    assert one(spark, "x", t.digest).startswith("sha256:2d711642")
