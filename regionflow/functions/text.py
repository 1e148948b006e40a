"""Text scalars as Column expressions; everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements that results depend on.
CONTRACTIONS = {"im": "I'm", "dont": "don't", "cant": "can't", "wont": "won't", "youre": "you're", "theyre": "they're", "hes": "he's", "shes": "she's", "its": "it's"}
DIRECTIONS = {"rtl": "right-to-left", "right-to-left": "right-to-left", "vertical-rl": "right-to-left", "ltr": "left-to-right", "left-to-right": "left-to-right", "horizontal-tb": "left-to-right"}
WRITING = {"vertical-rl": "ttb", "horizontal-tb": "ltr"}

_ASCII = "".join(map(chr, range(0x21, 0x7F))) + " "
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
_OPEN, _CLOSE = "(（\\[【", ")）\\]】"
_KANJI = "[一-鿿]"


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def full_width(text: Column) -> Column:
    """ASCII to its full-width forms, space included."""
    return F.translate(text, _ASCII, _WIDE)


def normalize_ja(text: Column) -> Column:
    return trim_unicode(full_width(F.replace(text, F.lit("…"), F.lit("..."))))


def furigana(text: Column) -> Column:
    """A kanji and its bracketed reading become kanji[reading]; all else is made full-width.

    The text splits into readings and the stretches between them. A reading that never closes keeps its ASCII
    bracket and raw text.
    """
    dotted = F.replace(text, F.lit("…"), F.lit("..."))
    reading = f"{_KANJI}[{_OPEN}][^{_CLOSE}]*(?:[{_CLOSE}]|$)"
    parts = F.regexp_extract_all(dotted, F.lit(f"({reading}|(?:(?!{_KANJI}[{_OPEN}])[\\s\\S])+)"), F.lit(1))

    def one(part: Column) -> Column:
        kanji = F.substring(part, 1, 1)
        inner = F.regexp_replace(part, f"^{_KANJI}[{_OPEN}]|[{_CLOSE}]$", "")
        closed = F.concat(kanji, F.lit("["), inner, F.lit("]"))
        opened = F.concat(kanji, F.lit("("), inner)
        return F.when(part.rlike(f"^{_KANJI}[{_OPEN}][^{_CLOSE}]*[{_CLOSE}]$"), closed).when(part.rlike(f"^{_KANJI}[{_OPEN}]"), opened).otherwise(full_width(part))

    return trim_unicode(F.array_join(F.transform(parts, one), ""))


def normalize_en(text: Column) -> Column:
    plain = F.translate(F.replace(trim_unicode(text), F.lit("…"), F.lit("...")), "’‘“”", "''\"\"")
    tight = F.regexp_replace(F.regexp_replace(plain, " +", " "), " ([,.!?;:])", "$1")
    words = F.filter(F.split(tight, r"(?U)\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in CONTRACTIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def normalize_by_language(text: Column, language: Column, with_furigana: bool = False) -> Column:
    return F.when(language == "en", normalize_en(text)).otherwise(furigana(text) if with_furigana else normalize_ja(text))


def _mapped(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, to in table.items():
        out = F.when(value == key, F.lit(to)).otherwise(out)
    return out


def reading_direction(declared: Column) -> Column:
    """right-to-left, left-to-right, or null for a spelling that isn't known."""
    return _mapped(F.replace(F.lower(trim_unicode(declared)), F.lit("_"), F.lit("-")), DIRECTIONS)


def text_direction(mode: Column) -> Column:
    """ttb or ltr; any other writing mode is an error."""
    return F.coalesce(_mapped(mode, WRITING), F.raise_error(F.concat(F.lit("no text direction for "), F.coalesce(mode, F.lit("null")))))


def is_kanji(char: Column) -> Column:
    return char.rlike(f"^{_KANJI}$")


def cer(expected: Column, actual: Column) -> Column:
    """Edit distance by the expected length; an empty expectation scores 0 or 1."""
    length = F.length(expected)
    empty = F.when(F.length(actual) == 0, 0.0).otherwise(1.0)
    return F.when(length == 0, empty).otherwise(F.levenshtein(expected, actual) / F.nullif(length, F.lit(0)))


def divergence(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; equal texts 0, two empty ones null."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.nullif(most, F.lit(0)))


def verdict(expected: Column, actual: Column) -> Column:
    return F.when(actual == expected, "exact").when(F.startswith(actual, expected), "OVERRUN").otherwise("misread")


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def uncovered(text: Column, supported: Column) -> Column:
    """Characters that a font lacks, once each, in order of first use."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: (F.length(F.regexp_replace(c, r"(?U)\s", "")) > 0) & ~F.contains(supported, c)))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


# Local paths and what stands for them; {project} is the name of a checkout.
LOCAL_PATHS = (
    (r"file:///[^\s)\"']+/{project}/", ""),
    (r"file:///[^\s)\"']+", ""),
    (r"/Users/[a-zA-Z0-9_\-]+/Projects/{project}/", ""),
    (r"/Users/[a-zA-Z0-9_\-]+/Projects/", "reference/"),
    (r"/Users/[a-zA-Z0-9_\-]+/", "~/"),
)


def clean_path(text: Column, project: str) -> Column:
    """A text without local paths, those of a project made relative to it."""
    for pattern, instead in LOCAL_PATHS:
        text = F.regexp_replace(text, pattern.replace("{project}", re.escape(project)), instead)
    return text


def pair_name(layer: Column, region: Column) -> Column:
    return F.format_string("pair_%04d_%06d", layer, region)


def object_name(ordinal: Column) -> Column:
    return F.format_string("co-%03d", ordinal)


def mask_name(identity: Column) -> Column:
    return F.concat(F.lit("mask-"), identity.cast("string"))


def wordpiece_text(tokens: Column) -> Column:
    """Tokens joined without spaces, continuation marks removed."""
    return F.array_join(F.transform(tokens, lambda t: F.regexp_replace(t, "^##", "")), "")
