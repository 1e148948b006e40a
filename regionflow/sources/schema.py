"""Schemas of the documents that the engine reads, and JSON Schema rules as Column predicates."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allowed words of the document model.
ENUMS = {
    "state": ("candidate", "accepted", "verified", "rejected"),
    "region_kind": ("text", "speech_bubble", "panel", "badge", "sound_effect"),
    "dataset_class": ("silver", "gold", "evaluation"),
    "split": ("train", "validation", "test"),
    "writing_mode": ("horizontal-tb", "vertical-rl", "vertical-lr"),
    "provenance_source": ("ocr", "vision", "geometry", "metadata", "language_model", "human", "fixture"),
    "validation_status": ("confirmed", "unverified", "ambiguous", "contradicted"),
    "resolution": ("resolved", "unresolved", "human-review-required"),
    "enclosure": ("balloon", "caption-box", "none"),
}

RECT = "struct<x: double, y: double, width: double, height: double>"
DUAL = f"struct<px: {RECT}, normalized: {RECT}>"
READING = "struct<region_id: string, text: string, confidence: double, normalized_bounds: array<double>, kind: string, state: string, empty_is_intentional: boolean>"
TEXT_LAYER = f"id string, language string, kind string, regions array<{READING}>"
LABEL = "text string, empty_is_intentional boolean, provenance struct<state: string, confidence: double>"
LEDGER = "filename string, size_bytes bigint, status string, expected_text string, label_kind string, actual_text string, cer_divergence double, confidence double, duration_ms double"
SCENE = (
    "id string, metadata struct<title: string, series: string, volume: string, chapter: string>, "
    f"pages array<struct<id: string, pageNumber: int, panels: array<struct<id: string, logicalOrder: int, frame: struct<bounds: {DUAL}>>>, "
    f"containers: array<struct<id: string, panelId: string, type: string, geometry: struct<bounds: {DUAL}>>>, "
    f"text_regions: array<struct<id: string, panelId: string, containerId: string, role: string, translation: struct<displayText: string>, geometry: struct<bounds: {DUAL}>, logicalOrder: int>>, "
    f"art_regions: array<struct<id: string, panelId: string, role: string, protection: string, penalty: double, bounds: {DUAL}>>>>"
)

Rule = Callable[[Column], Column]


def in_enum(value: Column, name: str) -> Column:
    return value.isin(*ENUMS[name])


def conforms(schema: dict[str, Any], value: Callable[[str], Column], keys: Column | None = None) -> Column:
    """Does a row satisfy a JSON Schema of an object? `value` gives the column of a property.

    Understood: required, properties with enum, const, minimum, maximum, exclusive bounds, minLength, pattern,
    items, nested objects, and if/then. A property that is null counts as absent. Where additionalProperties is false,
    `keys`, the names that the object has, may hold only names of properties.
    """
    rules = [value(name).isNotNull() for name in schema.get("required", ())]
    for name, sub in schema.get("properties", {}).items():
        try:
            column = value(name)
        except KeyError:
            continue
        rules.append(column.isNull() | _value(sub, column))
    for branch in schema.get("allOf", ()) if "if" not in schema else (schema, *schema.get("allOf", ())):
        if "if" in branch and "then" in branch:
            rules.append(~conforms(branch["if"], value) | conforms(branch["then"], value))
    if schema.get("additionalProperties") is False and keys is not None:
        known = F.array(*(F.lit(n) for n in schema.get("properties", {}))) if schema.get("properties") else F.array().cast("array<string>")
        rules.append(F.size(F.array_except(keys, known)) == 0)
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(False))
    return out


def _value(schema: dict[str, Any], column: Column) -> Column:
    rules: list[Column] = []
    if "enum" in schema:
        rules.append(column.isin(*[v for v in schema["enum"] if v is not None]))
    if "const" in schema:
        rules.append(column == F.lit(schema["const"]))
    for name, rule in (("minimum", column.__ge__), ("maximum", column.__le__), ("exclusiveMinimum", column.__gt__), ("exclusiveMaximum", column.__lt__)):
        if name in schema:
            rules.append(rule(schema[name]))
    if "minLength" in schema:
        rules.append(F.length(column) >= schema["minLength"])
    if "pattern" in schema:
        rules.append(column.rlike(schema["pattern"]))
    if "minItems" in schema:
        rules.append(F.size(column) >= schema["minItems"])
    if "maxItems" in schema:
        rules.append(F.size(column) <= schema["maxItems"])
    if isinstance(schema.get("items"), dict):
        rules.append(F.forall(column, lambda x: _value(schema["items"], x)))
    if "properties" in schema or "required" in schema:
        rules.append(conforms(schema, lambda name: column[name]))
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(False))
    return out
