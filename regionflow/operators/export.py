"""Training pairs out of region readings: admission, counters, records, manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.functions import canonical as c
from regionflow.functions import geometry as g
from regionflow.functions.numeric import settled
from regionflow.functions.text import digest, pair_name

# What the dataset classes admit, and the words that a request may use.
ADMITTED = {"silver": ("candidate",), "gold": ("accepted", "verified"), "evaluation": ("verified",)}
SPLITS = {"silver": ("train", "validation"), "gold": ("train", "validation"), "evaluation": ("test",)}
REASONS = ("rejected", "too_small", "no_geometry", "low_confidence", "missing_confidence", "empty_label", "wrong_class")
DIRECTIONS, SOURCES, LANGUAGES = ("ttb", "ltr", "rtl"), ("own-corpus", "manga109s", "synthetic"), ("ja", "en")


@dataclass(frozen=True)
class Request:
    dataset_class: str = "gold"
    split: str = "train"
    min_confidence: float = 0.0
    min_crop_px: int = 8
    language: str | None = None
    direction: str = "ttb"
    source: str = "own-corpus"
    publication_id: str = "publication"
    item_id: str = "item"
    page_digest: str = "page"
    envelope_digest: str = "envelope"
    rights_grant_id: str = "grant"
    split_group: str = "group"
    reviewed_by: str | None = None

    def check(self) -> Request:
        """Raise ValueError unless the request can be honoured."""
        if not 0.0 <= self.min_confidence <= 1.0:
            raise ValueError("min_confidence must lie between 0 and 1")
        if self.min_crop_px <= 0:
            raise ValueError("min_crop_px must be positive")
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}")
        if self.source not in SOURCES:
            raise ValueError(f"source must be one of {SOURCES}")
        for name in ("publication_id", "item_id", "page_digest", "envelope_digest", "rights_grant_id", "split_group"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} must not be blank")
        if self.split not in SPLITS.get(self.dataset_class, ()):
            raise ValueError(f"{self.dataset_class} doesn't go with {self.split}")
        if self.dataset_class != "silver" and self.reviewed_by is None:
            raise ValueError("gold and evaluation need reviewed_by")
        return self


def reasons(readings: DataFrame, request: Request, width: int, height: int) -> DataFrame:
    """readings with `crop` and `reason`: the first rule that rejects a row, or kept. A language filter leaves rows out
    unseen; a language that isn't allowed is an error."""
    allowed = F.when(F.col("language").isin(*LANGUAGES), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("language "), F.coalesce("language", F.lit("null")))).cast("boolean"))
    rows = readings.filter(allowed)
    if request.language:
        rows = rows.filter(F.col("language") == request.language)
    rows = rows.withColumn("crop", g.crop(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(width), F.lit(height)))
    state, small = F.col("state"), request.min_crop_px
    rules = [
        ("rejected", state == "rejected"),
        ("wrong_class", ~state.isin(*ADMITTED[request.dataset_class])),
        ("empty_label", (F.coalesce(F.col("text"), F.lit("")) == "") & ~F.col("intentional")),
        ("missing_confidence", ~settled(F.col("confidence"))),
        ("low_confidence", F.col("confidence") < request.min_confidence),
        ("no_geometry", F.col("crop").isNull()),
        ("too_small", (F.col("crop.w") < small) | (F.col("crop.h") < small)),
    ]
    reason: Column = F.lit("kept")
    for name, rule in reversed(rules):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason)


def report(judged: DataFrame, *by: str) -> DataFrame:
    """One row of counters, or one for each value of `by`. A candidate of the wrong class counts in skipped_candidate as well."""
    return judged.groupBy(*by).agg(
        F.count_if(F.col("reason") == "kept").alias("pairs_written"),
        F.count_if((F.col("reason") == "wrong_class") & (F.col("state") == "candidate")).alias("skipped_candidate"),
        *(F.count_if(F.col("reason") == n).alias(f"skipped_{n}") for n in REASONS),
    )


def _facts(df: DataFrame, request: Request) -> dict[str, Column]:
    """Facts of the source as JSON: the frame's column of that name if there is one, else the request's value."""
    names = ("envelope_digest", "item_id", "page_digest", "publication_id")
    return {n: c.string(F.col(n).cast("string")) if n in df.columns else c.literal(getattr(request, n)) for n in names}


def named(judged: DataFrame) -> DataFrame:
    """judged with crop_name and record_name, by text layer (column `layer`, else 0) and region."""
    stem = pair_name(F.col("layer") if "layer" in judged.columns else F.lit(0), F.col("region_id"))
    return judged.withColumns({"crop_name": F.concat(F.lit("crops/"), stem, F.lit(".png")), "record_name": F.concat(stem, F.lit(".json"))})


def records(judged: DataFrame, request: Request) -> DataFrame:
    """(judged's columns, crop_name, record_name, record, record_digest): kept rows as canonical JSON.

    `reviewed_by` is left out where there is none.
    """
    kept = named(judged.filter("reason = 'kept'"))
    kept = kept.withColumn("_numbers", c.numbers(F.col("confidence"), F.col("l"), F.col("t"), F.col("r"), F.col("b")))
    shown = dict(zip(("confidence", "l", "t", "r", "b"), (F.get("_numbers", F.lit(k)) for k in range(5)), strict=True))
    corners = (c.record({"x": shown[x], "y": shown[y]}) for x, y in ("lt", "rt", "rb", "lb"))
    provenance = _facts(kept, request) | {"confidence": shown["confidence"], "region_id": c.string(F.col("region_id").cast("string")), "state": c.string(F.col("state"))}
    if request.reviewed_by is not None:
        provenance["reviewed_by"] = c.literal(request.reviewed_by)
    body = {
        "crop": c.string(F.col("crop_name")), "direction": c.literal(request.direction), "empty_is_intentional": c.boolean(F.col("intentional")),
        "geometry": c.record({"normalized_bounds": c.array(F.array(*corners))}), "language": c.string(F.col("language")), "provenance": c.record(provenance),
        "source": c.literal(request.source), "text": c.string(F.coalesce("text", F.lit(""))),
    }
    return kept.withColumn("record", c.record(body)).drop("_numbers").withColumn("record_digest", digest(F.col("record")))


def manifests(judged: DataFrame, request: Request, by: str, crop_digest: Column) -> DataFrame:
    """(by, pairs, manifest, manifest_digest): a manifest for each page, whose digest covers it with an empty digest.

    A page is one export, so what a task holds is bounded by the regions of a page, however many pages there are. Two
    pairs of a page with one crop digest are an error. A page of which nothing is kept has a manifest without records.
    """
    facts = [n for n in ("envelope_digest", "item_id", "page_digest", "publication_id") if n in judged.columns]
    made = records(judged.withColumn("crop_digest", crop_digest), request)
    entry = c.record({n: c.string(F.col(f)) for n, f in (("crop", "crop_name"), ("crop_digest", "crop_digest"), ("record", "record_name"), ("record_digest", "record_digest"), ("region_id", "region_text"))})
    listed = made.withColumn("region_text", F.col("region_id").cast("string")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("record_name", entry.alias("entry"), "crop_digest"))).alias("listed"))
    # judged's counters and facts by page come from one aggregate of their own
    pages = report(judged, by, *facts).join(listed, by, "left")
    entries = F.coalesce(F.col("listed.entry"), F.array().cast("array<string>"))
    crops = F.col("listed.crop_digest")
    twice = F.when(F.size(F.array_distinct(crops)) < F.size(crops), F.raise_error(F.concat(F.lit("several pairs share a crop on page "), F.col(by).cast("string"))).cast("string"))
    counters = c.record({n: c.integer(F.col(n)) for n in ("pairs_written", "skipped_candidate", *(f"skipped_{r}" for r in REASONS))})

    def text(signature: Column) -> Column:
        fixed = {n: c.literal(getattr(request, n)) for n in ("dataset_class", "rights_grant_id", "source", "split", "split_group", "reviewed_by")}
        versions = {"policy_version": c.literal("curation-training-v1"), "version": c.literal("1.0")}
        return c.record({**_facts(pages, request), **fixed, **versions, "manifest_digest": c.string(signature), "records": c.array(entries), "report": counters})

    signed = pages.withColumn("manifest_digest", F.coalesce(twice, digest(text(F.lit("")))))
    return signed.select(by, F.col("pairs_written").alias("pairs"), text(F.col("manifest_digest")).alias("manifest"), "manifest_digest")
