"""Synthetic pages: panels, placed regions and drawn boxes from hashes of a seed, the same on any number of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.functions.numeric import uniform

#: Ranges of scan defects by quality: JPEG quality, rotation in degrees, blur and noise.
SCANS = {"typical": ((55, 92), (-1.5, 1.5), (0.0, 0.9), (0.0, 6.0)), "poor": ((22, 55), (-4.0, 4.0), (0.8, 2.2), (6.0, 22.0))}

KINDS = ("balloon", "caption-box", "none")


def scan_defects(seed: Column, quality: str = "typical") -> list[Column]:
    """Four columns drawn for each seed: jpeg_quality, rotate_deg, blur_sigma, noise_sd."""
    jpeg, *rest = (uniform(seed, i, low, high + (i == 0)) for i, (low, high) in enumerate(SCANS[quality]))
    return [F.floor(jpeg).alias("jpeg_quality"), *(c.alias(n) for c, n in zip(rest, ("rotate_deg", "blur_sigma", "noise_sd"), strict=True))]


def layout(seed: int, page_id: int, regions: int, size: tuple[int, int] = (400, 560), pad: int = 6) -> tuple[list[tuple], list[tuple]]:
    """Panels (x, y, w, h), split largest first, and regions (x, y, w, h, kind, panel) that don't touch."""
    rng = np.random.default_rng([seed, page_id])
    panels = [(0, 0, *size)]
    for _ in range(int(rng.integers(1, 6))):
        panels.sort(key=lambda p: -p[2] * p[3])
        x, y, w, h = panels.pop(0)
        share = rng.uniform(0.35, 0.65)
        if h >= w:
            cut = int(h * share)
            panels += [(x, y, w, cut), (x, y + cut, w, h - cut)]
        else:
            cut = int(w * share)
            panels += [(x, y, cut, h), (x + cut, y, w - cut, h)]
    panels.sort(key=lambda p: (p[1], p[0]))
    placed: list[tuple] = []
    for _ in range(40 * regions):
        if len(placed) == regions:
            break
        w, h = int(rng.integers(14, 60)), int(rng.integers(14, 60))
        x, y = int(rng.integers(8, size[0] - w - 8)), int(rng.integers(8, size[1] - h - 8))
        if any(x - pad < a + c and a < x + w + pad and y - pad < b + d and b < y + h + pad for a, b, c, d, *_ in placed):
            continue
        cx, cy = x + w // 2, y + h // 2
        panel = next((i for i, (a, b, c, d) in enumerate(panels) if a <= cx < a + c and b <= cy < b + d), None)
        placed.append((x, y, w, h, KINDS[int(rng.integers(0, 3))], panel))
    return panels, placed


def draw(regions: list[tuple], size: tuple[int, int] = (400, 560), seed: int = 0) -> np.ndarray:
    """A page of strokes where the regions are."""
    page = np.full((size[1], size[0]), 240, np.uint8)
    rng = np.random.default_rng(seed)
    for x, y, w, h, *_ in regions:
        for row in range(y, y + h, 4):
            page[row : row + 2, x : x + w][:, rng.random(w) < 0.8] = 20
        page[y, x] = page[y + h - 1, x + w - 1] = 20
        page[y, x : x + w : 2] = page[y + h - 1, x : x + w : 2] = 20
        page[y : y + h : 2, x] = page[y : y + h : 2, x + w - 1] = 20
    return page


def pages(spark: SparkSession, count: int, regions: int = 8, seed: int = 1) -> DataFrame:
    """(page_id, width, height, pixels, regions array<struct>, panels array<struct>), `count` of them."""
    box = "x: bigint, y: bigint, w: bigint, h: bigint"

    def run(batches):
        for batch in batches:
            for page_id in batch.column(0).to_pylist():
                panels, placed = layout(seed, page_id, regions)
                page = draw(placed, seed=page_id)
                region_rows = [dict(zip(("x", "y", "w", "h", "kind", "panel"), r, strict=True)) for r in placed]
                panel_rows = [dict(zip("xywh", p, strict=True)) for p in panels]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([*((c, pa.int64()) for c in "xywh"), ("kind", pa.string()), ("panel", pa.int64())])), pa.list_(pa.struct([(c, pa.int64()) for c in "xywh"]))]
                values = ([page_id], [page.shape[1]], [page.shape[0]], [page.tobytes()], [region_rows], [panel_rows])
                yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["page_id", "width", "height", "pixels", "regions", "panels"])

    return spark.range(count).mapInArrow(run, f"page_id bigint, width bigint, height bigint, pixels binary, regions array<struct<{box}, kind: string, panel: bigint>>, panels array<struct<{box}>>")
