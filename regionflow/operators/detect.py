"""Regions on grey pages: thresholds, a grid of active cells, and connected components.

A page is rows (page_id, x, y, v). Whole-image steps on decoded pages are numpy kernels behind a table function.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the grid detector.
GRID, DARKER, BRIGHTER, ACTIVE, LEAST_AREA, MOST_SHARE = 32, 25, 60, 0.08, 400, 0.85


def mean_level(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("page_id").agg(F.floor(F.sum("v") / F.count(F.lit(1))).alias("mean"))


def ink_coverage(pixels: DataFrame, below: int = 128) -> DataFrame:
    """(page_id, ink): the share of dark pixels."""
    return pixels.groupBy("page_id").agg(F.avg((F.col("v") < below).cast("int")).alias("ink"))


def histogram(pixels: DataFrame) -> DataFrame:
    """(page_id, v, n): at most 256 rows a page."""
    return pixels.groupBy("page_id", "v").agg(F.count(F.lit(1)).alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(page_id, level): the level that best parts its histogram in two, the first of equals."""
    up = Window.partitionBy("page_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("page_id")
    h = histogram(pixels).withColumn("weighted", F.col("n") * F.col("v"))
    h = h.select("page_id", "v", F.sum("n").over(up).alias("w0"), F.sum("weighted").over(up).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum("weighted").over(whole).alias("s"))
    w1, gap = F.col("w") - F.col("w0"), F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("s") - F.col("s0"), F.col("w") - F.col("w0"))
    between = F.round(F.col("w0").cast("double") * w1 * gap * gap, 3)
    return h.groupBy("page_id").agg(F.max(F.struct(F.coalesce(between, F.lit(-1.0)).alias("b"), (-F.col("v")).alias("v"))).alias("m")).select("page_id", (-F.col("m.v")).alias("level"))


def ground(pixels: DataFrame) -> DataFrame:
    """(page_id, ground): the most frequent bright level, the highest of equals; null without any."""
    return histogram(pixels).groupBy("page_id").agg(F.max(F.when(F.col("v") >= 128, F.struct("n", "v"))).alias("m")).select("page_id", F.col("m.v").alias("ground"))


def _sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("page_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.floor(F.sum("v") / F.count(F.lit(1))).alias("mean"))


def active_cells(pixels: DataFrame, grid: int = GRID) -> DataFrame:
    """(page_id, gx, gy) of cells where more than 8 % of the pixels stand out from the mean, and the page's cell size."""
    joined = pixels.join(_sizes(pixels), "page_id")
    cw, ch = F.ceil(F.col("width") / grid), F.ceil(F.col("height") / grid)
    out = (F.col("v") < F.greatest(F.col("mean") - DARKER, F.lit(0))) | (F.col("v") > F.least(F.col("mean") + BRIGHTER, F.lit(255)))
    cells = joined.groupBy("page_id", F.floor(F.col("x") / cw).alias("gx"), F.floor(F.col("y") / ch).alias("gy"), "width", "height").agg(F.avg(out.cast("int")).alias("share"))
    return cells.filter(F.col("share") > ACTIVE).select("page_id", "gx", "gy", "width", "height")


def components(cells: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Bounds (x0, y0, x1, y1) of 8-neighbour components, in order of their first cell by row."""
    left, out = set(cells), []
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start not in left:
            continue
        left.discard(start)
        todo, xs, ys = deque([start]), [], []
        while todo:
            x, y = todo.popleft()
            xs.append(x)
            ys.append(y)
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo.extend(near)
        out.append((min(xs), min(ys), max(xs), max(ys)))
    return out


def grid_components(cells: DataFrame) -> DataFrame:
    """(page_id, component, x0, y0, x1, y1, width, height) of active cells. A page has at most GRID squared of them."""

    def run(pdf):
        import pandas as pd

        found = components(set(zip(pdf["gx"].tolist(), pdf["gy"].tolist(), strict=True)))
        rows = [(pdf["page_id"].iloc[0], i, *b, pdf["width"].iloc[0], pdf["height"].iloc[0]) for i, b in enumerate(found)]
        return pd.DataFrame(rows, columns=["page_id", "component", "x0", "y0", "x1", "y1", "width", "height"])

    return cells.groupBy("page_id").applyInPandas(run, "page_id bigint, component bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, width bigint, height bigint")


def grid_regions(pixels: DataFrame, grid: int = GRID) -> DataFrame:
    """(page_id, x, y, w, h, place): component boxes in pixels that are neither noise nor the page, in reading order; the
    whole page where there is none."""
    c = grid_components(active_cells(pixels, grid))
    cw, ch = F.ceil(F.col("width") / grid), F.ceil(F.col("height") / grid)
    x, y = F.col("x0") * cw, F.col("y0") * ch
    boxes = c.select("page_id", x.alias("x"), y.alias("y"), (F.least((F.col("x1") + 1) * cw, F.col("width")) - x).alias("w"), (F.least((F.col("y1") + 1) * ch, F.col("height")) - y).alias("h"), (F.col("width") * F.col("height")).alias("page"))
    kept = boxes.filter((F.col("w") * F.col("h") > LEAST_AREA) & (F.col("w") * F.col("h") < MOST_SHARE * F.col("page")))
    kept = kept.select("page_id", "x", "y", "w", "h")
    none = F.lit(0).cast("long")
    bare = _sizes(pixels).join(kept.select("page_id").distinct(), "page_id", "left_anti")
    kept = kept.unionByName(bare.select("page_id", none.alias("x"), none.alias("y"), F.col("width").alias("w"), F.col("height").alias("h")))
    order = Window.partitionBy("page_id").orderBy(F.floor(F.col("y") / 200), F.col("x").desc(), "y", "w", "h")
    return kept.select("page_id", "x", "y", "w", "h", F.row_number().over(order).cast("long").alias("place"))


# --- kernels over a decoded page -------------------------------------------------------------------------


def dilate(mask: np.ndarray, rx: int, ry: int) -> np.ndarray:
    """Grow a mask by a rectangle: a running maximum along x, then along y."""
    out = mask.copy()
    for axis, r in ((1, rx), (0, ry)):
        base = out.copy()
        for k in range(1, r + 1):
            ahead, back = [slice(None)] * 2, [slice(None)] * 2
            ahead[axis], back[axis] = slice(k, None), slice(None, -k)
            out[tuple(ahead)] |= base[tuple(back)]
            out[tuple(back)] |= base[tuple(ahead)]
    return out


def label(mask: np.ndarray) -> np.ndarray:
    """8-neighbour component numbers from 1: smallest labels spread until nothing changes."""
    n = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        padded = np.pad(np.where(mask, n, big), 1, constant_values=big)
        least = np.min([padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, least, 0)
        new = np.where(mask, np.minimum(new, np.concatenate([[0], n.ravel()])[new]), 0)
        if (new == n).all():
            return np.unique(n, return_inverse=True)[1].reshape(mask.shape) if not mask.all() else np.ones_like(n)
        n = new


def threshold(page: np.ndarray) -> int:
    """Otsu's level of an 8-bit page."""
    h = np.bincount(page.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(h), np.cumsum(h * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2)
    return int(between.argmax())


def bounds(labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last column, first and last row, and number of pixels of the components 1, 2, ..., all in one pass."""
    y, x = np.nonzero(labels)
    of, n = labels[y, x] - 1, int(labels.max(initial=0))
    low = [np.full(n, max(labels.shape)) for _ in range(2)]
    high = [np.full(n, -1) for _ in range(2)]
    for k, place in enumerate((x, y)):
        np.minimum.at(low[k], of, place)
        np.maximum.at(high[k], of, place)
    return low[0], high[0], low[1], high[1], np.bincount(of, minlength=n)


def holding_others(box: np.ndarray) -> np.ndarray:
    """Which of the boxes (x, y, w, h) hold another, different one."""
    low, high = box[:, :2], box[:, :2] + box[:, 2:]
    inside = (low[None] >= low[:, None]).all(2) & (high[None] <= high[:, None]).all(2)
    return (inside & (box[None] != box[:, None]).any(2)).any(1)


def text_boxes(page: np.ndarray, radius: int = 6, least_area: int = 64, most_share: float = 0.5, least_ink: float = 0.0, drop_containers: bool = True, aspect: tuple[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of dark text, ordered by y, then x: components of the grown ink, without what they grew by."""
    grow = np.array(aspect or (radius, radius))
    ink = page <= threshold(page)
    left, right, top, bottom, _ = bounds(label(dilate(ink, *grow)))
    first, last = np.stack([left, top], 1), np.stack([right, bottom], 1)
    box = np.hstack([np.minimum(first + grow, last), np.maximum(last - first - 2 * grow, 1)])
    area = box[:, 2] * box[:, 3]
    sums = np.pad(ink.cumsum(0).cumsum(1), ((1, 0), (1, 0)))  # ink above and to the left
    (x, y), (x_end, y_end) = box[:, :2].T, np.minimum(box[:, :2] + box[:, 2:], page.shape[::-1]).T
    inked = sums[y_end, x_end] - sums[y, x_end] - sums[y_end, x] + sums[y, x]
    box = box[(area >= least_area) & (area <= most_share * page.size) & (inked >= least_ink * area)]
    if drop_containers:
        box = box[~holding_others(box)]
    return [tuple(b) for b in box[np.lexsort((box[:, 0], box[:, 1]))].tolist()]


def enclosures(page: np.ndarray, floor: int = 2000, most_share: float = 0.5, ratio: float = 6.0, thin: float = 0.10) -> list[tuple[int, int, int, int]]:
    """Boxes of components that enclose others: large, holding at least one component six times smaller, thinly inked."""
    left, right, top, bottom, n = bounds(label(page <= threshold(page)))
    w, h = right - left + 1, bottom - top + 1
    size = w * h
    large = np.flatnonzero((floor <= size) & (size <= most_share * page.size) & (n < thin * size))
    inner = (left[large, None] < left) & (top[large, None] < top) & (right[large, None] > right) & (bottom[large, None] > bottom)
    large = large[(inner & (size[large, None] >= ratio * size)).any(1)]
    large = large[np.lexsort((left[large], top[large]))]
    return list(zip(left[large].tolist(), top[large].tolist(), w[large].tolist(), h[large].tolist(), strict=True))


def detect_pages(images: DataFrame, kernel=text_boxes) -> DataFrame:
    """(page_id, place, x, y, w, h) for decoded pages (page_id, width, height, pixels binary); a page at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for page_id, width, height, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw and width and height:
                    page = np.frombuffer(raw, np.uint8).reshape(height, width)
                    rows += [(page_id, i, *b) for i, b in enumerate(kernel(page))]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["page_id", "place", "x", "y", "w", "h"])

    return images.select("page_id", "width", "height", "pixels").mapInArrow(run, "page_id bigint, place bigint, x bigint, y bigint, w bigint, h bigint")
