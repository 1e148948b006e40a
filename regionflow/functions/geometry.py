"""Geometry scalars as Column expressions. A box is four columns (x, y, width, height) in pixels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in ("x", "y", "w", "h")))


def area(b: Box) -> Column:
    return b.w.cast("long") * b.h.cast("long")


def intersection(a: Box, b: Box) -> Column:
    across = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    down = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.when((across > 0) & (down > 0), across * down).otherwise(F.lit(0))


def iou(a: Box, b: Box) -> Column:
    common = intersection(a, b)
    return F.coalesce(F.try_divide(common.cast("double"), (area(a) + area(b) - common).cast("double")), F.lit(0.0))


def overlaps(a: Box, b: Box, pad: int = 0) -> Column:
    """Strict overlap, a grown by pad on every side."""
    return (a.x - pad < b.x + b.w) & (b.x < a.x + a.w + pad) & (a.y - pad < b.y + b.h) & (b.y < a.y + a.h + pad)


def contains(outer: Box, inner: Box, strict: bool = False) -> Column:
    if strict:
        return (inner.x > outer.x) & (inner.y > outer.y) & (inner.x + inner.w < outer.x + outer.w) & (inner.y + inner.h < outer.y + outer.h)
    return (inner.x >= outer.x) & (inner.y >= outer.y) & (inner.x + inner.w <= outer.x + outer.w) & (inner.y + inner.h <= outer.y + outer.h)


def _half(x: Column) -> Column:
    return F.floor(x / 2)


def centre_inside(outer: Box, inner: Box) -> Column:
    """Is the integer centre of inner in outer (right and lower edge excluded)?"""
    cx, cy = inner.x + _half(inner.w), inner.y + _half(inner.h)
    return (cx >= outer.x) & (cx < outer.x + outer.w) & (cy >= outer.y) & (cy < outer.y + outer.h)


def union(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.x + a.w, b.x + b.w) - x, F.greatest(a.y + a.h, b.y + b.h) - y)


def normalized(b: Box, width: Column, height: Column) -> Box:
    """Share of the page; 0 where the page has no extent."""
    part = lambda v, whole: F.when(whole > 0, v / F.nullif(whole, F.lit(0))).otherwise(F.lit(0.0))
    return Box(part(b.x, width), part(b.y, height), part(b.w, width), part(b.h, height))


def polygon_area(points: Column) -> Column:
    """Area of array<struct<x,y>>; under three points 0."""
    n = F.size(points)
    at = lambda i, c: F.get(points, i)[c]
    cross = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: at(i, "x") * at((i + 1) % n, "y") - at((i + 1) % n, "x") * at(i, "y"))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def in_polygon(points: Column, px: Column, py: Column) -> Column:
    """Even-odd rule by a ray to the right."""
    n = F.size(points)
    at = lambda i, c: F.get(points, i)[c].cast("double")

    def crosses(i: Column) -> Column:
        j = (i + n - 1) % n
        slope = F.try_divide((at(j, "x") - at(i, "x")) * (py - at(i, "y")), at(j, "y") - at(i, "y") + F.lit(1e-7))
        return ((at(i, "y") > py) != (at(j, "y") > py)) & (px < slope + at(i, "x"))

    hits = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), crosses)
    return F.when(n < 3, F.lit(False)).otherwise(F.size(hits) % 2 == 1)


def corners(b: Box) -> Column:
    """The four corners clockwise from the upper left."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(b.x, b.y), point(b.x + b.w, b.y), point(b.x + b.w, b.y + b.h), point(b.x, b.y + b.h))


def enclosure_bounds(b: Box, kind: Column) -> Box:
    """Footprint of what encloses a text box: a balloon's ellipse, a caption's margin of 5, or nothing."""
    grow = lambda side: F.greatest(F.ceil(side * F.lit(0.71)) - _half(side), F.lit(0))
    mx = F.when(kind == "balloon", grow(b.w)).when(kind == "caption-box", F.lit(5)).otherwise(F.lit(0))
    my = F.when(kind == "balloon", grow(b.h)).when(kind == "caption-box", F.lit(5)).otherwise(F.lit(0))
    return Box(F.greatest(b.x - mx, F.lit(0)), F.greatest(b.y - my, F.lit(0)), b.w + 2 * mx, b.h + 2 * my)


def enclosure_name(kind: Column) -> Column:
    """The name that files use for a kind of enclosure; an unknown kind is null."""
    return F.when(kind == "Balloon", "balloon").when(kind == "CaptionBox", "caption-box").when(kind == "None", "none")


def crop(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Pixel crop struct<x,y,w,h> of bounds in 0..1, origin rounded down and far edge up; null if invalid or empty."""
    sides = (left, top, right, bottom)
    valid = F.lit(True)
    for s in sides:
        valid = valid & F.coalesce(s.between(0, 1) & ~F.isnan(s.cast("double")), F.lit(False))
    x, y = F.floor(left * width), F.floor(top * height)
    w = F.least(F.ceil(right * width), width) - x
    h = F.least(F.ceil(bottom * height), height) - y
    made = F.struct(*(v.cast("long").alias(n) for n, v in (("x", x), ("y", y), ("w", w), ("h", h))))
    return F.when(valid & (right > left) & (bottom > top) & (w > 0) & (h > 0), made)


def aspect(width: Column, height: Column) -> Column:
    return F.try_divide(width.cast("double"), height.cast("double"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2)))
