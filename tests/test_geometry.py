from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionflow.functions import geometry as g
from regionflow.functions import numeric as m
from regionflow.operators import layout


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def box(x, y, w, h):
    return g.Box(*(F.lit(v).cast("long") for v in (x, y, w, h)))


def test_areas(spark):
    assert value(spark, g.intersection(box(0, 0, 50, 50), box(25, 25, 50, 50))) == 625
    assert value(spark, g.iou(box(0, 0, 10, 10), box(5, 0, 10, 10))) == pytest.approx(50 / 150)
    assert value(spark, g.iou(box(0, 0, 0, 0), box(5, 0, 0, 0))) == 0
    assert not value(spark, g.overlaps(box(0, 0, 10, 10), box(10, 0, 5, 5)))
    assert value(spark, g.overlaps(box(0, 0, 10, 10), box(10, 0, 5, 5), pad=1))
    assert value(spark, g.contains(box(0, 0, 10, 10), box(0, 0, 10, 10))) and not value(spark, g.contains(box(0, 0, 10, 10), box(0, 0, 10, 10), strict=True))
    assert [value(spark, v) for v in g.union(box(1, 2, 3, 4), box(5, 1, 1, 1))] == [1, 1, 5, 5]


def test_normalised(spark):
    assert [value(spark, v) for v in g.normalized(box(500, 1000, 250, 500), F.lit(1000), F.lit(2000))] == [0.5, 0.5, 0.25, 0.25]
    assert [value(spark, v) for v in g.normalized(box(5, 5, 5, 5), F.lit(0), F.lit(-1))] == [0, 0, 0, 0]


def test_polygon(spark):
    points = [(0, 0), (10, 0), (10, 10), (0, 10)]
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
    assert value(spark, g.polygon_area(square)) == 100
    assert value(spark, g.in_polygon(square, F.lit(5.0), F.lit(5.0))) and not value(spark, g.in_polygon(square, F.lit(15.0), F.lit(5.0)))
    two = F.slice(square, 1, 2)
    assert value(spark, g.polygon_area(two)) == 0 and not value(spark, g.in_polygon(two, F.lit(1.0), F.lit(0.0)))


@pytest.mark.parametrize(("kind", "want"), [("balloon", [79, 89, 142, 72]), ("caption-box", [95, 95, 110, 60]), ("none", [100, 100, 100, 50])])
def test_enclosures(spark, kind, want):
    assert [value(spark, v) for v in g.enclosure_bounds(box(100, 100, 100, 50), F.lit(kind))] == want


@pytest.mark.parametrize(
    ("bounds", "want"),
    [((0.1, 0.1, 0.5, 0.5), (10, 10, 40, 40)), ((0.0, 0.0, 1.0, 1.0), (0, 0, 100, 100)), ((0.5, 0.1, 0.5, 0.2), None), ((-0.1, 0.0, 0.5, 0.5), None), ((0.0, 0.0, 1.5, 1.0), None), ((None, 0.0, 1.0, 1.0), None), ((float("nan"), 0.0, 1.0, 1.0), None), ((0.111, 0.111, 0.119, 0.119), (11, 11, 1, 1))],
)
def test_crop(spark, bounds, want):
    got = value(spark, g.crop(*(F.lit(b).cast("double") for b in bounds), F.lit(100), F.lit(100)))
    assert (tuple(got) if got else None) == want


def test_numbers(spark):
    p = value(spark, m.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    assert p == pytest.approx([0.09003057, 0.24472847, 0.66524096])
    assert value(spark, m.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))) == pytest.approx(1)
    assert value(spark, m.luma(F.lit(255), F.lit(255), F.lit(255))) == 255 and value(spark, m.luma(F.lit(255), F.lit(0), F.lit(0))) == 76
    assert value(spark, m.upper_median(F.array(*(F.lit(float(x)) for x in (4, 1, 3, 2))))) == 3
    assert value(spark, m.beam_score(F.lit(-4.0), F.lit(2))) == -1
    tokens = F.array(*(F.lit(x).cast("long") for x in (10, 11, 12, 20, 10, 11)))
    assert value(spark, m.banned_next(tokens)) == [12]
    assert value(spark, m.banned_next(F.slice(tokens, 1, 2))) == []
    assert value(spark, m.mean_confidence(F.lit(None).cast("double"))) == 0


def order(spark, boxes, direction):
    df = spark.createDataFrame([(1, i, *b, direction) for i, b in enumerate(boxes)], "page_id bigint, idx bigint, x bigint, y bigint, h bigint, direction string")
    rows = layout.rows(df).orderBy("place").collect()
    return [boxes[r["idx"]][0] for r in rows]


def test_reading_order(spark):
    assert order(spark, [(100, 20, 50), (300, 10, 50), (200, 200, 50)], "right-to-left") == [300, 100, 200]
    assert order(spark, [(500, 10, 50), (100, 12, 50), (300, 11, 50)], "left-to-right") == [100, 300, 500]
    assert order(spark, [(1, 1, 1)], None) == []


def test_directions_mirror(spark):
    boxes = [(10, 5, 30), (60, 8, 30), (30, 90, 20), (5, 95, 25), (80, 70, 30)]
    mirrored = [(100 - x, y, h) for x, y, h in boxes]
    assert order(spark, boxes, "left-to-right") == [100 - x for x in order(spark, mirrored, "right-to-left")]


@pytest.mark.parametrize(("w", "h", "tiles"), [(100, 100, 1), (100, 300, 1), (100, 400, 5), (400, 100, 5), (10, 31, 4), (1, 5, 5)])
def test_tiles(spark, w, h, tiles):
    df = spark.createDataFrame([(w, h)], "w bigint, h bigint")
    rows = layout.tiles(df).orderBy("tile").collect()
    assert len(rows) == tiles
    last = rows[-1]
    assert last["tile_x"] + last["tile_w"] == w and last["tile_y"] + last["tile_h"] == h
