"""Overlaps of boxes of very different sizes."""

import random

import pytest

from tesserae.operators import spatial

BOXES = "i int, x0 double, y0 double, x1 double, y1 double, level string"


def test_boxes_of_all_sizes_equal_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(120):
        side = 10 ** draw.uniform(-3, 2)
        x, y = draw.uniform(-30, 30), draw.uniform(-30, 30)
        rows.append((i, x, y, x + side * draw.random(), y + side * draw.random(), None))
    rows += [(200, -1e9, -1e9, 1e9, 1e9, ""), (201, 0.0, 0.0, 4.0, 4.0, ""), (202, 4.0, 0.0, 8.0, 4.0, ""), (203, 0.0, 0.0, 4.0, 4.0, ""), (204, 1.0, 1.0, 1.0, 3.0, "")]
    want = {}
    for n, p in enumerate(rows):
        for q in rows[n + 1:]:
            w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
            if w > 0 and h > 0:
                want[p[0], q[0]] = w * h
    odd = [(300, None, 0.0, 1.0, 1.0, ""), (301, float("nan"), 0.0, 1.0, 1.0, ""), (302, 0.0, 0.0, float("inf"), 1.0, "")]
    df = spark.createDataFrame(rows + odd, BOXES)
    found = spatial.box_overlaps(df, "i", 0.5).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]): r["area"] for r in found} == pytest.approx(want)
    assert spatial.box_overlaps(df.limit(0), "i", 0.5).collect() == []
