"""Masks as runs against masks as arrays."""

import numpy as np
import pytest

from tesserae.operators import grid


def spread(mask, offsets):
    out = np.zeros_like(mask)
    for dx, dy in offsets:
        out |= np.roll(mask, (dx, dy), (0, 1))
    return out


def dense(floor, path, radius, half, size):
    """Cells inside, on an array with room enough that nothing rolls over its edge."""
    def mask(cells):
        out = np.zeros((size, size), bool)
        for x, y in cells:
            out[x, y] = True
        return out

    disk = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if x * x + y * y <= radius * radius]
    square = [(x, y) for x in range(-half, half + 1) for y in range(-half, half + 1)]
    shut = ~spread(~spread(mask(floor) | spread(mask(path), disk), square), square)
    out = np.zeros_like(shut)
    out[0, 0] = True
    while True:  # the outside grows over edges until it stops
        more = out | (spread(out, [(1, 0), (-1, 0), (0, 1), (0, -1)]) & ~shut)
        if (more == out).all():
            return {(int(x), int(y)) for x, y in zip(*np.nonzero(~out))}
        out = more


@pytest.mark.parametrize("seed", [0, 1])
def test_interiors_equal_those_of_arrays(spark, seed):
    rng = np.random.default_rng(seed)
    floor, path, want = [], [], set()
    for key in "abc":
        f = [(int(x), int(y)) for x, y in rng.integers(12, 48, ((60, 500, 900)[seed], 2)) if key == "a" or not (20 < x < 34 and 20 < y < 34)]
        p = [(int(x), int(y)) for x, y in rng.integers(15, 45, (4, 2))]
        floor += [(key, *c) for c in f]
        path += [(key, *c) for c in p]
        want |= {(key, *c) for c in dense(f, p, 3, 2, 60)}
    df = lambda rows: spark.createDataFrame(rows, "room string, cx long, cy long")
    runs = grid.interior(df(floor), df(path), ["room"], 3, 2)
    assert {tuple(r) for r in grid.cells(runs, ["room"]).collect()} == want
    assert [(r["room"], r["row"], r["x0"]) for r in runs.collect()].__len__() == runs.distinct().count()


def test_a_ring_is_filled_and_a_ring_with_a_gap_is_not(spark):
    ring = [(x, y) for x in range(12) for y in range(12) if x in (0, 11) or y in (0, 11)]
    rows = [("shut", *c) for c in ring] + [("open", *c) for c in ring if c != (0, 6)] + [("corner", *c) for c in ring if c != (0, 0)]
    df = spark.createDataFrame(rows, "room string, cx long, cy long")
    got = grid.cells(grid.interior(df, df.limit(0), ["room"], 0, 0), ["room"]).groupBy("room").count().collect()
    assert {r["room"]: r["count"] for r in got} == {"shut": 144, "open": 43, "corner": 143}  # corners do not join free cells


def test_a_far_cell_costs_nothing(spark):
    rows = [("a", x, y) for x in range(6) for y in range(6)] + [("a", 10**6, 3), ("a", 3, 10**6), ("a", None, 1)]
    df = spark.createDataFrame(rows, "room string, cx long, cy long")
    runs = grid.interior(df, df.limit(0), ["room"])
    assert runs.count() == 8 and grid.cells(runs, ["room"]).count() == 38


def test_nothing(spark):
    none = spark.createDataFrame([], "room string, cx long, cy long")
    assert grid.interior(none, none, ["room"]).collect() == []
