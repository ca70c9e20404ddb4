"""Nearest points of a frame against a full search."""

import math

import numpy as np

from tesserae.operators import layout, rooms


def test_nearest_seen_equals_a_full_search(spark):
    rng = np.random.default_rng(8)
    points = [("ab"[i % 2], i, *map(float, rng.uniform(0, (640, 480) if i % 3 else (60, 60)))) for i in range(400)] + [("a", 500, 100.0, 100.0), ("a", 501, 100.0, 100.0), ("a", 502, None, 1.0), ("c", 503, 1.0, 1.0)]
    pixels = [("ab"[i % 2], i, *map(float, rng.uniform(-80, 700, 2))) for i in range(300)] + [("a", 900, 101.0, 100.0), ("b", 901, None, 2.0), ("d", 902, 1.0, 1.0), ("c", 903, 41.0, 1.0), ("c", 904, 41.001, 1.0)]
    want = {}
    for k, i, u, v in pixels:
        near = [(math.sqrt((u - a) ** 2 + (v - b) ** 2), p) for f, p, a, b in points if f == k and None not in (u, v, a, b)]
        if near and min(near)[0] <= 40:
            want[k, i] = min(near)
    got = rooms.nearest_seen(spark.createDataFrame(pixels, "frame string, pixel int, u double, v double"), spark.createDataFrame(points, "frame string, point int, u double, v double"), ["frame"], "pixel", "point").collect()
    assert {(r["frame"], r["pixel"]): (r["distance"], r["point"]) for r in got} == want and len(got) == len(want)
    assert want["a", 900][1] == 500 and ("c", 903) in want and ("c", 904) not in want


def test_matches_take_the_floor_place_of_the_nearest_point(spark):
    points = spark.createDataFrame([(1, 10, 50.0, 50.0, 1.0, 2.0), (1, 11, 80.0, 50.0, 3.0, 4.0), (2, 12, 50.0, 50.0, 5.0, 6.0)], "frame int, point int, u double, v double, x double, y double")
    matches = spark.createDataFrame([(0, 1, 60.0, 50.0), (1, 1, 70.0, 50.0), (2, 2, 200.0, 50.0), (3, 2, 50.0, 80.0)], "match int, a_frame int, au double, av double")
    got = {r["match"]: (r["a_x"], r["a_y"]) for r in layout.matches_on_floor(matches, points, "a", "au", "av").collect()}
    assert got == {0: (1.0, 2.0), 1: (3.0, 4.0), 3: (5.0, 6.0)}
