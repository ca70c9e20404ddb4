"""Layout operators against plain code."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import layout, rooms, solve


def l_shape(turn):
    """Points (x, y, h) on the walls and floor of an L-shaped room, turned, and its corners."""
    corners = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 3.6), (0, 3.6)], dtype=float)
    spin = np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
    points = []
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        n = int(round(np.linalg.norm(b - a) / 0.08))
        points += [(*(a + (b - a) * (i + 0.5) / n), h) for i in range(n) for h in np.arange(0.4, 2.0, 0.1)]
    floor = [(x, y, 0.0) for x in np.arange(0.05, 4, 0.1) for y in np.arange(0.05, 3.6, 0.1) if not (x > 2 and y > 2)]
    points = np.array(points + floor)
    points[:, :2] = points[:, :2] @ spin.T
    return points, corners @ spin.T, np.array([(0.5, 0.5), (3, 1)]) @ spin.T


@pytest.mark.parametrize("turn", [0.0, 0.35, -0.6])
def test_layout_of_an_l_shaped_room(spark, turn):
    points, corners, path = l_shape(turn)
    df = spark.createDataFrame([("r", i, *map(float, p)) for i, p in enumerate(points)], "room string, i long, x double, y double, h double")
    walked = spark.createDataFrame([("r", *map(float, p)) for p in path], "room string, x double, y double")
    got = [(r["x"], r["y"]) for r in layout.extract_layout(df, walked, ["room"], "i", (0.3, 2.2), radius=0.15, least=100).orderBy("ring", "place").collect()]
    assert len(got) == 6
    assert max(min(math.dist(g, c) for c in corners) for g in got) < 0.05


def test_nothing_to_lay_out(spark):
    empty = spark.createDataFrame([], "room string, i long, x double, y double, h double")
    assert layout.extract_layout(empty, empty.select("room", "x", "y"), ["room"], "i", (0.3, 2.2)).collect() == []


def polygons(n, seed):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        angles = np.sort(rng.random(rng.integers(3, 8)) * 2 * math.pi)
        if np.diff(np.append(angles, angles[0] + 2 * math.pi)).max() < math.pi:
            yield np.stack([np.cos(angles), np.sin(angles)], axis=1) * rng.uniform(0.5, 2) + rng.uniform(-1, 1, 2)


def test_least_move_ends_the_overlap_and_no_shorter_one_does():
    shapes = list(polygons(40, 1))
    for a, b in itertools.pairwise(shapes):
        move = layout.least_move(a, b)
        size = float(np.hypot(*move))
        if solve.clip_convex(a, b) < 1e-9:
            assert size < 1e-4
            continue
        assert solve.clip_convex(a + move * (1 + 1e-6), b) < 1e-9
        for angle in np.linspace(0, 2 * math.pi, 90, endpoint=False):
            assert solve.clip_convex(a + 0.98 * size * np.array([math.cos(angle), math.sin(angle)]), b) > 0


def test_many_shapes_end_apart():
    shapes = list(polygons(12, 5))
    move, settled = layout.moves_apart(shapes)
    assert settled and (move[0] == 0).all()
    assert max(solve.clip_convex(a + s, b + t) for (a, s), (b, t) in itertools.combinations(zip(shapes, move), 2)) < 1e-6


def test_wall_cells_and_lines_meet_only_what_is_near(spark):
    rng = np.random.default_rng(2)
    points = [("a" if i % 3 else "b", *map(float, rng.uniform(-3, 3, 2)), float(rng.uniform(0, 2.5))) for i in range(3000)]
    walls = [(k, w, *map(float, rng.uniform(-3, 3, 4)), 2.0) for k in "ab" for w in range(8)]
    band, cell = 0.1, 0.2
    want = {}
    for (k, x, y, h), (q, w, ax, ay, bx, by, top) in itertools.product(points, walls):
        size = math.hypot(bx - ax, by - ay)
        along, across = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size, ((y - ay) * (bx - ax) - (x - ax) * (by - ay)) / size
        if k == q and abs(across) <= band and 0 <= along <= size and h <= top:
            place = (k, w, min(int(along / cell), math.ceil(size / cell) - 1), min(int(h / cell), math.ceil(top / cell) - 1))
            want[place] = want.get(place, 0) + 1
    df = spark.createDataFrame(points, "room string, x double, y double, h double")
    got = rooms.wall_cells(df, spark.createDataFrame(walls, "room string, wall int, ax double, ay double, bx double, by double, top double"), ["room"], band, cell).collect()
    assert {(r["room"], r["wall"], r["col"], r["row"]): r["n"] for r in got} == want
    lines = [(k, n, n % 2, float(rng.uniform(-3, 3)), -2.0, 2.0) for k in "ab" for n in range(9)]
    near = {}
    for (k, x, y, h), (q, n, axis, coord, lo, hi) in itertools.product(points, lines):
        if k == q and abs((y if axis else x) - coord) <= band and lo <= (x if axis else y) <= hi and h >= 0.5:
            near.setdefault((k, n), []).append(h)
    held = rooms.line_support(df, spark.createDataFrame(lines, "room string, line int, axis int, coord double, lo double, hi double"), ["room"], band, 5).collect()
    assert {(r["room"], r["line"]): r["n"] for r in held} == {k: len(v) for k, v in near.items() if len(v) >= 5}
    assert all(abs(r["top"] - np.percentile(near[r["room"], r["line"]], 98)) < 1e-9 for r in held)


def test_matches_are_lifted_and_rooms_stitched(spark):
    """Room 2 stands turned and moved against room 1 and shares matches with it; room 3 has a doorway to
    2; room 4 has two matches only."""
    rng = np.random.default_rng(3)
    pose = [1.0, 0.0, 0.0, 0.5, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 2.0]
    camera = {"fx": 500.0, "fy": 510.0, "cx": 320.0, "cy": 240.0, "pose": pose, "e1": [1.0, 0.0, 0.0], "e2": [0.0, 0.0, 1.0], "origin": [0.1, 0.2, 0.3]}
    one = {"u": 400.0, "v": 100.0, "depth": 2.5, **camera}
    df = spark.createDataFrame([tuple(one.values()), (*list(one.values())[:2], 0.0, *list(one.values())[3:])], [f"a_{k}" for k in one])
    lifted, blind = sorted(layout.lifted_matches(df, [], "a").collect(), key=lambda r: r["a_x"] is None)
    assert abs(lifted["a_x"] - ((400 - 320) / 500 * 2.5 + 0.5 - 0.1)) < 1e-12 and abs(lifted["a_y"] - (2.5 + 2 - 0.3)) < 1e-12 and blind["a_x"] is None
    yaw, shift = 0.4, np.array([1.0, -2.0])
    spin = np.array([[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]])
    places = rng.uniform(0, 4, (30, 2))
    rows = [(1, 2, *map(float, spin @ p + shift + (5 if i < 4 else 0)), *map(float, p), 1.0 if i >= 4 else 0.01) for i, p in enumerate(places)] + [(1, 4, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 4, 1.0, 0.0, 1.0, 0.0, 1.0)]
    matches = spark.createDataFrame(rows, "a int, b int, a_x double, a_y double, b_x double, b_y double, weight double")
    corners = spark.createDataFrame([(i, k, *p) for i in (1, 2, 3, 4) for k, p in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])], "room int, place int, x double, y double")
    door = spark.createDataFrame([(2, 3, 4.0, 1.5, 1.0, 0.0, 0.0, 1.5, -1.0, 0.0)], "a int, b int, ax double, ay double, anx double, any double, bx double, by double, bnx double, bny double")
    edges, placed = layout.stitch_graph(matches, door, corners, "room")
    found = {(r["a"], r["b"]): r for r in edges.collect()}
    assert found[1, 2]["source"] == "keypoints" and found[1, 2]["inliers"] == 26 and abs(found[1, 2]["yaw"] - yaw) < 0.02
    assert found[2, 3]["source"] == "doorway" and found[1, 4]["source"] is None and found[1, 4]["reason"]
    at = {r["room"]: r for r in placed.collect()}
    assert {i: r["component"] for i, r in at.items()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert len({(round(r["x"], 3), round(r["y"], 3)) for r in at.values()}) == 4 and all(r["settled"] for r in at.values())


def test_intersections_of_odd_rings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [(square, square[::-1]), (square, [(x + 1, y + 1) for x, y in square]), (square, square[:2]), (None, square), ([], square)]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert [r["area"] for r in layout.intersection_areas(pairs, "a", "b").orderBy("i").collect()] == [4.0, 1.0, 0.0, 0.0, 0.0]
    assert pairs.select(F.count(F.lit(1))).first()[0] == 5


def test_rings_whose_boxes_lie_apart_are_passed_over(monkeypatch):
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], dtype=float)
    asked, least = [], layout.least_move
    monkeypatch.setattr(layout, "least_move", lambda a, b: asked.append(1) or least(a, b))
    move, settled = layout.moves_apart([square + [5.0 * i, 0] for i in range(10)] + [square + [0.5, 0.1]])
    assert settled and len(asked) < 10 and (move[1:-1] == 0).all()
