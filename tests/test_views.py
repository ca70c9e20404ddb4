"""Planes of views and the walls they merge into."""

import math
import random

import numpy as np
import pytest

from tesserae.operators import views

POINTS = "room string, frame int, x double, y double, z double, nx double, ny double, nz double"
POSES = "room string, frame int, qw double, qx double, qy double, qz double, tx double, ty double, tz double"


def sequential(rows, cosine, offset, either_way=False):
    """Each row in order joins the first leader that fits."""
    found, out = [], {}
    for i, v, o in sorted(rows):
        u = np.array(v) / np.linalg.norm(v)
        for j, w, p in found:
            alike = abs(u @ w) if either_way else u @ w
            if alike >= cosine and abs(o - p) <= offset:
                out[i] = j
                break
        else:
            found.append((i, u, o))
            out[i] = i
    return out


@pytest.mark.parametrize("either_way", [False, True])
def test_leaders_equal_the_sequential_rule(spark, either_way):
    draw = random.Random(5)
    rows = [(k, i, [draw.gauss(0, 1), draw.gauss(0, 1)], draw.uniform(-1.5, 1.5)) for k in ("a", None) for i in range(150)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v array<double>, o double")
    got = {(r["k"], r["i"]): r["leader"] for r in views.leaders(df, ["k"], "i", "v", "o", either_way=either_way).collect()}
    want = {(k, i): j for k in ("a", None) for i, j in sequential([r[1:] for r in rows if r[0] == k], 0.9, 0.35, either_way).items()}
    assert got == want


def test_odd_rows_have_no_leader(spark):
    rows = [(1, [1.0, 0.0], 0.0), (1, [1.0, 0.0], 0.0), (2, None, 0.0), (3, [0.0, 0.0], 0.0), (4, [1.0, None], 0.0), (5, [1.0, 0.0], None), (6, [1.0, 0.0], float("nan")), (None, [1.0, 0.0], 0.0)]
    df = spark.createDataFrame([("k", *r, 7) for r in rows], "k string, i int, v array<double>, o double, leader int")
    got = sorted(((r["i"] or 0, r["leader"]) for r in views.leaders(df, ["k"], "i", "v", "o").collect()))
    assert got == [(0, None), (1, 1), (2, None), (3, None), (4, None), (5, None), (6, None)]
    assert views.leaders(df.limit(0), ["k"], "i", "v", "o").collect() == []


def room(frame, yaw, at, near=1.0):
    """Points of a room 4 m wide (x), 3.2 m deep (z), floor 1.4 m under the camera, seen from `at` by a camera turned by yaw; walls
    seem nearer by the factor."""
    c, s = math.cos(yaw), math.sin(yaw)
    back = lambda x, y, z: (c * x - s * z, y, s * x + c * z)
    rows = []

    def add(p, n):
        q = back(p[0] - at[0], p[1], p[2] - at[1])
        rows.append(("r", frame, *map(float, q), *map(float, back(*n))))

    steps = np.linspace(0.0125, 0.9875, 40)
    for a in steps:
        for b in steps[::4]:
            add((4 * a - 2, 1.4, 3.2 * b - 1.6), (0, -1, 0))
            add((4 * a - 2, -1.1, 3.2 * b - 1.6), (0, 1, 0))
    for a in steps:
        for h in np.linspace(-0.4, 0.6, 6):
            add((2 * near, h, 3.2 * a - 1.6), (-1, 0, 0))
            add((4 * a - 2, h, 2.0 * near), (0, 0, -1))
    return rows, ("r", frame, math.cos(yaw / 2), 0.0, math.sin(yaw / 2), 0.0, at[0], 0.0, at[1])


def test_views_show_planes_and_merge_into_walls(spark):
    made = [room(0, 0.0, (0.0, 0.0)), room(1, 0.5, (0.1, 0.1), 0.96)]
    points = spark.createDataFrame([p for rows, _ in made for p in rows], POINTS)
    poses = spark.createDataFrame([pose for _, pose in made], POSES)
    planes = views.view_planes(points, poses, ["room"], "frame")
    got = {(r["frame"], r["kind"], r["place"]): r for r in planes.collect()}
    assert sorted(k[:2] for k in got) == [(f, k) for f in (0, 1) for k in ("ceiling", "floor", "wall", "wall")]
    for f in (0, 1):
        assert got[f, "floor", 0]["offset"] == pytest.approx(1.4) and got[f, "ceiling", 1]["offset"] == pytest.approx(-1.1)
        assert np.allclose(got[f, "floor", 0]["normal"], [0, 1, 0])
    whole = sorted(abs(r["offset"]) for (f, kind, _), r in got.items() if kind == "wall" and f == 0)
    assert whole == pytest.approx([2.0, 2.0])
    walls = {r["axis"]: r for r in views.room_walls(planes, points, poses, ["room"], "frame").collect()}
    assert len(walls) == 2 and all(w["views"] == 2 and w["inliers"] == 480 for w in walls.values())
    # moved out to the edge of the floor that all views see, whichever way the frame turned
    assert sorted(abs(w["coord"]) for w in walls.values()) == pytest.approx([1.32, 1.95], abs=0.001)
    merged = views.room_walls(planes, points, poses, ["room"], "frame", edge_points=10**6).collect()
    assert sorted(abs(w["coord"]) for w in merged) == pytest.approx([1.96, 1.96], abs=0.001)


def test_furniture_is_no_wall(spark):
    rows, pose = room(0, 0.0, (0.0, 0.0), 0.8)  # walls at 1.6 m, the floor 1.4 m away: below 1.2 times that
    planes = views.view_planes(spark.createDataFrame(rows, POINTS), spark.createDataFrame([pose], POSES), ["room"], "frame")
    assert sorted(r["kind"] for r in planes.collect()) == ["ceiling", "floor"]


def test_views_without_planes(spark):
    flat = [("r", 0, 1.0, 1.0, float(i), 1.0, 0.0, 0.0) for i in range(60)]
    few = [("r", 1, 1.0, float(i), 1.0, 1.0, 0.0, 0.0) for i in range(10)]
    odd = [("r", 2, None, 1.0, 1.0, 1.0, 0.0, 0.0), ("r", 2, float("nan"), 1.0, 1.0, None, None, None), (None, None, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)]
    points = spark.createDataFrame(flat + few + odd, POINTS)
    poses = spark.createDataFrame([("r", f, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for f in range(3)], POSES)
    planes = views.view_planes(points, poses, ["room"], "frame")
    assert planes.collect() == [] and views.view_planes(points.limit(0), poses, ["room"], "frame").collect() == []
    assert views.room_walls(planes, points, poses, ["room"], "frame").collect() == []
