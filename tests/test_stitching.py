"""Poses along trees and circles against plain composition and a dense solver; whole plans of rooms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import layout, stitching

EDGES = "a int, b int, x double, y double, yaw double, weight double"


def matrix(x, y, yaw):
    return np.array([[math.cos(yaw), -math.sin(yaw), x], [math.sin(yaw), math.cos(yaw), y], [0, 0, 1]])


def between(pose, a, b):
    m = np.linalg.inv(matrix(*pose[a])) @ matrix(*pose[b])
    return float(m[0, 2]), float(m[1, 2]), math.atan2(m[1, 0], m[0, 0])


@pytest.mark.parametrize("seed, n, extra", [(0, 12, 0), (2, 14, 4)])
def test_true_moves_give_the_true_poses(spark, seed, n, extra):
    rng = np.random.default_rng(seed)
    pose = {i: (*map(float, rng.uniform(-9, 9, 2)), float(rng.uniform(-3, 3))) for i in range(n)}
    part = {i: int(i % 3 == 0) for i in pose}
    pairs = [(i, int(rng.choice([j for j in range(i) if part[j] == part[i]]))) for i in pose if any(part[j] == part[i] for j in range(i))]
    pairs += [(int(a), int(b)) for a, b in rng.integers(0, n, (extra, 2)) if part[a] == part[b]]
    rows = [(a, b, *between(pose, a, b), float(rng.uniform(0.1, 3))) for a, b in pairs] + [(1, 999, 0.0, 0.0, 0.0, 1.0), (2, 2, 5.0, 5.0, 1.0, 9.0)]
    nodes = spark.createDataFrame([(i,) for i in pose] + [(None,)], "node int")
    edges = spark.createDataFrame(rows, EDGES)
    for poses in (stitching.spanning_poses(nodes, edges), stitching.relaxed_poses(stitching.spanning_poses(nodes, edges), edges)):
        got = {r["node"]: r for r in poses.collect()}
        assert sorted(got) == sorted(pose)
        for i, r in got.items():
            root = min(j for j in pose if part[j] == part[i])
            x, y, yaw = between(pose, root, i)
            assert r["component"] == root and abs(r["x"] - x) < 1e-6 and abs(r["y"] - y) < 1e-6 and abs(math.remainder(r["yaw"] - yaw, 2 * math.pi)) < 1e-6


def test_a_circle_that_does_not_close_is_relaxed_as_by_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    n, ring = 7, [(i, (i + 1) % 7) for i in range(7)] + [(0, 3), (2, 6)]
    pose = {i: (3 * math.cos(i), 3 * math.sin(i), 0.3 * i) for i in range(n)}
    rows = [(a, b, *(float(v + rng.normal(0, 0.05)) for v in between(pose, a, b)), float(rng.uniform(0.5, 2))) for a, b in ring]
    edges = spark.createDataFrame(rows, EDGES)
    tree = stitching.spanning_poses(spark.createDataFrame([(i,) for i in range(n)], "node int"), edges)
    got = {r["node"]: r for r in stitching.relaxed_poses(tree, edges).collect()}
    start = {r["node"]: r["yaw"] for r in tree.collect()}

    def solve(wanted):  # rows (a, b, weight, value): node 0 is 0
        m = np.zeros((len(wanted), n))
        for k, (a, b, w, _) in enumerate(wanted):
            m[k, b] += math.sqrt(w)
            m[k, a] -= math.sqrt(w)
        right = np.array([math.sqrt(w) * v for _, _, w, v in wanted])
        return np.concatenate([[0], np.linalg.lstsq(m[:, 1:], right, rcond=None)[0]])

    turn = solve([(a, b, w, math.remainder(yaw - start[b] + start[a], 2 * math.pi)) for a, b, _, _, yaw, w in rows])
    yaw = {i: start[i] + turn[i] for i in range(n)}
    flat = [(a, b, w, math.cos(yaw[a]) * x - math.sin(yaw[a]) * y, math.sin(yaw[a]) * x + math.cos(yaw[a]) * y) for a, b, x, y, _, w in rows]
    xs, ys = solve([r[:4] for r in flat]), solve([(*r[:3], r[4]) for r in flat])
    for i in range(n):
        assert abs(got[i]["x"] - xs[i]) < 1e-6 and abs(got[i]["y"] - ys[i]) < 1e-6 and abs(math.remainder(got[i]["yaw"] - yaw[i], 2 * math.pi)) < 1e-6
    off = lambda at: max(abs(math.remainder(at(b) - at(a) - t, 2 * math.pi)) for a, b, _, _, t, _ in rows)
    assert off(lambda i: got[i]["yaw"]) < off(lambda i: start[i]) and off(lambda i: got[i]["yaw"]) < 0.15  # the misfit is spread, not left on one edge


def test_no_edges_and_no_nodes(spark):
    nodes, edges = spark.createDataFrame([(3,), (3,), (1,)], "node int"), spark.createDataFrame([], EDGES)
    poses = stitching.relaxed_poses(stitching.spanning_poses(nodes, edges), edges)
    assert sorted(map(tuple, poses.collect())) == [(1, 1, 0.0, 0.0, 0.0), (3, 3, 0.0, 0.0, 0.0)]
    assert stitching.spanning_poses(nodes.limit(0), edges).collect() == []


def test_a_path_takes_few_rounds(spark, monkeypatch):
    """Sixty nodes whose ids fall away from the least one."""
    order = [0, *range(60, 0, -1)]
    edges = spark.createDataFrame([(a, b, 1.0, 0.0, 0.0, 1.0) for a, b in zip(order, order[1:])], EDGES)
    kept = []
    keep = stitching.Steps.keep
    monkeypatch.setattr(stitching.Steps, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    got = {r["node"]: r["x"] for r in stitching.spanning_poses(edges.select(F.explode(F.array("a", "b")).alias("node")), edges).collect()}
    assert all(abs(got[n] - i) < 1e-9 for i, n in enumerate(order)) and kept.count("hooks") <= 7


def test_walls_are_turned_onto_the_axes(spark):
    poses = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 1, 4.0, 0.0, math.pi / 2), (5, 5, 1.0, 1.0, 0.7)], "node int, component int, x double, y double, yaw double")
    c, s = math.cos(0.2), math.sin(0.2)
    walls = spark.createDataFrame([(1, 0.0, 0.0, 3 * c, 3 * s), (1, 0.0, 0.0, -2 * s, 2 * c), (2, 1.0, 0.0, 1 + c, s)], "room int, ax double, ay double, bx double, by double")
    got = {r["node"]: r for r in stitching.snapped(poses, walls, "room").collect()}
    assert abs(got[1]["yaw"] + 0.2) < 1e-9 and abs(got[2]["yaw"] - (math.pi / 2 - 0.2)) < 1e-9 and abs(got[5]["yaw"] - 0.7) < 1e-9
    assert abs(got[2]["x"] - 4 * c) < 1e-9 and abs(got[2]["y"] + 4 * s) < 1e-9


def test_rooms_make_a_plan(spark):
    """Four rooms of 4 x 3 around a point, two by doors and two by matches, one edge of which is off by 0.2;
    a fifth alone. The circle closes, walls lie on the axes and no room lies on another."""
    rng = np.random.default_rng(1)
    true = {1: (0.0, 0.0, 0.0), 2: (4.1, 0.0, math.pi), 3: (4.1, 3.1, math.pi / 2), 4: (0.0, 3.1, 0.0)}
    ring = [(-2.0, -1.5), (2.0, -1.5), (2.0, 1.5), (-2.0, 1.5)]
    shape = {i: ring if i != 3 else [(y, -x) for x, y in ring][::-1] for i in (1, 2, 3, 4, 9)}
    corners = spark.createDataFrame([(i, k, *p) for i, r in shape.items() for k, p in enumerate(r)], "room int, place int, x double, y double")
    rows = []
    for a, b, shift in ((1, 2, 0.0), (3, 4, 0.2), (1, 4, 0.0), (1, 9, 40.0)):
        for p in rng.uniform(-2, 2, (20, 2)):
            q = matrix(*between({**true, 9: (0, 0, 0)}, a, b)) @ [*p, 1]
            noise = rng.uniform(-30, 30) if b == 9 else 0.0
            rows.append((a, b, float(q[0] + shift + noise), float(q[1]), *map(float, p), 1.0))
    matches = spark.createDataFrame(rows, "a int, b int, a_x double, a_y double, b_x double, b_y double, weight double")
    door = (np.linalg.inv(matrix(*true[2])) @ [4.1, 1.55, 1])[:2], (np.linalg.inv(matrix(*true[3])) @ [4.1, 1.55, 1])[:2]
    facing = (np.linalg.inv(matrix(*true[2]))[:2, :2] @ [0, 1]), (np.linalg.inv(matrix(*true[3]))[:2, :2] @ [0, -1])
    doors = spark.createDataFrame([(2, 3, *map(float, (*door[0], *facing[0], *door[1], *facing[1])))], "a int, b int, ax double, ay double, anx double, any double, bx double, by double, bnx double, bny double")
    edges, placed = layout.stitch_graph(matches, doors, corners, "room")
    found = {(r["a"], r["b"]): r for r in edges.collect()}
    assert found[2, 3]["source"] == "doorway" and found[1, 2]["source"] == "keypoints" and found[1, 9]["source"] is None and found[1, 9]["reason"]
    rows = {r["room"]: r for r in placed.collect()}
    assert {i: r["component"] for i, r in rows.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9} and all(r["settled"] for r in rows.values())
    for i in (2, 3, 4):  # within the misfit of the true plan, whichever way the whole was turned
        x, y, yaw = between({k: (r["x"], r["y"], r["yaw"]) for k, r in rows.items()}, 1, i)
        assert abs(x - true[i][0]) < 0.2 and abs(y - true[i][1]) < 0.2 and abs(math.remainder(yaw - true[i][2], 2 * math.pi)) < 0.02
    assert all(abs(math.remainder(r["yaw"], math.pi / 2)) < 1e-3 for i, r in rows.items())
    box = {i: [tuple(matrix(r["x"], r["y"], r["yaw"]) @ [*p, 1])[:2] for p in shape[i]] for i, r in rows.items()}
    span = lambda i, k: (min(p[k] for p in box[i]), max(p[k] for p in box[i]))
    for a in box:
        for b in box:
            if a < b:
                assert any(span(a, k)[1] <= span(b, k)[0] + 1e-3 or span(b, k)[1] <= span(a, k)[0] + 1e-3 for k in (0, 1)), (a, b)
