"""Unions of boxes against unit cells; parts, outlines and walls of rooms."""

import duckdb
import numpy as np
import pytest

from tesserae.operators import rectilinear
from tesserae.plans.catalogue import ORACLES, QUERIES
from tesserae.session import Steps

BOXES = "room string, u0 double, u1 double, v0 double, v1 double"


def spread(cells, d):
    return {(x + i, y + j) for x, y in cells for i in range(-d, d + 1) for j in range(-d, d + 1)}


def eroded(cells, d):
    return {(x, y) for x, y in cells if all((x + i, y + j) in cells for i in range(-d, d + 1) for j in range(-d, d + 1))}


def cells_of(rows):
    return {(r["room"], x, y) for r in rows for x in range(round(r["u0"]), round(r["u1"])) for y in range(round(r["v0"]), round(r["v1"]))}


def test_unions_equal_those_of_cells(spark):
    rng = np.random.default_rng(4)
    rows, cells = [], {}
    for k in range(25):
        for _ in range(rng.integers(1, 9)):
            u, v = rng.integers(0, 14, 2)
            w, h = rng.integers(0, 6, 2)
            rows.append((f"r{k}", *map(float, (u, u + w, v, v + h))))
            cells.setdefault(f"r{k}", set()).update((x, y) for x in range(u, u + w) for y in range(v, v + h))
    union = rectilinear.slabs(spark.createDataFrame(rows, BOXES), ["room"])
    named = lambda f: {(k, *c) for k, v in cells.items() for c in f(v)}
    assert cells_of(union.collect()) == named(lambda c: c)
    assert cells_of(rectilinear.grown(union, ["room"], 2).collect()) == named(lambda c: spread(c, 2))
    assert cells_of(rectilinear.shrunk(union, ["room"], 1).collect()) == named(lambda c: eroded(c, 1))
    assert cells_of(rectilinear.cleaned(union, ["room"], 1).collect()) == named(lambda c: spread(eroded(spread(c, 1), 2), 1))


def test_cleaned_plans_move_their_lines_once(spark, tmp_path, monkeypatch):
    """One exchange and no tables between; equal to the SQL, for lines without an order too."""
    rng = np.random.default_rng(7)
    rows = [(None if k == 40 else int(k), *map(int, rng.integers(0, 60, 2)), int(line), float(rng.integers(1, 51))) for k in range(41) for line in range(1, 1 + rng.integers(1, 8))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(Steps, "keep", lambda *_: pytest.fail("a table is written between"))
    df = QUERIES["cleaned_plans"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = df.collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLES["cleaned_plans"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(r["cleaned"] is None and r["k"] is not None for r in got)


def test_keys_of_many_boxes_are_united_in_bands(spark):
    rng = np.random.default_rng(8)
    at, size = rng.integers(0, 400, (150, 2)), rng.integers(1, 30, (150, 2))
    rows = [("r", *map(float, (u, u + w, v, v + h))) for (u, v), (w, h) in zip(at, size)]
    cells = {(u + i, v + j) for (u, v), (w, h) in zip(at.tolist(), size.tolist()) for i in range(w) for j in range(h)}
    union = rectilinear.slabs(spark.createDataFrame(rows, BOXES), ["room"]).collect()
    assert max(r["slab"] for r in union) > rectilinear.BAND
    assert cells_of(union) == {("r", *c) for c in cells}
    assert sum((r["u1"] - r["u0"]) * (r["v1"] - r["v0"]) for r in union) == len(cells)


def test_outlines(spark):
    """Slivers and gaps go, holes are filled; the walked part stays, else the largest; what cleaning would destroy stays."""
    gap = [(0.0, 4.0, 0.0, 3.0), (4.0, 6.0, 0.0, 0.2), (0.0, 4.0, 3.1, 5.0)]  # a sliver to the right, a gap of 0.1
    two = [(0.0, 2.0, 0.0, 2.0), (5.0, 9.0, 0.0, 3.0), (9.0, 10.0, 3.0, 4.0)]  # the last meets the second in a corner only
    rooms = {
        "parted": (gap, [(1, 1)], (4, 3)), "joined": (gap + [(1.0, 2.0, 2.9, 3.2)], [(1, 1)], (4, 5)),
        "ring": ([(0.0, 5.0, 0.0, 1.0), (0.0, 5.0, 4.0, 5.0), (0.0, 1.0, 0.0, 5.0), (4.0, 5.0, 0.0, 5.0)], [], (5, 5)),
        "walked": (two, [(1, 1), (1.5, 1), (6, 1)], (2, 2)), "thin": ([(0.0, 8.0, 0.0, 0.2)], [(1, 0.1)], (8, 0.2)), "none": ([(0.0, 0.0, 0.0, 3.0)], [(1, 1)], None),
    }
    df = spark.createDataFrame([(k, *b) for k, (boxes, _, _) in rooms.items() for b in boxes] + [("large", *b) for b in two], BOXES)
    path = spark.createDataFrame([(k, *map(float, p)) for k, (_, points, _) in rooms.items() for p in points] + [("large", 20.0, 20.0)], "room string, x double, y double")
    got = {}
    for r in rectilinear.plan_outline(df, path, ["room"]).collect():
        got.setdefault(r["room"], set()).add((round(r["x"], 6), round(r["y"], 6)))
    want = {k: {(a, b) for a in (0.0, far[0]) for b in (0.0, far[1])} for k, (_, _, far) in rooms.items() if far}
    assert got == want | {"large": {(5.0, 0.0), (5.0, 3.0), (9.0, 0.0), (9.0, 3.0)}}


def test_walls_face_out_and_know_their_line(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (3.8, 2.0), (3.8, 3.0), (0.0, 3.0)]
    df = spark.createDataFrame([("a", i, *p) for i, p in enumerate(ring)], "room string, place int, x double, y double")
    lines = spark.createDataFrame([("a", 7, 0, 4.1, 2.5, 300), ("a", 8, 0, 3.85, 2.4, 200), ("a", 9, 1, 0.6, 2.3, 100)], "room string, line int, axis int, coord double, top double, n int")
    got = {r["wall"]: r for r in rectilinear.walls(df, lines, ["room"]).collect()}
    assert sorted(got) == [0, 1, 3, 4, 5]  # the jog of 0.2 is no wall
    assert {k: (r["nx"], r["ny"]) for k, r in got.items()} == {0: (0.0, -1.0), 1: (1.0, 0.0), 3: (1.0, 0.0), 4: (0.0, 1.0), 5: (-1.0, 0.0)}
    assert {k: r["line"] for k, r in got.items()} == {0: None, 1: 7, 3: 8, 4: None, 5: None}
    assert got[1]["top"] == 2.5 and got[1]["n"] == 300 and got[0]["length"] == pytest.approx(4.0)
