"""Floors and ceilings of made rooms: what is accepted, and why the rest is refused."""

import numpy as np
import pytest

from tesserae.operators import planes

CLOUD = "room string, x double, y double, h double"


def rows(room, x, y, h):
    return [(room, *map(float, p)) for p in zip(x, y, h)]


def test_floors(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 4, 3000), rng.uniform(0, 3, 3000)
    tilted = 0.1 + 0.01 * x - 0.005 * y + rng.normal(0, 0.003, 3000)
    cloud = rows("tilted", x, y, tilted) + rows("tilted", x, y, 0.75 + rng.normal(0, 0.001, 3000))  # a table holds as many points, closer
    cloud += rows("tilted", x[:20], y[:20], rng.uniform(-2, 0, 20)) + [("tilted", None, 1.0, 0.1), ("tilted", float("nan"), 1.0, 0.1)]
    cloud += rows("line", x[:300], x[:300], np.full(300, 1.5)) + rows("few", x[:99], y[:99], np.zeros(99))
    got = {r["room"]: r for r in planes.floors(spark.createDataFrame(cloud, CLOUD), ["room"]).collect()}
    assert {k: r["method"] for k, r in got.items()} == {"tilted": "plane", "line": "band", "few": "too few points"}
    t = got["tilted"]
    assert t["a"] == pytest.approx(0.01, abs=1e-3) and t["b"] == pytest.approx(-0.005, abs=1e-3) and t["c"] == pytest.approx(0.1, abs=3e-3)
    assert t["total"] == 6020 and 2990 <= t["inliers"] <= 3010
    assert (got["line"]["a"], got["line"]["c"]) == (0.0, pytest.approx(1.51)) and got["line"]["inliers"] == 300
    assert got["few"]["c"] is None and got["few"]["inliers"] is None
    assert planes.floors(spark.createDataFrame([], CLOUD), ["room"]).collect() == []


def test_ceilings(spark):
    rng = np.random.default_rng(3)
    n = 2500
    x, y = rng.uniform(0, 4, n), rng.uniform(0, 3, n)
    side = rng.integers(0, 4, n)
    edge_x, edge_y = np.where(side == 0, 0.0, np.where(side == 1, 4.0, x)), np.where(side == 2, 0.0, np.where(side == 3, 3.0, y))
    noise = lambda: rng.normal(0, 0.004, n)
    floor = lambda room: rows(room, x, y, noise())
    made = {
        "whole": floor("whole") + rows("whole", x, y, 2.5 + noise()),
        "outline": floor("outline") + rows("outline", edge_x, edge_y, 2.4 + noise()),
        "few points above": floor("few points above") + rows("few points above", x[:300], y[:300], np.full(300, 2.5)),
        "too low": floor("too low") + rows("too low", x, y, 1.85 + 0.03 * y + noise()),
        "few inliers": floor("few inliers") + rows("few inliers", x, y, rng.uniform(2, 4, n)),
        "not level": rows("not level", x, y, 2.5 + 0.5 * x),
    }
    rooms = spark.createDataFrame([(k, 0.0, 1.4) for k in made] + [("nothing", 0.0, 1.4)], "room string, floor double, camera double")
    got = {r["room"]: r for r in planes.ceilings(spark.createDataFrame([p for v in made.values() for p in v], CLOUD), rooms, ["room"]).collect()}
    assert got["whole"]["reason"] is None and got["whole"]["c"] == pytest.approx(2.5, abs=5e-3) and got["whole"]["inliers"] == n and got["whole"]["interior"] > 0.5
    for reason in set(made) - {"whole"}:
        assert got[reason]["reason"] == reason, (reason, got[reason])
    assert got["outline"]["interior"] < 0.15
    assert got["nothing"]["reason"] == "few points above" and got["nothing"]["total"] == 0
