"""Operators whose results SQL does not check, against plain Python; boundaries; permutations."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import predicates as p
from tesserae.operators import assignment, calibration, gates, graph, layout, rooms, rules, sequence, solve, spatial, views


@pytest.mark.parametrize("error,status", [(0.02, "PASS"), (0.02 + 1e-10, "PASS"), (0.0201, "FAIL")])
def test_tolerance_gate_at_its_edge(spark, error, status):
    pairs = spark.createDataFrame([("a", 1.0 + error, 1.0)], "tier string, predicted double, truth double")
    limits = spark.createDataFrame([("a", 0.02, 0.01, 1.0), ("b", 1.0, 1.0, 1.0)], "tier string, abs_tol double, rel_tol double, fraction double")
    got = {r["tier"]: r["status"] for r in gates.tolerance_gate(pairs, limits).collect()}
    assert got == {"a": status, "b": "SKIP"}


def test_first_truth_wins_and_detection_counts_both_errors(spark):
    truth = spark.createDataFrame([("w", 1, 2.0), ("w", 0, 1.0)], "id string, line int, value double")
    pred = spark.createDataFrame([("w", 5.0), ("x", 6.0)], "id string, predicted double")
    assert [tuple(r) for r in gates.matched(pred, truth, ["id"], [F.col("line")]).select("id", "value").collect()] == [("w", 1.0)]
    t = spark.createDataFrame([("r1", "a"), ("r1", "b")], "room string, id string")
    q = spark.createDataFrame([("r1", "a"), ("r1", "c"), ("r2", "d")], "room string, id string")
    row = gates.detection_gate(q, t, ["id"], "room").collect()
    assert [(r["room"], r["matched"], r["missed"], r["phantom"]) for r in row] == [("r1", 1, 1, 1)]


def test_calibration_with_infinite_and_exact_samples(spark):
    rows = [("a", 0.0, 0.0), ("a", 1.0, 0.0), ("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 1.0, 0.0)]
    got = {r["k"]: r for r in calibration.fit_factors(spark.createDataFrame(rows, "k string, error double, half_width double"), ["k"]).collect()}
    assert got["a"]["factor"] == pytest.approx(np.percentile([0, 1, 2], 95)) and got["a"]["coverage"] == 0.5 and got["a"]["trusted"]
    assert (got["b"]["factor"], got["b"]["coverage"], got["b"]["trusted"]) == (1.0, 0.0, False)


def evaluate(node, row):
    for b in p.BRANCHES:
        if b in node:
            parts = [evaluate(c, row) for c in node[b]]
            return all(parts) if b == "all_of" else any(parts) if b == "any_of" else not any(parts)
    v, w = row.get(node["field"]), node["value"]
    if v is None:
        return node["op"] in ("ne", "not_in")
    return {"eq": lambda: v == w, "ne": lambda: v != w, "lt": lambda: v < w, "lte": lambda: v <= w, "gt": lambda: v > w, "gte": lambda: v >= w, "in": lambda: v in w, "not_in": lambda: v not in w, "contains": lambda: str(w) in str(v)}[node["op"]]()


def test_predicates_against_plain_evaluation(spark):
    rng = random.Random(1)

    def leaf():
        f = rng.choice(["a", "b"])
        op = rng.choice(list(p.OPERATORS))
        pick = (lambda: rng.randint(0, 3)) if f == "a" else (lambda: rng.choice("xyz"))
        return {"field": f, "op": op, "value": [pick(), pick()] if op in ("in", "not_in") else pick()}

    def tree(d):
        return leaf() if d == 0 or rng.random() < 0.3 else {rng.choice(p.BRANCHES): [tree(d - 1) for _ in range(rng.randint(1, 3))]}

    trees = [tree(3) for _ in range(25)]
    rows = [(a, b) for a in (None, 0, 1, 2, 3) for b in (None, "x", "y", "z")]
    df = spark.createDataFrame(rows, "a int, b string").select("a", "b", *[p.compiled(p.validated(t, ["a", "b"])).alias(f"r{i}") for i, t in enumerate(trees)])
    for r in df.collect():
        for i, t in enumerate(trees):
            assert r[f"r{i}"] == evaluate(t, {"a": r["a"], "b": r["b"]}), t


@pytest.mark.parametrize("bad", [{"all_of": []}, {"field": "a", "op": "eq"}, {"field": "q", "op": "eq", "value": 1}, {"field": "a", "op": "like", "value": 1}, {"all_of": [1]}, {"any_of": [{"field": "a", "op": "eq", "value": 1}], "x": 1}])
def test_bad_predicates_are_refused(bad):
    with pytest.raises(p.RuleError):
        p.validated(bad, ["a"])


def test_rules_are_checked():
    ok = {"id": "r", "text": " a \n b ", "when": {"field": "a", "op": "eq", "value": 1}}
    assert rules.checked_rules([ok], ["a"])[0]["text"] == "a b"
    for bad in ([], [ok, ok], [ok | {"text": " "}], [ok | {"id": ""}]):
        with pytest.raises(ValueError):
            rules.checked_rules(bad, ["a"])


def test_minimum_charge_raises_and_brackets(spark):
    regions = spark.createDataFrame([("k", 0.2, 0.1, 0.02, 0.01, 0.03, 0.22, None)], "k string, width double, height double, area double, area_lo double, area_hi double, extent double, surface_area double")
    cat = spark.createDataFrame([("k", "area", 0.0, 0.0, 1.0), ("k", "surface", 0.0, 0.5, 0.0), ("z", "count", 0.0, 0.0, 0.0)], "k string, basis string, cut_back double, waste double, min_quantity double")
    got = {r["basis"]: r for r in rules.priced(regions, cat, ["k"]).withColumn("why", rules.explained()).collect()}
    assert set(got) == {"area", "surface"}
    assert (got["area"]["quantity"], got["area"]["raised"], got["area"]["ci_lo"]) == (1.0, True, 1.0) and "raised" in got["area"]["why"]
    assert got["surface"]["quantity"] == pytest.approx(0.03) and got["surface"]["ci_lo"] <= 0.03 <= got["surface"]["ci_hi"]


@pytest.mark.parametrize("seed", range(30))
def test_monotone_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = sorted(rng.integers(0, 6, 2).tolist())
    x, y = np.sort(rng.integers(0, 9, n).astype(float)), np.sort(rng.integers(0, 9, m).astype(float))
    to = assignment.monotone_assignment(x, y)
    assert len(set(to)) == n
    best = min((sum(abs(a - y[j]) for a, j in zip(x, pick)) for pick in itertools.permutations(range(m), n)), default=0)
    assert sum(abs(a - y[j]) for a, j in zip(x, to)) == pytest.approx(best)


def test_runs_and_bridges(spark):
    marked = spark.createDataFrame([("s", i) for i in (0, 1, 4, 5, 9)], "k string, i int")
    rows = lambda tol: sorted(tuple(r) for r in sequence.runs(marked, ["k"], "i", tol).select("start", "stop", "n").collect())
    assert rows(0) == [(0, 2, 2), (4, 6, 2), (9, 10, 1)] and rows(2) == [(0, 6, 4), (9, 10, 1)] and rows(3) == [(0, 10, 5)]


def test_openings_find_a_door(spark):
    cells = [("w", c, r) for c in range(12) for r in range(20) if not (4 <= c <= 7 and r < 15)]
    columns = sequence.flanked(sequence.columns_of(spark.createDataFrame(cells, "k string, col int, row int"), ["k"], 12, 20), ["k"], 7, 6)
    doors = sequence.openings(columns, ["k"], F.col("observed") & (F.col("clearance") >= 8), 2, (2, 6)).select("start", "stop").distinct().collect()
    assert [tuple(d) for d in doors] == [(4, 8)]
    edge = columns.filter("col >= 4")  # nothing to the left: not flanked
    assert sequence.openings(sequence.flanked(edge.drop("left", "right"), ["k"], 7, 6), ["k"], F.col("observed") & (F.col("clearance") >= 8), 2, (2, 6)).count() == 0


def merged_by_loop(unit, cut, least):
    cuts = [i + 1 for i in range(len(unit) - 1) if unit[i] @ unit[i + 1] < cut]
    runs = [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, len(unit)])]
    again = True
    while again and len(runs) > 1:
        again = False
        for i, run in enumerate(runs):
            if len(run) >= least:
                continue
            if 0 < i < len(runs) - 1:
                to = i - 1 if unit[run[0]] @ unit[runs[i - 1][-1]] >= unit[run[-1]] @ unit[runs[i + 1][0]] else i + 1
            else:
                to = i - 1 if i else i + 1
            runs[to] = sorted(runs[to] + run)
            runs.pop(i)
            again = True
            break
    return [s for s, run in enumerate(runs) for _ in run]


@pytest.mark.parametrize("least", [2, 4])
def test_merged_segments(spark, least):
    rng = np.random.default_rng(least)
    v = rng.normal(size=(60, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(v)], "k string, i long, v array<double>")
    got = [r["segment"] for r in sequence.merged_segments(df, ["k"], "i", "v", 0.3, least).orderBy("i").collect()]
    assert got == merged_by_loop(v, 0.3, least)


def test_interval_subtraction(spark):
    wholes = spark.createDataFrame([("a", 0, 10), ("b", 0, 5), ("c", 0, 3)], "k string, lo int, hi int")
    cuts = spark.createDataFrame([("a", 2, 4), ("a", 3, 6), ("a", 9, 12), ("c", -1, 9)], "k string, start int, stop int")
    got = sorted(tuple(r) for r in sequence.subtracted(wholes, cuts, ["k"]).collect())
    assert got == [("a", 0, 2), ("a", 6, 9), ("b", 0, 5)]


def test_radius_and_ratio_pairs_against_loops(spark):
    rng = random.Random(4)
    pts = [(i % 2, i, rng.random(), rng.random(), rng.random() - 0.5) for i in range(120)]
    got = {(r["i"], r["j"]) for r in spatial.radius_pairs(spark.createDataFrame(pts, "k int, i int, x double, y double, z double"), ["k"], "i", ["x", "y", "z"], 0.2, 3).collect()}
    want = {(a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and b[1] - a[1] >= 3 and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 0.04}
    assert got == want and want
    vals = [(i, rng.choice([0.0, rng.uniform(0.1, 9), 1.0, 0.85])) for i in range(150)]
    rows = spatial.ratio_pairs(spark.createDataFrame(vals, "i int, v double").withColumn("k", F.lit(1)), ["k"], "i", "v", 0.15).collect()
    want = {(a, b) for a, x in vals for b, y in vals if a < b and x > 0 and y > 0 and abs(x - y) <= 0.15 * max(x, y)}
    assert {(r["a"], r["b"]) for r in rows} == want and len(rows) == len(want)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60) if i != 30] + [(100, 101), (7, 3)]
    nodes = sorted({x for e in edges for x in e} | {999})
    random.Random(0).shuffle(edges)
    got = dict(map(tuple, graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: 0 if n <= 30 else 31 if n <= 60 else 100 if n < 200 else 999 for n in nodes}


def test_components_of_a_path_that_descends_away_from_its_least_node(spark):
    path = [0, *range(100, 0, -1)]  # the least label has to walk against ever lower neighbours
    edges = [*zip(path, path[1:]), (200, 200), (201, 300), (300, None)]
    nodes = [(n,) for n in [*path, 200, 201, 202]]  # 300 is no node: it joins nothing
    got = graph.components(spark.createDataFrame(nodes, "node long"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [*((n, 0) for n in range(101)), (200, 200), (201, 201), (202, 202)]


def test_components_of_random_forests(spark):
    rng = random.Random(3)
    edges = [(n, rng.randrange(max(0, n - 3), n)) for n in range(1, 400) if rng.random() < 0.97]
    name = rng.sample(range(1000), 400)
    root = list(range(400))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    least = {}
    for n in range(400):
        least[find(n)] = min(least.get(find(n), 1000), name[n])
    got = graph.components(spark.createDataFrame([(n,) for n in name], "node long"), spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a long, b long")).collect()
    assert dict(map(tuple, got)) == {name[n]: least[find(n)] for n in range(400)} and len(got) == 400


def test_pose_graph_closes_a_loop():
    n = 40
    t = 2 * np.pi * np.arange(n) / (n - 1)
    true = np.column_stack([np.cos(t), np.sin(t), 0 * t, t])
    d = true[1:, :3] - true[:-1, :3]
    c, s = np.cos(true[:-1, 3]), np.sin(true[:-1, 3])
    turn = np.diff(true[:, 3]) + 0.004  # drift in every step
    edges = np.column_stack([np.arange(n - 1), np.arange(1, n), c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1], d[:, 2], turn])
    start = np.zeros((n, 4))
    start[0] = true[0]
    for i in range(n - 1):
        c, s = np.cos(start[i, 3]), np.sin(start[i, 3])
        start[i + 1] = start[i] + [c * edges[i, 2] - s * edges[i, 3], s * edges[i, 2] + c * edges[i, 3], 0, turn[i]]
    gap = np.linalg.norm(start[-1, :3] - start[0, :3])
    out = solve.solve_pose_graph(start, np.vstack([edges, [0, n - 1, 0, 0, 0, 0]]), np.append(np.full(n - 1, 10.0), 100.0))
    assert gap > 0.05 and np.linalg.norm(out[-1, :3] - out[0, :3]) < gap / 20
    assert np.allclose(out[0], start[0])


def test_lines_are_peeled_in_order_of_support():
    rng = np.random.default_rng(0)
    perp = np.concatenate([rng.normal(1.0, 0.01, 400), rng.normal(3.0, 0.01, 250), rng.uniform(0, 5, 60)])
    lines = solve.peel(perp, rng.uniform(0, 4, perp.size), rng.uniform(0, 2, perp.size), 0.05, 150, 0.6, 14)
    assert [round(x[0], 1) for x in lines] == [1.0, 3.0] and lines[0][3] >= 395


def test_sets_grow_as_they_merge(spark):
    sets = [("s", 1, list(range(10))), ("s", 2, [9, 20, 21, 22, 23]), ("s", 3, [23, 30]), ("s", 4, [50, 51])]
    got = dict((r["i"], r["into"]) for r in solve.merge_sets(spark.createDataFrame(sets, "k string, i int, m array<int>"), ["k"], "i", "m", 0.15).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_leaders_and_convex_clips(spark):
    rows = [(1, [1.0, 0.0], 0.0), (2, [0.99, 0.1], 0.3), (3, [0.0, 1.0], 0.0), (4, [1.0, 0.0], 0.5), (5, [0.98, 0.15], 0.6)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, i int, v array<double>, o double")
    assert {r["i"]: r["leader"] for r in views.leaders(df, ["k"], "i", "v", "o").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], dtype=float)
    assert solve.clip_convex(square, square + 1) == pytest.approx(1.0) and solve.clip_convex(square, square + 5) == 0.0


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(9)
    rows = [("s", i, rng.choice([1.0, 2.0, 2.0]), float(rng.randint(0, 3))) for i in range(200)]
    run = lambda data: sorted(map(str, sequence.bucket_argmax(spark.createDataFrame(data, "k string, i long, s double, w double").repartition(7), ["k"], "i", "s", 3, 1.0, 8).collect()))
    first = run(rows)
    rng.shuffle(rows)
    assert run(rows) == first and len(first) == 8


def test_cross_checked_claims_once(spark):
    rows = lambda data: spark.createDataFrame(data, "w string, place int, kind string, start double, stop double, score double")
    geo = rows([("a", 1, "door", 0.0, 1.0, 0.5), ("a", 2, "door", 0.1, 1.1, 0.5), ("b", 1, "door", 0.0, 1.0, 0.9)])
    sem = rows([("a", 1, "window", 0.0, 1.0, 0.4), ("a", 2, "door", 5.0, 5.8, 0.5), ("a", 3, "door", 8.0, 8.3, 0.9), ("c", 1, "window", 0.0, 2.0, 0.5)])
    got = sorted((r["w"], r["start"], r["sources"], round(r["score"], 3), r["note"]) for r in rooms.cross_checked(geo, sem, ["w"]).collect())
    assert got == [("a", 0.0, "geometry+semantic", 0.56, "door or window"), ("a", 0.1, "geometry", 0.5, ""), ("a", 5.0, "semantic", 0.4, ""), ("b", 0.0, "geometry", 0.9, ""), ("c", 0.0, "semantic", 0.4, "")]


def test_pairs_where_one_side_is_missing(spark):
    rows = lambda data: spark.createDataFrame(data, "g string, v double, id long")
    got = assignment.min_cost_pairs(rows([("a", 1.0, 1), ("b", 1.0, 2)]), rows([("a", 2.0, 7), ("a", 9.0, 8), ("c", 1.0, 9)]), "g", "v", "id").collect()
    assert sorted((r["g"], r["left"] or 0, r["right"] or 0, r["cost"]) for r in got if r["cost"] is not None) == [("a", 1, 7, 1.0)]
    assert sorted((r["g"], r["left"] or 0, r["right"] or 0) for r in got if r["cost"] is None) == [("a", 0, 8), ("b", 2, 0), ("c", 0, 9)]


def test_shapes_are_pushed_apart():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], dtype=float)
    shapes = [square, square + [0.5, 0.2], square + [1.5, -0.4]]
    shift, done = layout.moves_apart(shapes)
    assert done and (shift[0] == 0).all()
    assert max(solve.clip_convex(a + s, b + t) for (a, s), (b, t) in itertools.combinations(zip(shapes, shift), 2)) <= 1e-6


def test_rings_of_an_arrangement(spark):
    """A ring with a hole, and a cell that touches it at a corner: areas add up to the cells'."""
    cells = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(3, 3)]
    df = spark.createDataFrame([("k", float(x), x + 1.0, float(y), y + 1.0) for x, y in cells], "k string, u0 double, u1 double, v0 double, v1 double")
    found = {}
    for r in rooms.rings(rooms.boundary_edges(df, ["k"]), ["k"]).orderBy("ring", "place").collect():
        found.setdefault(r["ring"], []).append((r["x"], r["y"]))
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2
    assert sorted(map(area, found.values())) == [-1.0, 1.0, 9.0]
    assert sorted(map(len, found.values())) == [4, 4, 4]


def test_normals_of_planes_across_blocks(spark):
    rng = np.random.default_rng(3)
    flat = [(i, x, y, 0.001 * e) for i, (x, y, e) in enumerate(rng.uniform(-1, 1, (400, 3)).tolist())]
    upright = [(1000 + i, 5 + 0.001 * e, x, y) for i, (x, y, e) in enumerate(rng.uniform(-1, 1, (400, 3)).tolist())]
    df = spark.createDataFrame([("k", *r) for r in [*flat, *upright, (9999, 50.0, 50.0, 50.0)]], "k string, i int, x double, y double, z double")
    got = {r["i"]: r for r in rooms.point_normals(df, ["k"], "i", ("x", "y", "z"), 0.3).collect()}
    assert len(got) == 801 and got[9999]["neighbours"] == 1
    assert all(got[i]["nz"] > 0.99 for i in range(400) if got[i]["neighbours"] > 4)
    assert all(got[i]["nx"] > 0.99 for i in range(1000, 1400) if got[i]["neighbours"] > 4)
    p = np.array([r[1:] for r in flat])
    assert all(got[i]["neighbours"] == min(30, ((p - p[i]) ** 2).sum(axis=1).__le__(0.09).sum()) for i in range(400))


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.75, 1.0])
def test_overlapping_sets_against_all_pairs(spark, share):
    rng = random.Random(5)
    sets = {s: {rng.randrange(25) for _ in range(rng.randint(1, 9))} | ({99} if s % 3 else set()) for s in range(60)}  # 99 stands in most
    sets[60], sets[61] = set(sets[1]), {1000}
    rows = [(s, m) for s, ms in sets.items() for m in ms]
    df = spark.createDataFrame([*rows, *rows[:20], (None, 3), (5, None)], "s int, m int")
    got = {tuple(r) for r in spatial.overlapping_sets(df, "s", "m", share).collect()}
    want = {(a, b, len(x & y), len(x & y) / min(len(x), len(y))) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and len(x & y) >= share * min(len(x), len(y))}
    assert got == want


def test_a_member_of_every_set_makes_no_candidates(spark):
    rows = [(s, m) for s in range(400) for m in (-1, *range(s * 10, s * 10 + 6))]  # 400 sets share -1 alone
    assert spatial.overlapping_sets(spark.createDataFrame(rows, "s int, m int"), "s", "m", 0.5).collect() == []


@pytest.mark.parametrize("gap, most", [(15, 12), (15, 2), (4, 50), (1, 5)])
def test_spaced_pairs_against_one_by_one(spark, gap, most):
    rng = random.Random(gap)
    rows = [(k, i, i + rng.randint(15, 60)) for k in ("a", "b", None) for i in [rng.randrange(90) for _ in range(120)]] + [("one", 3, 40), ("one", 3, 40)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame([*rows, ("a", None, 3), ("a", 1, None)], "k string, i int, j int")
    want = []
    for k in ("a", "b", None, "one"):
        used = []
        for _, i, j in sorted(((-abs(i - j), i, j) for k2, i, j in rows if k2 == k)):
            if len(used) < most and all(abs(i - u) >= gap // 2 for u in used):
                want.append((k, i, j, len(used)))
                used.append(i)
    assert sorted(map(tuple, sequence.spaced_pairs(df, ["k"], gap, most).collect()), key=str) == sorted(want, key=str)


def test_spaced_pairs_of_nothing(spark):
    assert sequence.spaced_pairs(spark.createDataFrame([], "k int, i int, j int"), ["k"], 15, 12).collect() == []


def test_pose_graph_of_many_poses_needs_no_square_of_them():
    n = 20_000
    rng = np.random.default_rng(4)
    moves = np.column_stack([rng.normal(0, 0.1, (n - 1, 3)), rng.normal(0, 0.02, n - 1)])
    start = solve._walked(np.zeros(4), moves)
    k = np.arange(n - 1)
    far = np.array([[100, 15_000, 0.5, 0.2, 0, 0.1], [4000, 9000, 0, 0, 0, 0]]) + np.pad(solve._seen(start, np.array([100, 4000]), np.array([15_000, 9000])), ((0, 0), (2, 0)))
    edges, weights = np.vstack([np.column_stack([k, k + 1, moves]), far]), np.append(np.full(n - 1, 10.0), [1.0, 1.0])
    out = solve.solve_pose_graph(start, edges, weights)
    a, b = edges[:, 0].astype(int), edges[:, 1].astype(int)

    def cost(pose):
        r = solve._seen(pose, a, b) - edges[:, 2:6]
        r[:, 3] = solve._turned(r[:, 3])
        return ((weights[:, None] * r) ** 2).sum()

    assert cost(out) < 0.2 * cost(start)
    for _ in range(5):  # no move nearby fits better
        assert cost(solve._walked(np.zeros(4), solve._seen(out, k, k + 1) + rng.normal(0, 1e-4, (n - 1, 4)) * (rng.random((n - 1, 1)) < 1e-3))) >= cost(out)


@pytest.mark.parametrize("first", [2, 5, 1000])
def test_longest_near_equals_all_pairs_spaced(spark, first):
    rng = random.Random(first)
    rows = [(k, 3 * i + (k == "b"), *[rng.uniform(0, 1.0 if k == "a" else 3.0) for _ in range(2)]) for k in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "k string, n long, x double, y double")
    pairs = spatial.radius_pairs(df, ["k"], "n", ["x", "y"], 0.2, 15).select("k", "i", "j")
    want = sorted(map(tuple, sequence.spaced_pairs(pairs, ["k"], 15, 4).collect()))
    assert want and sorted(map(tuple, sequence.longest_near(df, ["k"], "n", ["x", "y"], 0.2, 15, 4, first).collect())) == want


def spaced_one_by_one(pairs, gap):
    used = []
    for i, j in sorted(set(pairs), key=lambda p: (-abs(p[0] - p[1]), *p)):
        if all(abs(i - u) >= gap // 2 for u, _ in used):
            used.append((i, j))
    return used


@pytest.mark.parametrize("gap", [15, 4, 1])
def test_spaced_pairs_without_a_cap_are_all(spark, gap):
    rng = random.Random(gap)
    rows = list(dict.fromkeys((k, i, i + rng.randint(15, 60)) for k in ("a", None) for i in [rng.randrange(300) for _ in range(400)]))
    got = sequence.spaced_pairs(spark.createDataFrame([*rows, ("a", None, 3), ("a", 1, None)], "k string, i int, j int"), ["k"], gap)
    want = [(k, *p, place) for k in ("a", None) for place, p in enumerate(spaced_one_by_one([r[1:] for r in rows if r[0] == k], gap) if gap > 1 else sorted((r[1:] for r in rows if r[0] == k), key=lambda p: (p[0] - p[1], *p)))]
    assert len(want) > 60 and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("first", [2, 5, 1000])
def test_longest_near_without_a_cap_equals_all_pairs_spaced(spark, first):
    rng = random.Random(first)
    rows = [(k, 3 * i - 40, *[rng.uniform(0, 3.0 if k else 1.0) for _ in range(2)]) for k in (0, 1, None) for i in range(150)] + [(2, i, 0.5, 0.5) for i in range(80)] + [(3, 1, 0.0, 0.0)]
    df = spark.createDataFrame([*rows, (0, None, 0.5, 0.5), (0, 500, None, 0.5), (0, 501, float("nan"), 0.5)], "k int, n long, x double, y double")
    want, last = [], []
    for k in (0, 1, None, 2, 3):
        of = [r[1:] for r in rows if r[0] == k]
        near = [(a[0], b[0]) for a in of for b in of if b[0] - a[0] >= 15 and math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.2]
        last += [(k, i, max(q for p, q in near if p == i)) for i in {p for p, _ in near}]
        want += [(k, *p, place) for place, p in enumerate(spaced_one_by_one(near, 15))]
    assert sorted(map(tuple, sequence.last_near(df, ["k"], "n", ["x", "y"], 0.2, 15, first).collect()), key=str) == sorted(last, key=str)
    assert len(want) > 60 and sorted(map(tuple, sequence.longest_near(df, ["k"], "n", ["x", "y"], 0.2, 15, first=first).collect()), key=str) == sorted(want, key=str)


def test_pose_graph_closes_every_spaced_revisit(spark):
    rng, n = np.random.default_rng(2), 420  # seven laps of 60 frames that drift
    t = 2 * np.pi * np.arange(n) / 60
    pose = np.column_stack([np.cos(t), np.sin(t), 0 * t, solve._turned(t)]) + rng.normal(0, 2e-4, (n, 4)).cumsum(axis=0)
    df = spark.createDataFrame([("lap", i, *map(float, p)) for i, p in enumerate(pose)], "k string, n int, a double, b double, c double, d double")
    out = solve.pose_graph(df, ["k"], "n", ["a", "b", "c"], "d", 0.12).orderBy("n").toPandas()
    far = np.sqrt(((pose[:, None, :3] - pose[None, :, :3]) ** 2).sum(axis=2))
    used = spaced_one_by_one([(i, j) for i in range(n) for j in range(i + 15, n) if far[i, j] <= 0.12], 15)
    assert len(used) > 40 and set(out["closures"]) == {len(used)}
    i, j = np.array(used).T
    k = np.arange(n - 1)
    steps = solve._seen(pose, k, k + 1)
    steps[:, 3] = solve._turned(steps[:, 3])

    def cost(moves):
        tried = solve._walked(pose[0], moves)
        r = solve._seen(tried, i, j)
        r[:, 3] = solve._turned(r[:, 3])
        return 100 * ((moves - steps) ** 2).sum() + (r**2).sum()

    got = out[["x", "y", "z", "yaw"]].to_numpy()
    moves = solve._seen(got, k, k + 1)
    moves[:, 3] = steps[:, 3] + solve._turned(moves[:, 3] - steps[:, 3])
    assert np.allclose(got[0], pose[0]) and cost(moves) < 0.5 * cost(steps)
    for _ in range(20):  # no move nearby fits better
        assert cost(moves + rng.normal(0, 1e-5, moves.shape)) >= cost(moves)


def test_pose_graph_of_many_closures_needs_no_square_of_them():
    n = 6000
    rng = np.random.default_rng(6)
    start = solve._walked(np.zeros(4), np.column_stack([rng.normal(0, 0.05, (n - 1, 3)), rng.normal(0, 0.02, n - 1)]))
    i = np.arange(0, n - 1000, 5)
    j = i + rng.integers(15, 900, len(i))
    k = np.arange(n - 1)
    edges = np.vstack([np.column_stack([k, k + 1, solve._seen(start, k, k + 1)]), np.column_stack([i, j, solve._seen(start, i, j) + rng.normal(0, 0.1, (len(i), 4))])])
    tracemalloc.start()
    out = solve.solve_pose_graph(start, edges, np.append(np.full(n - 1, 10.0), np.ones(len(i))), rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(out).all() and peak < 40e6  # a square of the closures' equations is 128 MB


@pytest.mark.parametrize("accuracy", [4, 10_000])
def test_exact_quantiles_equal_percentile_without_holding_a_key(spark, accuracy):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -1.5, rng.uniform(-9, 9), rng.gauss(0, 1e6)])) for _ in range(3000)] + [("one", 2.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = calibration.exact_quantiles(df, ["k"], "v", q, "q", accuracy)
        assert sorted(map(str, got.collect())) == sorted(map(str, df.groupBy("k").agg(F.percentile("v", q).alias("q")).collect()))
    factors = calibration.fit_factors(df.select("k", F.abs("v").alias("error"), F.lit(1.0).alias("half_width")), ["k"])
    plan = factors._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "_percentile(" not in plan


@pytest.mark.parametrize("size", [7, 1000])
def test_blocks_let_every_pair_meet_once(spark, size):
    rows = [(k, i) for k in "ab" for i in range(40)]
    groups = {}
    for r in spatial.block_pairs(spark.createDataFrame(rows, "k string, i long"), ["k"], "i", size).collect():
        groups.setdefault((r["k"], r["__p"], r["__q"]), ([], []))[0 if r["__own"] else 1].append(r["i"])
    met = []
    for (k, p, q), (own, other) in groups.items():
        met += [(k, *x) for x in itertools.combinations(sorted(own), 2)] if p == q else [(k, min(a, b), max(a, b)) for a in own for b in other]
        assert p != q or not other
    assert sorted(met) == [(k, *x) for k in "ab" for x in itertools.combinations(range(40), 2)]
    assert size > 40 or max(len(a) + len(b) for a, b in groups.values()) < 40  # no group holds a key


def test_alike_pairs_and_overlap_counts_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 6))
    got = spatial.alike_pairs(spark.createDataFrame([("k", i, x.tolist()) for i, x in enumerate(v)], "k string, i long, v array<float>"), ["k"], "i", "v", 0.5).collect()
    v = v.astype("float32").astype(float)
    cos = v @ v.T / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1)))
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in got) == [(a, b, round(float(cos[a, b]), 9)) for a, b in itertools.combinations(range(60), 2) if cos[a, b] >= 0.5]
    boxes = [(i, *map(float, rng.uniform(0, 3, 2)), *map(float, rng.uniform(0, 1, 2))) for i in range(80)]
    boxes = [(i, x, y, x + w, y + h) for i, x, y, w, h in boxes] + [(99, 1.0, 1.0, None, 2.0)]
    want = {}
    for (a, ax0, ay0, ax1, ay1), (b, bx0, by0, bx1, by1) in itertools.combinations(boxes[:-1], 2):
        w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
        if w > 0 and h > 0:
            n, worst = want.get(a, (0, 0.0))
            want[a] = (n + 1, max(worst, w * h))
    assert {r["a"]: (r["n"], r["worst"]) for r in spatial.overlap_counts(spark.createDataFrame(boxes, "i long, x0 double, y0 double, x1 double, y1 double"), "i").collect()} == want


def test_nearest_line_sorts_walls_and_lines(spark):
    walls = spark.createDataFrame([("k", i, i / 2, 0.0, i / 2, 5.0) for i in range(40)], "k string, wall int, ax double, ay double, bx double, by double")
    lines = spark.createDataFrame([("k", n, 0, float(c)) for n, c in ((9, 2), (4, 2), (3, 4), (7, 9), (1, 16))] + [("k", 0, 1, 3.0)], "k string, line int, axis int, coord double")
    near = rooms.nearest_line(walls, lines, ["k"], 3.0)
    want = [(i, *min((abs(i / 2 - c), n) for n, c in ((9, 2), (4, 2), (3, 4), (7, 9), (1, 16)))) for i in range(40)]
    assert sorted((r["wall"], r["distance"], r["line"]) for r in near.collect()) == [w for w in want if w[1] <= 3.0]
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()  # walls of a key never meet all its lines
