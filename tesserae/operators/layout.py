"""Layouts of rooms: from points to rings, from rings and walls to surfaces, and rings kept apart."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.geometry import rotated
from tesserae.operators import grid, histogram, rectilinear, rooms, sequence, solve, spatial, stitching
from tesserae.session import Steps

#: Fixed values of the measurement protocol: the cosine with up below which a normal is that of a
#: wall; pixels and share of the frame of a plausible mask; points and share of columns of a wall
#: that openings are claimed in; margin of surfaces and of the test whether they hold a place; bounds
#: of severity.
WALL_COSINE = 0.35
MASK_PIXELS, MASK_SHARE = 200, 0.35
WALL_POINTS, WALL_OBSERVED = 200, 0.30
SURFACE_MARGIN, INSIDE_MARGIN = 0.10, 0.05
#: Floor this near to the camera's path counts as seen.
PATH_RADIUS = 0.35
SEVERITY_LEAST, SEVERITY_MOST = 0.3, 1.0


def upright(nx: Column, ny: Column, nz: Column, up: tuple[float, float, float], most: float = WALL_COSINE) -> Column:
    """Whether a unit normal is level enough to be a wall's; null normals are not."""
    return F.coalesce(F.abs(nx * up[0] + ny * up[1] + nz * up[2]) < most, F.lit(False))


def plausible_masks(masks: DataFrame, pixels: str, frame_pixels: str, least: int = MASK_PIXELS, most: float = MASK_SHARE) -> DataFrame:
    """masks with plausible: neither too small to be measured nor as large as the surface itself."""
    covered = F.coalesce(F.col(pixels), F.lit(0))
    fits = (F.col(frame_pixels) > 0) & (covered >= least) & (covered <= most * F.col(frame_pixels))
    return masks.withColumn("plausible", F.coalesce(fits, F.lit(False)))


def mask_counts(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Kept and rejected masks a key, of plausible_masks."""
    return masks.groupBy(*keys).agg(F.count_if("plausible").alias("kept"), F.count_if(~F.col("plausible")).alias("rejected"))


def holds(u: Column, v: Column, u_extent: Column, v_extent: Column, margin: float = INSIDE_MARGIN) -> Column:
    """Whether a place on a surface lies inside its extents, or no more than the margin outside."""
    return u.between(F.lit(-margin), u_extent + margin) & v.between(F.lit(-margin), v_extent + margin)


def claimable_walls(columns: DataFrame, points: DataFrame, keys: list[str], least: int = WALL_POINTS, share: float = WALL_OBSERVED) -> DataFrame:
    """(keys, n, observed): walls with enough points (keys, n) and enough observed columns
    (sequence.columns_of) for openings to be claimed in them."""
    seen = columns.groupBy(*keys).agg(F.avg(F.col("observed").cast("double")).alias("observed"))
    return points.join(seen, keys).filter((F.col("n") >= least) & (F.col("observed") >= share)).select(*keys, "n", "observed")


def angle_clusters(rows: DataFrame, keys: list[str], angle: Column, tie: str, gap: float = math.radians(20)) -> DataFrame:
    """rows with theta, the angle modulo pi, and cluster: sorted by theta, a gap of more than `gap`
    starts one. Clusters do not wrap around."""
    return sequence.clusters_1d(rows.withColumn("theta", F.pmod(angle, F.lit(math.pi))), keys, "theta", tie, gap)


def severity(area: Column) -> Column:
    return F.least(F.lit(SEVERITY_MOST), F.lit(SEVERITY_LEAST) + area)


def edge_distance(kind: Column, box: tuple[Column, Column, Column, Column], u_extent: Column, v_extent: Column) -> Column:
    """From a region's box (u0, v0, u1, v1) on a ceiling to the nearest edge of it, where it meets a
    wall; null on other surfaces."""
    u0, v0, u1, v1 = box
    beyond = [F.greatest(F.lit(0.0), e - x) for e, x in ((u_extent, u1), (v_extent, v1))]
    return F.when(kind == "ceiling", F.least(u0, v0, *beyond))


def _along(start: Column, *steps: tuple[Column, Column]) -> Column:
    """start plus axes (arrays of three) times lengths."""
    times = lambda length: lambda a, b: a + b * length
    for axis, length in steps:
        start = F.zip_with(start, axis, times(length))
    return start


def surfaces(walls: DataFrame, frames: DataFrame, keys: list[str], margin: float = SURFACE_MARGIN) -> DataFrame:
    """Bounded surfaces of rooms. walls: keys, wall, au, av, bu, bv (ends in the floor's axes), nu, nv
    (outward normal), has_opening. frames, one row a room: keys, origin, e1, e2, up (arrays of three),
    ceiling, area. Walls without length have none; the floor and the ceiling reach a margin beyond
    the walls' box, so that rays which pass the room land on neither.

    (keys, kind, wall, origin, normal, u_axis, v_axis, u_extent, v_extent, area, has_opening)"""
    c = F.col
    size = F.sqrt((c("bu") - c("au")) ** 2 + (c("bv") - c("av")) ** 2)
    joined = walls.withColumn("__l", size).filter("__l > 0").join(frames, keys)
    length, out = c("__l"), F.sqrt(c("nu") ** 2 + c("nv") ** 2)
    nothing = F.array(*[F.lit(0.0)] * 3)
    columns = ["kind", "wall", "origin", "normal", "u_axis", "v_axis", "u_extent", "v_extent", "area", "has_opening"]
    upright_ones = joined.select(
        *keys, F.lit("wall"), "wall", _along(c("origin"), (c("e1"), c("au")), (c("e2"), c("av"))), _along(nothing, (c("e1"), -c("nu") / out), (c("e2"), -c("nv") / out)),
        _along(nothing, (c("e1"), (c("bu") - c("au")) / length), (c("e2"), (c("bv") - c("av")) / length)), c("up"), length, c("ceiling"), length * c("ceiling"), F.coalesce("has_opening", F.lit(False)))
    low = lambda a, b: F.min(F.least(a, b)) - margin
    span = lambda a, b: F.max(F.greatest(a, b)) - F.min(F.least(a, b)) + 2 * margin
    box = walls.groupBy(*keys).agg(low("au", "bu").alias("__u"), low("av", "bv").alias("__v"), span("au", "bu").alias("__du"), span("av", "bv").alias("__dv")).join(frames, keys)
    level = box.withColumn("__k", F.explode(F.array(F.lit("floor"), F.lit("ceiling"))))
    top = c("__k") == "ceiling"
    level_ones = level.select(
        *keys, "__k", F.lit(None).cast(walls.schema["wall"].dataType), _along(c("origin"), (c("e1"), c("__u")), (c("e2"), c("__v")), (c("up"), F.when(top, c("ceiling")).otherwise(0.0))),
        _along(nothing, (c("up"), F.when(top, -1.0).otherwise(1.0))), c("e1"), c("e2"), c("__du"), c("__dv"), c("area"), F.lit(False))
    return upright_ones.toDF(*keys, *columns).unionByName(level_ones.toDF(*keys, *columns))


def extract_layout(points: DataFrame, path: DataFrame, keys: list[str], index: str, band: tuple[float, float], radius: float = 0.12, tolerance: float = 0.05, least: int = 150, gap: float = 0.15, cell: float = 0.10) -> DataFrame:
    """(keys, ring, place, x, y): the outer ring of each room, from points (keys, index, x, y, h over the
    floor) and the camera's path (keys, x, y).

    Points of the height band whose normal is upright give the walls' direction modulo a right angle.
    In its axes, lines are peeled off points whose normal is across them, lines closer than `gap`
    are one cut, lines keep their cut if points support them, and the cells between cuts that were
    walked through or lie in the inside (grid.interior of the floor and the path) make the room, whose walked part is cleaned and its outline turned back."""
    wall = points.filter(F.col("h").between(*band))
    normals = rooms.point_normals(wall, keys, index, ("x", "y", "h"), radius).filter(upright(F.col("nx"), F.col("ny"), F.col("nz"), (0.0, 0.0, 1.0)))
    turn = spatial.circular_mean(normals, keys, F.atan2("ny", "nx")).select(*keys, F.col("angle").alias("__turn"))
    into = lambda df: df.join(turn, keys).withColumns(dict(zip(("u", "v"), rotated(F.col("x"), F.col("y"), -F.col("__turn")))))
    faced = into(wall.join(normals.select(*keys, index, "nx", "ny"), [*keys, index]))
    across = F.abs(F.cos(F.atan2("ny", "nx") - F.col("__turn")))
    sided = faced.withColumn("axis", F.when(across > math.cos(math.pi / 4), 0).otherwise(1))
    sided = sided.select(*keys, "axis", F.when(F.col("axis") == 0, F.col("u")).otherwise(F.col("v")).alias("perp"), F.when(F.col("axis") == 0, F.col("v")).otherwise(F.col("u")).alias("along"), "h")
    lines = solve.peel_lines(sided, [*keys, "axis"], "perp", "along", "h", tolerance, least)
    merged = sequence.clusters_1d(lines, [*keys, "axis"], "coord", "line", gap).groupBy(*keys, "axis", "cluster")
    merged = merged.agg((F.sum(F.col("coord") * F.col("inliers")) / F.sum("inliers")).alias("coord"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    merged = merged.withColumn("line", F.col("cluster") * 2 + F.col("axis"))
    held = rooms.line_support(into(wall).select(*keys, F.col("u").alias("x"), F.col("v").alias("y"), "h"), merged, keys, 2 * tolerance, least)
    cuts = merged.join(held.select(*keys, "line"), [*keys, "line"]).select(*keys, "axis", F.col("coord").alias("at"))
    low = into(points.filter(F.col("h") < band[0]))
    walked = into(path).select(*keys, F.col("u").alias("x"), F.col("v").alias("y"))
    seen, trodden = histogram.cells_of(low, keys, F.col("u"), F.col("v"), cell), histogram.cells_of(walked, keys, F.col("x"), F.col("y"), cell)
    floor = grid.cells(grid.interior(seen, trodden, keys, round(PATH_RADIUS / cell)), keys)
    outline = rectilinear.plan_outline(rooms.cell_arrangement(cuts, floor, walked, keys, cell), walked, keys)
    back = rotated(F.col("x"), F.col("y"), F.col("__turn"))
    return outline.join(turn, keys).select(*keys, F.lit(0).alias("ring"), "place", back[0].alias("x"), back[1].alias("y"))


def lifted_matches(matches: DataFrame, keys: list[str], side: str, origin: str = "origin") -> DataFrame:
    """matches with {side}_x, {side}_y: the pixel {side}_u, {side}_v at {side}_depth, by the camera
    {side}_fx, {side}_fy, {side}_cx, {side}_cy and its pose {side}_pose (rows of a 3 by 4 matrix, flat),
    on the floor axes {side}_e1, {side}_e2 from {side}_origin. Depths that are not positive have null places."""
    c = lambda name: F.col(f"{side}_{name}")
    depth = F.when(c("depth") > 0, c("depth"))
    seen = ((c("u") - c("cx")) / c("fx") * depth, (c("v") - c("cy")) / c("fy") * depth, depth)
    world = [sum((c("pose")[4 * r + k] * seen[k] for k in range(3)), start=c("pose")[4 * r + 3]) for r in range(3)]
    on = lambda axis: sum(((world[k] - c(origin)[k]) * c(axis)[k] for k in range(3)), start=F.lit(0.0))
    return matches.withColumn(f"{side}_x", on("e1")).withColumn(f"{side}_y", on("e2"))


def stitch_graph(matches: DataFrame, doorways: DataFrame, corners: DataFrame, room: str, limit: float = 0.25, gap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Edges between rooms, and where every room stands in the plan: (room, component, x, y, yaw, settled).

    matches: a, b (rooms), a_x, a_y, b_x, b_y (lifted_matches on both sides), weight. Matched places
    are fitted by a rigid move that is fitted again on its inliers; inliers and a doorway make an
    edge or a reason why there is none. doorways: a, b, the door's middle and outward normal in either room (ax, ay,
    anx, any, bx, by, bnx, bny); of several of a pair the first by these counts, and its move goes before the matches'.
    corners: room, place, x, y: convex rings whose sides are the walls.

    Moves are composed along trees and relaxed where they close circles; each component is turned onto the
    axes, its rooms are moved off each other, the least one staying, and components stand beside each other in
    the order of their least room."""
    fitted = matches.filter(F.col("a_x").isNotNull() & F.col("b_x").isNotNull())
    moves = spatial.procrustes_refit(fitted, ["a", "b"], ("a_x", "a_y"), ("b_x", "b_y"), "weight", limit).select("a", "b", "yaw", "tx", "ty", "inliers")
    sides = ["ax", "ay", "anx", "any", "bx", "by", "bnx", "bny"]
    doors = doorways.groupBy("a", "b").agg(F.min(F.struct(*sides)).alias("d")).select("a", "b", "d.*")
    doors = rooms.doorway_transforms(doors).select("a", "b", F.lit(True).alias("doorway"), *[F.col(c).alias(f"door_{c}") for c in ("tx", "ty", "yaw")])
    pairs = matches.select("a", "b").union(doorways.select("a", "b")).distinct().join(moves, ["a", "b"], "left").join(doors, ["a", "b"], "left")
    edges = rooms.stitch_edges(pairs.withColumn("inliers", F.coalesce("inliers", F.lit(0))), "inliers", "doorway")
    edges = edges.select("a", "b", "source", "confidence", "reason", "inliers", *[F.coalesce(f"door_{c}", c).alias(n) for c, n in (("tx", "x"), ("ty", "y"), ("yaw", "yaw"))])
    steps = Steps(edges.sparkSession)
    edges = steps.keep(edges, "edges")
    used = edges.filter(F.col("source").isNotNull()).withColumnRenamed("confidence", "weight")
    poses = stitching.relaxed_poses(stitching.spanning_poses(corners.select(F.col(room).alias("node")), used), used)
    following = Window.partitionBy(room).orderBy("place")  # a ring's few corners
    first = lambda c: F.first(c).over(following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    walls = corners.select(room, F.col("x").alias("ax"), F.col("y").alias("ay"), *[F.coalesce(F.lead(c).over(following), first(c)).alias(f"b{c}") for c in ("x", "y")])
    poses = steps.keep(stitching.snapped(poses, walls, room), "poses")
    turned = stitching.in_frame(corners.select(room, "place", "x", "y"), poses, room)
    shifts = steps.keep(apart(turned, ["component"], room, "place"), "shifts")
    off = shifts.select(F.col(room).alias("node"), "dx", "dy", "settled")
    moved = turned.join(shifts.drop("component"), room).select("component", room, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    box = moved.groupBy("component").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    line = spatial.placed_in_line(box, "component", gap).select("component", F.col("dx").alias("line_x"), F.col("dy").alias("line_y"))
    placed = poses.join(off, "node").join(line, "component")
    return edges, placed.select(F.col("node").alias(room), "component", (F.col("x") + F.col("dx") + F.col("line_x")).alias("x"), (F.col("y") + F.col("dy") + F.col("line_y")).alias("y"), "yaw", "settled")


def matches_on_floor(matches: DataFrame, points: DataFrame, side: str, u: str, v: str, cutoff: float = 40.0) -> DataFrame:
    """matches (match, {side}_frame and the pixel u, v) with {side}_x and {side}_y: the floor place of the point that the frame
    shows nearest to the pixel. points: frame, point, u, v, x, y (reprojected, with the place in the room's floor
    axes). Matches without a point within the cut-off go."""
    frame = f"{side}_frame"
    pixels = matches.select(F.col(frame).alias("frame"), "match", F.col(u).alias("u"), F.col(v).alias("v"))
    near = rooms.nearest_seen(pixels, points, ["frame"], "match", "point", cutoff)
    at = near.join(points.select("frame", "point", F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y")), ["frame", "point"])
    return matches.join(at.select(F.col("frame").alias(frame), "match", f"{side}_x", f"{side}_y"), [frame, "match"])


# --- rings kept apart ------------------------------------------------------------------------


def least_move(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest move of convex ring a that ends its overlap with convex ring b, zero if they do
    not overlap. Convex rings are apart exactly if they are apart along the normal of some edge,
    so the shortest move is along the normal where they reach least into each other."""
    edges = np.concatenate([np.roll(r, -1, axis=0) - r for r in (a, b)])
    normals = np.stack([-edges[:, 1], edges[:, 0]], axis=1)
    long = np.hypot(*normals.T)
    normals = normals[long > 1e-12] / long[long > 1e-12, None]
    on_a, on_b = a @ normals.T, b @ normals.T
    forward, backward = on_b.max(axis=0) - on_a.min(axis=0), on_a.max(axis=0) - on_b.min(axis=0)
    depth = np.minimum(forward, backward)
    k = int(depth.argmin())
    if depth[k] <= 0:
        return np.zeros(2)
    return normals[k] * (forward[k] if forward[k] <= backward[k] else -backward[k])


def intersection_areas(pairs: DataFrame, a: str, b: str, area: str = "area") -> DataFrame:
    """pairs with the area that two convex rings (arrays of structs x, y; either way around) share; 0
    where a ring has fewer than three corners or is null."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def shared(left: pd.Series, right: pd.Series) -> pd.Series:
        def ring(corners) -> np.ndarray:
            points = np.array([(p["x"], p["y"]) for p in (corners if corners is not None else [])], dtype=float).reshape(-1, 2)
            x, y = points.T
            return points[::-1] if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0 else points

        rings = [(ring(p), ring(q)) for p, q in zip(left, right)]
        return pd.Series([solve.clip_convex(p, q) if len(p) > 2 and len(q) > 2 else 0.0 for p, q in rings], dtype=float)

    return pairs.withColumn(area, shared(F.col(a), F.col(b)))


def moves_apart(shapes: list[np.ndarray], fixed: int = 0, clearance: float = 0.01, sweeps: int = 500) -> tuple[np.ndarray, bool]:
    """Moves that leave no two convex rings overlapping, and whether that was reached. Sweeps over
    the pairs move each by half of its least move, or one alone where the other is fixed. Rings whose boxes lie apart
    do not overlap and are passed over."""
    move = np.zeros((len(shapes), 2))
    low, high = ([getattr(shape, end)(axis=0).tolist() for shape in shapes] for end in ("min", "max"))
    at = [[0.0, 0.0] for _ in shapes]
    for _ in range(sweeps):
        still = True
        for i in range(len(shapes)):
            for j in range(i + 1, len(shapes)):
                (xi, yi), (xj, yj) = at[i], at[j]
                if high[i][0] + xi < low[j][0] + xj or high[j][0] + xj < low[i][0] + xi or high[i][1] + yi < low[j][1] + yj or high[j][1] + yj < low[i][1] + yi:
                    continue
                step = least_move(shapes[i] + move[i], shapes[j] + move[j])
                size = float(np.hypot(*step))
                if size <= 1e-9:
                    continue
                still = False
                step = step * (1 + clearance / size)
                share = 0.0 if i == fixed else 1.0 if j == fixed else 0.5
                move[i] += share * step
                move[j] -= (1 - share) * step
                at[i], at[j] = move[i].tolist(), move[j].tolist()
        if still:
            return move, True
    return move, False


def apart(vertices: DataFrame, keys: list[str], shape: str, place: str) -> DataFrame:
    """(keys, shape, dx, dy, settled): moves that keep the convex rings (vertices x, y in order) of a
    key from overlapping; the first shape stays. A key is a floor plan's rooms, one task's frame."""
    kinds = dict(vertices.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{shape} {kinds[shape]}", "dx double, dy double, settled boolean"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rings = {name: part[["x", "y"]].to_numpy(float) for name, part in pdf.sort_values([shape, place]).groupby(shape, sort=True)}
        move, settled = moves_apart(list(rings.values()))
        return pd.DataFrame([(*key, name, *m, settled) for name, m in zip(rings, move.tolist())], columns=[*keys, shape, "dx", "dy", "settled"])

    return vertices.select(*keys, shape, place, "x", "y").groupBy(*keys).applyInPandas(run, schema)
