"""Planes that single photos see, and the walls of a room that they merge into.

A view's points are in its camera's axes, y down. Everything is sums, percentiles and joins for each view or room; the
percentiles and medians of a view hold that view's values, whose number the picture bounds. Rows with null keys take no part.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import geometry
from tesserae.operators import histogram, sequence, spatial
from tesserae.session import Steps

#: Fixed values of the measurement protocol: shares, metres, counts, degrees.
TRIM = (0.02, 0.98)
BAND = 0.20
UPRIGHT = 0.35
VIEW_POINTS = 40
WALL_TURN = 20
BEYOND_FLOOR = 1.2
SAME_COSINE, SAME_OFFSET = 0.90, 0.35
FLOOR_NEAR, EDGE_BIN, EDGE_POINTS = 0.15, 0.05, 200
LEAST_WALL, OFFSET_SPREAD = 0.3, 0.15


def _vector(*parts: Column | str) -> Column:
    return F.array(*parts)


def _times(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _unit(a: Column) -> Column:
    length = F.sqrt(geometry.array_dot(a, a))
    return F.when(length > 1e-9, _times(a, 1 / length))


def _cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _turned(p: Column) -> Column:
    """p turned by the row's pose (qw, qx, qy, qz)."""
    rows = geometry.quaternion_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return F.array(*[geometry.dot(tuple(r), (p[0], p[1], p[2])) for r in rows])


def _mean_vector(column: str, weight: str) -> Column:
    return F.array(*[F.sum(F.col(weight) * F.col(column)[i]) for i in range(3)])


def view_planes(points: DataFrame, poses: DataFrame, keys: list[str], frame: str, least: int = VIEW_POINTS) -> DataFrame:
    """(keys, frame, kind, place, normal, offset, inliers, start, stop): the floor, ceiling and walls that each view shows by its own
    points (keys, frame, x, y, z, nx, ny, nz), in the world of its pose (qw, qx, qy, qz, tx, ty, tz).

    The floor is the median height of the lowest fifth of the view's range between its 2nd and 98th percentile, the ceiling that
    of the highest fifth. Points with level normals are walls, one for each run of directions (mod pi) without a gap of 20 degrees;
    one no farther than 1.2 times the view's floor is furniture and goes. Places number the floor 0, the ceiling 1 and walls from
    2 on; start and stop are a wall's outermost points and null otherwise. Planes of fewer than `least` points go, and views with
    fewer points, without height or without a pose show none. Points with a null or endless place count nowhere, those with such
    a normal in no wall; repeated points count each."""
    per = [*keys, frame]
    whole = points.select(*per, "x", "y", "z", "nx", "ny", "nz").filter(geometry.finite(*[F.col(c) for c in "xyz"]))
    bounds = F.percentile("y", F.array(*[F.lit(p) for p in TRIM]))
    ranges = whole.groupBy(*per).agg(F.count(F.lit(1)).alias("n"), bounds.alias("b")).filter((F.col("n") >= least) & (F.col("b")[1] > F.col("b")[0]))
    ranged = whole.join(ranges.select(*per, F.col("b")[0].alias("hi"), F.col("b")[1].alias("lo")), per)
    fifth = BAND * (F.col("lo") - F.col("hi"))
    low, high = F.col("y") >= F.col("lo") - fifth, F.col("y") <= F.col("hi") + fifth
    levels = ranged.groupBy(*per).agg(*[F.struct(F.median(F.when(band, F.col("y"))).alias("offset"), F.count_if(band).alias("inliers"), F.lit(kind).alias("kind"), F.lit(place).alias("place")).alias(kind) for place, (kind, band) in enumerate((("floor", low), ("ceiling", high)))])
    flat = levels.select(*per, F.explode(F.array("floor", "ceiling")).alias("p")).select(*per, "p.*").filter(F.col("inliers") >= least)
    nowhere = F.lit(None).cast("array<double>")
    flat = flat.select(*per, "kind", "place", _vector(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("normal"), "offset", "inliers", nowhere.alias("start"), nowhere.alias("stop"))

    level = geometry.finite(*[F.col(c) for c in ("nx", "ny", "nz")]) & (F.abs("ny") < UPRIGHT)
    upright = ranged.filter(level).withColumn("angle", F.pmod(F.atan2("nz", "nx"), F.lit(math.pi)))
    runs = sequence.clusters_1d(upright, per, "angle", "x", math.radians(WALL_TURN))
    means = runs.groupBy(*per, "cluster").agg(F.count(F.lit(1)).alias("inliers"), _vector(*[F.avg(c) for c in ("nx", "ny", "nz")]).alias("m")).filter(F.col("inliers") >= least)
    means = means.select(*per, "cluster", "inliers", _unit(F.col("m")).alias("normal")).filter("normal is not null")
    n, p = F.col("normal"), _vector("x", "y", "z")
    along = F.col("x") * n[2] - F.col("z") * n[0]
    end = F.struct(along, "x", "y", "z")
    walls = runs.join(means, [*per, "cluster"]).groupBy(*per, "cluster", "inliers", "normal").agg(F.median(geometry.array_dot(p, n)).alias("offset"), F.min_by(p, end).alias("start"), F.max_by(p, end).alias("stop"))
    floor = flat.filter("kind = 'floor'").select(*per, F.abs("offset").alias("floor"))
    walls = walls.join(floor, per, "left").filter(F.col("floor").isNull() | (F.abs("offset") > BEYOND_FLOOR * F.col("floor")))
    local = flat.unionByName(walls.select(*per, F.lit("wall").alias("kind"), (F.col("cluster") + 2).cast("int").alias("place"), "normal", "offset", "inliers", "start", "stop"))

    shift = _vector("tx", "ty", "tz")
    seen = local.join(poses.select(*per, "qw", "qx", "qy", "qz", "tx", "ty", "tz"), per).withColumn("normal", _turned(n))
    return seen.select(*per, "kind", "place", "normal", (F.col("offset") + geometry.array_dot(n, shift)).alias("offset"), "inliers", *[_plus(_turned(F.col(c)), shift).alias(c) for c in ("start", "stop")])


def leaders(rows: DataFrame, keys: list[str], index: str, vector: str, offset: str, least_cosine: float = SAME_COSINE, most_offset: float = SAME_OFFSET, either_way: bool = False) -> DataFrame:
    """(keys, index, leader): in index order, each row joins the first leader that is close in direction and offset; where there is none it leads.
    either_way takes opposite directions for one. Rows without an index, a finite offset and a finite vector that is not zero have
    no leader (null); equal rows come back once; null keys are one key.

    Rows that fit lie in neighbouring cells of the offset and the first three coordinates of the direction. In a round, the first
    undecided row of each cell that comes before those of all cells where its fits may lie leads, and all that fit it are decided,
    so distant cells go on together and no pairs of rows are made: few leaders have room side by side, so a row meets few. What a
    round leaves is a table."""
    v = F.transform(vector, lambda x: x.cast("double"))
    o = F.col(offset).cast("double")
    length = F.sqrt(geometry.array_dot(v, v))
    usable = F.coalesce(F.col(index).isNotNull() & geometry.finite(length, o) & (length > 0), F.lit(False))
    key = F.struct(F.lit(0).alias("all"), *keys).alias("k")
    chord = max(math.sqrt(max(2 - 2 * least_cosine, 0.0)), 1e-6) * (1 + 1e-9)
    cell = lambda way: F.array(F.floor(F.col("o") / most_offset), *[F.floor(way * F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) / chord) for i in range(3)])
    steps = Steps(rows.sparkSession, "rows", "leaders")
    whole = rows.select(key, F.col(index).alias("i"), F.when(usable, F.transform(v, lambda x: x / length)).alias("v"), o.alias("o")).distinct()
    table = steps.keep(whole.withColumn("s", cell(1)), "rows")
    around = F.array(*[F.array(*[F.lit(d).cast("long") for d in move]) for move in itertools.product((-1, 0, 1), repeat=4)])
    beside = lambda at: F.transform(around, lambda move: _plus(move, at))
    moved = [beside(cell(way)) for way in ((1, -1) if either_way else (1,))]
    near = F.explode(moved[0] if len(moved) == 1 else F.array_union(*moved)).alias("at")
    left, found = table.filter("v is not null"), None
    while left.limit(1).count():
        first = left.groupBy("k", "s").agg(F.min(F.struct("i", "v", "o")).alias("c"))
        looks = first.select("k", "c.*", "c").select("k", "c", near)
        others = first.select("k", F.col("s").alias("at"), F.col("c").alias("other"))
        new = looks.join(others, ["k", "at"]).groupBy("k", "c").agg(F.min("other").alias("earliest")).filter(F.col("c") == F.col("earliest"))
        new = steps.keep(new.select("k", "c.*").select("k", "i", "v", "o", near), "leaders")
        found = new if found is None else found.union(new)
        left = steps.keep(left.alias("r").join(new.alias("l"), _fits(least_cosine, most_offset, either_way), "left_anti"), "left")
    if found is None:
        joined = table.select("k", "i", F.col("i").alias("leader")).filter("false")
    else:
        joined = table.filter("v is not null").alias("r").join(found.alias("l"), _fits(least_cosine, most_offset, either_way)).groupBy("r.k", "r.i", "r.v", "r.o").agg(F.min("l.i").alias("leader")).select("k", "i", "leader")
    none = table.filter("v is null").select("k", "i", F.lit(None).cast(joined.schema["leader"].dataType).alias("leader"))
    return joined.union(none).select(*[F.col("k")[c].alias(c) for c in keys], F.col("i").alias(index), "leader")


def _fits(least_cosine: float, most_offset: float, either_way: bool) -> Column:
    r, l = lambda c: F.col(f"r.{c}"), lambda c: F.col(f"l.{c}")  # noqa: E731, E741
    alike = geometry.array_dot(r("v"), l("v"))
    close = ((F.abs(alike) if either_way else alike) >= least_cosine) & (F.abs(r("o") - l("o")) <= most_offset)
    itself = (r("i") == l("i")) & (r("v") == l("v")) & (r("o") == l("o"))
    return (r("k") == l("k")) & (r("s") == l("at")) & (close | itself)


def merged_level(planes: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, normal, offset, inliers): a room's floor or ceiling, the mean over its views by inliers."""
    level = planes.filter(F.col("kind") == kind).groupBy(*keys).agg(_unit(_mean_vector("normal", "inliers")).alias("normal"), (F.sum(F.col("inliers") * F.col("offset")) / F.sum("inliers")).alias("offset"), F.sum("inliers").alias("inliers"))
    return level.filter("normal is not null")


def room_walls(planes: DataFrame, points: DataFrame, poses: DataFrame, keys: list[str], frame: str, edge_points: int = EDGE_POINTS, edge_bin: float = EDGE_BIN) -> DataFrame:
    """(keys, leader, axis, coord, low, high, inliers, views, agreement): the walls that the views of a room (view_planes) show, as lines
    at a constant coordinate of its floor frame.

    Views' walls that lie on each other (leaders, first of frame and place) are one. The floor frame has its origin on the merged
    floor and turns with the mean direction of the walls (mod 90 degrees). A view's wall tends to stand too near, so the line moves
    out to the densely seen edge of all points near the floor, on the side away from the cameras that saw it; rooms with fewer than `edge_points`
    of these keep the merged place. low and high are the wall's extent along the other axis; walls under 0.3 m go, and so do all
    of a room whose views show no floor. agreement is 1 for one view, and falls to 0 as offsets spread to 0.15 m."""
    floor = merged_level(planes, keys, "floor")
    up = _times(F.col("normal"), F.lit(-1.0))
    seed = F.when(F.abs(F.col("up")[0]) > 0.9, _vector(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(_vector(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    axes = floor.select(*keys, _times(F.col("normal"), F.col("offset")).alias("origin"), up.alias("up"), F.col("offset").alias("level")).withColumn("seed", seed)
    axes = axes.withColumn("a1", _unit(_plus(F.col("seed"), _times(F.col("up"), -geometry.array_dot(F.col("seed"), F.col("up")))))).withColumn("a2", _cross(F.col("up"), F.col("a1"))).drop("seed")

    walls = planes.filter("kind = 'wall'").withColumn("at", F.struct(frame, "place"))
    led = leaders(walls, keys, "at", "normal", "offset", either_way=True)
    members = walls.join(led, [*keys, "at"]).join(poses.select(*keys, frame, _vector("tx", "ty", "tz").alias("camera")), [*keys, frame])
    wall = members.groupBy(*keys, "leader").agg(
        _unit(_mean_vector("normal", "inliers")).alias("facing"), (F.sum(F.col("inliers") * F.col("offset")) / F.sum("inliers")).alias("away"), F.sum("inliers").alias("total"),
        F.count_distinct(frame).alias("views"), F.greatest(F.lit(0.0), 1 - F.stddev_pop("offset") / OFFSET_SPREAD).alias("agreement")).filter("facing is not null")
    placed = wall.join(axes, keys)
    turn = spatial.circular_mean(placed, keys, F.atan2(geometry.array_dot(F.col("facing"), F.col("a2")), geometry.array_dot(F.col("facing"), F.col("a1"))))
    e1 = _plus(_times(F.col("a1"), F.cos("angle")), _times(F.col("a2"), F.sin("angle")))
    axes = axes.join(turn, keys).withColumn("e1", e1).withColumn("e2", _cross(F.col("up"), F.col("e1"))).select(*keys, "origin", "up", "level", "e1", "e2")

    on = lambda p, e: geometry.array_dot(_plus(p, _times(F.col("origin"), F.lit(-1.0))), F.col(e))
    axis = F.when(F.abs(geometry.array_dot(F.col("facing"), F.col("e1"))) >= F.abs(geometry.array_dot(F.col("facing"), F.col("e2"))), 0).otherwise(1)
    wall = wall.join(axes, keys).withColumn("axis", axis)
    own = lambda p: F.when(F.col("axis") == 0, on(p, "e1")).otherwise(on(p, "e2"))
    other = lambda p: F.when(F.col("axis") == 0, on(p, "e2")).otherwise(on(p, "e1"))
    place = own(_times(F.col("facing"), F.col("away")))
    held = members.select(*keys, "leader", "inliers", "start", "stop", "camera").join(wall.withColumn("merged", place), [*keys, "leader"])
    lines = held.groupBy(*keys, "leader", "axis", "merged", "total", "views", "agreement").agg(
        (F.sum(F.col("inliers") * own(F.col("camera"))) / F.sum("inliers")).alias("camera"), F.min(F.least(other(F.col("start")), other(F.col("stop")))).alias("low"), F.max(F.greatest(other(F.col("start")), other(F.col("stop")))).alias("high"))

    world = points.join(poses.select(*keys, frame, "qw", "qx", "qy", "qz", "tx", "ty", "tz"), [*keys, frame]).withColumn("p", _plus(_turned(_vector("x", "y", "z")), _vector("tx", "ty", "tz")))
    near = world.select(*keys, "p").join(axes, keys).filter(F.abs(geometry.array_dot(F.col("p"), F.col("up")) + F.col("level")) <= FLOOR_NEAR)
    seen = near.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("axis"), on(F.col("p"), "e1").alias("at")), F.struct(F.lit(1).alias("axis"), on(F.col("p"), "e2").alias("at")))).alias("s")).select(*keys, "s.*")
    enough = seen.groupBy(*keys, "axis").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= edge_points).drop("n")
    edges = histogram.densest_edge(seen.join(enough, [*keys, "axis"]), [*keys, "axis"], "at", edge_bin).withColumnsRenamed({"low": "first", "high": "last"})
    out = lines.join(edges, [*keys, "axis"], "left").filter(F.col("high") - F.col("low") >= LEAST_WALL)
    coord = F.coalesce(F.when(F.col("merged") >= F.col("camera"), F.col("last")).otherwise(F.col("first")), F.col("merged"))
    return out.select(*keys, "leader", "axis", coord.alias("coord"), "low", "high", F.col("total").alias("inliers"), "views", "agreement")
