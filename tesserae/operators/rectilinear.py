"""Unions of boxes along the axes (keys, u0, u1, v0, v1): grown, shrunk and cleaned exactly, their parts and their walls.

A union is held as slabs: between two neighbouring cuts in v, disjoint runs in u. Growing by d with mitred corners
is the union of boxes grown by d, and shrinking is growing what is free, whose boxes reach to infinity. So no grid is laid, and all coordinates stay sums of the
given ones. A key is a room or a plan: its boxes are one array, which meets in one exchange and on which all steps work in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import graph, rooms
from tesserae.session import Steps

#: Fixed values of the measurement protocol, metres: what is narrower than twice CLEAN goes; shorter walls are none; how far a wall may lie from its line.
CLEAN, SHORTEST_WALL, LINE_REACH = 0.12, 0.25, 0.25
BOX = ["u0", "u1", "v0", "v1"]
#: Slabs that a key of few boxes takes at once.
BAND = 32


def _cuts(boxes: DataFrame, keys: list[str], low: str, high: str, name: str) -> DataFrame:
    both = boxes.select(*keys, F.explode(F.array(low, high)).alias("c"))
    return both.groupBy(*keys).agg(F.sort_array(F.collect_set("c")).alias(name))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _box(u0: Column, u1: Column, v0: Column, v1: Column) -> Column:
    return F.struct(u0.alias("u0"), u1.alias("u1"), v0.alias("v0"), v1.alias("v1"))


def _solid(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: (b["u0"] < b["u1"]) & (b["v0"] < b["v1"]))


def _runs(boxes: Column, low: Column, high: Column) -> Column:
    """Runs (u0, u1) of the boxes, sorted by u0, that reach from low to high: each box starts a run or lengthens the last."""
    state = lambda done, u0, u1: F.struct(done.alias("done"), u0.alias("u0"), u1.alias("u1"))
    more = lambda s: F.array_append(s["done"], F.struct(s["u0"].alias("u0"), s["u1"].alias("u1")))
    none = F.lit(None).cast("double")
    step = lambda s, b: F.when((b["v0"] > low) | (b["v1"] < high), s).when(s["u1"].isNull(), state(s["done"], b["u0"], b["u1"])).when(b["u0"] > s["u1"], state(more(s), b["u0"], b["u1"])).otherwise(state(s["done"], s["u0"], F.greatest(s["u1"], b["u1"])))
    return F.aggregate(boxes, state(F.array().cast("array<struct<u0:double,u1:double>>"), none, none), step, lambda s: F.when(s["u1"].isNull(), s["done"]).otherwise(more(s)))


def _united(boxes: Column) -> Column:
    """An array of any boxes to their union, an array of slabs (v0, v1, runs): of all neighbouring cuts, also those without runs.
    Slabs are taken in bands of at least BAND, of many about as many as a band has slabs, and look only at the boxes that reach into their band."""
    pairs = lambda cuts: F.zip_with(cuts, F.slice(cuts, 2, F.size(cuts)), lambda a, b: F.struct(a.alias("v0"), b.alias("v1")))
    between = lambda solid: F.filter(_let(F.sort_array(F.concat(solid["v0"], solid["v1"])), pairs), lambda p: p["v0"] < p["v1"])
    reach = lambda solid, band: F.filter(solid, lambda b: (b["v0"] < F.element_at(band["v1"], -1)) & (b["v1"] > F.get(band["v0"], F.lit(0))))
    filled = lambda near, band: F.transform(band, lambda p: F.struct(p["v0"].alias("v0"), p["v1"].alias("v1"), _runs(near, p["v0"], p["v1"]).alias("runs")))
    width = lambda over: F.greatest(F.lit(BAND), F.ceil(F.sqrt(F.size(over))).cast("int"))
    bands = lambda over: F.when(F.size(over) > 0, F.transform(F.sequence(F.lit(1), F.size(over), width(over)), lambda i: F.slice(over, i, width(over)))).otherwise(F.array())
    return _let(F.sort_array(_solid(boxes)), lambda solid: F.flatten(F.transform(_let(between(solid), bands), lambda band: _let(reach(solid, band), lambda near: filled(near, band)))))


def _boxes(union: Column) -> Column:
    return F.flatten(F.transform(union, lambda s: F.transform(s["runs"], lambda r: _box(r["u0"], r["u1"], s["v0"], s["v1"]))))


def _free(union: Column) -> Column:
    """Boxes of all that a union leaves free, to infinity."""
    end = F.lit(float("inf"))
    gaps = lambda lows, highs, box: F.zip_with(F.concat(F.array(-end), highs), F.concat(lows, F.array(end)), box)
    beside = lambda s: gaps(s["runs"]["u0"], s["runs"]["u1"], lambda a, b: _box(a, b, s["v0"], s["v1"]))
    return _let(union, lambda slabs: _solid(F.concat(F.flatten(F.transform(slabs, beside)), gaps(slabs["v0"], slabs["v1"], lambda a, b: _box(-end, end, a, b)))))


def _grown(boxes: Column, d: float) -> Column:
    return F.transform(boxes, lambda b: _box(b["u0"] - d, b["u1"] + d, b["v0"] - d, b["v1"] + d))


def _shrunk(boxes: Column, d: float) -> Column:
    return _free(_united(_grown(_free(_united(boxes)), d)))


def _cleaned(boxes: Column, d: float) -> Column:
    return _grown(_shrunk(_grown(boxes, d), 2 * d), d)


def _area(union: Column) -> Column:
    """Null where there is none."""
    size = lambda b: (b["u1"] - b["u0"]) * (b["v1"] - b["v0"])
    return F.aggregate(_boxes(union), F.lit(None).cast("double"), lambda s, b: F.coalesce(s, F.lit(0.0)) + size(b))


def _gathered(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, boxes): the boxes with area of each key in one array. The only exchange that a union needs."""
    solid = boxes.select(*keys, *[F.col(c).cast("double").alias(c) for c in BOX]).filter("u0 < u1 and v0 < v1")
    return solid.groupBy(*keys).agg(F.collect_list(F.struct(*BOX)).alias("boxes"))


def _written(boxes: DataFrame, keys: list[str], shape: Callable[[Column], Column]) -> DataFrame:
    """The union of shape(boxes of a key) as rows."""
    numbered = _gathered(boxes, keys).select(*keys, F.posexplode(_united(shape(F.col("boxes")))).alias("i", "s"))
    runs = numbered.select(*keys, (F.col("i") + 1).alias("slab"), "s.v0", "s.v1", F.explode("s.runs").alias("r"))
    return Steps(boxes.sparkSession).keep(runs.select(*keys, "slab", "r.u0", "r.u1", "v0", "v1"), "slabs")


def slabs(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The union of any boxes as disjoint boxes (keys, slab, u0, u1, v0, v1): slabs between neighbouring cuts in v are numbered, and
    runs in a slab neither overlap nor touch. Boxes without area go. The result is written and read again, for what
    follows reads it more than once; so are the three below."""
    return _written(boxes, keys, lambda b: b)


def grown(union: DataFrame, keys: list[str], d: float) -> DataFrame:
    return _written(union, keys, lambda b: _grown(b, d))


def shrunk(union: DataFrame, keys: list[str], d: float) -> DataFrame:
    return _written(union, keys, lambda b: _shrunk(b, d))


def cleaned(union: DataFrame, keys: list[str], d: float = CLEAN) -> DataFrame:
    """Gaps, then slivers, narrower than 2 d gone: grown by d, shrunk by 2 d, grown by d."""
    return _written(union, keys, lambda b: _cleaned(b, d))


def cleaned_areas(boxes: DataFrame, keys: list[str], d: float = CLEAN) -> DataFrame:
    """(keys, area, cleaned): the area of the union of any boxes, and of what is left of it when cleaned, null where nothing is.
    Nothing is written: a key's boxes meet once."""
    return _gathered(boxes, keys).select(*keys, _area(_united(F.col("boxes"))).alias("area"), _area(_united(_cleaned(F.col("boxes"), d))).alias("cleaned"))


def areas(union: DataFrame, keys: list[str]) -> DataFrame:
    return union.groupBy(*keys).agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"))


def parts(union: DataFrame, keys: list[str]) -> DataFrame:
    """slabs with part: boxes joined by a common stretch of side. Of two such runs of neighbouring slabs the later start lies
    in the other run, the last of its slab that starts no later."""
    nodes = union.withColumn("node", F.struct(*keys, "v0", "u0"))
    ends = F.array(F.struct(F.col("v1").alias("at"), F.lit(0).alias("side")), F.struct(F.col("v0").alias("at"), F.lit(1).alias("side")))
    both = nodes.select(*keys, F.explode(ends).alias("p"), "u0", "u1", "node")
    up_to = Window.partitionBy(*keys, "p.at").orderBy("u0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.last(F.when(F.col("p.side") == side, F.struct("u1", "node")), ignorenulls=True).over(up_to)
    other = F.when(F.col("p.side") == 0, last(1)).otherwise(last(0))
    edges = both.select("u0", F.col("node").alias("a"), other.alias("o")).filter(F.col("o.u1") > F.col("u0")).select("a", F.col("o.node").alias("b"))
    return nodes.join(graph.components(nodes.select("node"), edges).withColumnRenamed("component", "part"), "node").drop("node")


def main_part(union: DataFrame, path: DataFrame | None, keys: list[str]) -> DataFrame:
    """The part of each key with the most points of the path (keys, x, y); without any, the largest; of equals the
    first."""
    split = Steps(union.sparkSession).keep(parts(union, keys), "parts")
    sized = split.groupBy(*keys, "part").agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"))
    if path is None:
        sized = sized.withColumn("walked", F.lit(0))
    else:
        rows = _cuts(split, keys, "v0", "v1", "__v")
        below = F.get("__v", F.size(F.filter("__v", lambda c: c <= F.col("y"))) - 1)
        on = path.select(*keys, "x", "y").join(rows, keys).select(*keys, below.alias("v0"), "x")
        seen = on.join(split.select(*keys, "v0", "u0", "u1", "part"), [*keys, "v0"]).filter("x >= u0 and x < u1").groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("walked"))
        sized = sized.join(seen, [*keys, "part"], "left")
    rank = F.struct((-F.coalesce("walked", F.lit(0))).alias("w"), -F.col("area"), "part")
    best = sized.groupBy(*keys).agg(F.min_by("part", rank).alias("part"))
    return split.join(best, [*keys, "part"], "left_semi").drop("part")


def plan_outline(boxes: DataFrame, path: DataFrame, keys: list[str], d: float = CLEAN, least: float = 0.5) -> DataFrame:
    """(keys, place, x, y): the outer ring of a room, from the boxes of an arrangement that belong to it. The walked part is
    cleaned, and its largest part stays; where that took away more than `least` of the area, the part stays as it was. Holes are filled."""
    steps = Steps(boxes.sparkSession)
    whole = steps.keep(main_part(slabs(boxes, keys), path, keys), "whole")
    clean = steps.keep(main_part(cleaned(whole, keys, d), None, keys), "main")
    share = areas(whole, keys).withColumnRenamed("area", "was").join(areas(clean, keys), keys, "left")
    good = share.filter(F.col("area") >= least * F.col("was")).select(*keys)
    kept = clean.join(good, keys, "left_semi").unionByName(whole.join(good, keys, "left_anti"))
    across = kept.join(_cuts(kept, keys, "u0", "u1", "__u"), keys)
    place = lambda c: F.array_position("__u", F.col(c)).cast("int")
    cells = across.select(*keys, "v0", "v1", "__u", F.explode(F.sequence(place("u0"), place("u1") - 1)).alias("i"))
    cells = cells.select(*keys, F.get("__u", F.col("i") - 1).alias("u0"), F.get("__u", F.col("i")).alias("u1"), "v0", "v1")
    found = steps.keep(rooms.rings(rooms.boundary_edges(cells, keys), keys), "rings")
    outer = found.groupBy(*keys, "ring").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box")).groupBy(*keys).agg(F.max_by("ring", F.struct("box", -F.col("ring"))).alias("ring"))
    return found.join(outer, [*keys, "ring"], "left_semi").drop("ring")


def walls(outline: DataFrame, lines: DataFrame, keys: list[str], shortest: float = SHORTEST_WALL, reach: float = LINE_REACH) -> DataFrame:
    """(keys, wall, ax, ay, bx, by, length, nx, ny, line, top, n): sides of rings (keys, place, x, y, inside on the left) of at least
    `shortest`, with the outward normal and the nearest line (keys, line, axis, coord, top, n) of their direction within `reach`."""
    order = Window.partitionBy(*keys).orderBy("place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    sides = outline.select(*keys, F.col("place").alias("wall"), F.col("x").alias("ax"), F.col("y").alias("ay"), to("x").alias("bx"), to("y").alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    sides = sides.withColumn("length", F.sqrt(dx * dx + dy * dy)).filter(F.col("length") >= shortest).withColumn("nx", dy / F.col("length")).withColumn("ny", -dx / F.col("length"))
    near = rooms.nearest_line(sides, lines, keys, reach).select(*keys, "wall", "line")
    return sides.join(near, [*keys, "wall"], "left").join(lines.select(*keys, "line", "top", "n"), [*keys, "line"], "left").select(*keys, "wall", "ax", "ay", "bx", "by", "length", "nx", "ny", "line", "top", "n")
