"""Queries over layouts: normals, masks, guards, surfaces, regions, rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import measure
from tesserae.operators import layout, planes, rectilinear, sequence, spatial
from tesserae.plans.registry import Tables, query


def _at(i: int):
    return F.get("embedding", F.lit(i)).cast("double")


@query("""
WITH d AS (SELECT vec_id, label, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings),
n AS (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM d)
SELECT label, count(*) AS walls, round(sum(abs(z / s)), 6) AS tilt FROM n WHERE abs(z / s) < 0.35::double GROUP BY 1
""")
def vertical_normals(t: Tables) -> DataFrame:
    d = t.embeddings.select("label", _at(0).alias("x"), _at(1).alias("y"), _at(2).alias("z")).withColumn("s", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    n = d.select("label", *[(F.col(c) / F.col("s")).alias(f"n{c}") for c in "xyz"])
    walls = n.filter(layout.upright(F.col("nx"), F.col("ny"), F.col("nz"), (0.0, 0.0, 1.0)))
    return walls.groupBy("label").agg(F.count(F.lit(1)).alias("walls"), F.round(F.sum(F.abs("nz")), 6).alias("tilt"))


@query("""
SELECT p_brand AS frame, count(*) FILTER (p_size * 20 >= 200 AND p_size * 20 <= 0.35::double * 2000) AS kept, count(*) FILTER (NOT (p_size * 20 >= 200 AND p_size * 20 <= 0.35::double * 2000)) AS rejected FROM part GROUP BY 1
""")
def mask_plausibility(t: Tables) -> DataFrame:
    masks = t.part.select(F.col("p_brand").alias("frame"), (F.col("p_size") * 20).alias("pixels"), F.lit(2000).alias("frame_pixels"))
    return layout.mask_counts(layout.plausible_masks(masks, "pixels", "frame_pixels"), ["frame"])


@query("""
WITH d AS (SELECT label, embedding[1]::double AS u, embedding[2]::double AS v FROM embeddings)
SELECT label, count(*) FILTER (u BETWEEN -0.05::double AND 0.2::double + 0.05::double AND v BETWEEN -0.05::double AND 0.1::double + 0.05::double) AS inside, count(*) FILTER (u BETWEEN 0 AND 0.2::double AND v BETWEEN 0 AND 0.1::double) AS strictly FROM d GROUP BY 1
""")
def surface_containment(t: Tables) -> DataFrame:
    inside = lambda margin: F.count_if(layout.holds(_at(0), _at(1), F.lit(0.2), F.lit(0.1), margin))
    return t.embeddings.groupBy("label").agg(inside(layout.INSIDE_MARGIN).alias("inside"), inside(0.0).alias("strictly"))


@query("""
WITH cells AS (SELECT event_type, day(ts)::int - 1 AS col, hour(ts)::int AS row FROM events GROUP BY ALL HAVING max(value) > 40),
cols AS (SELECT event_type, col, count(*) >= 3 AS seen FROM cells GROUP BY 1, 2),
o AS (SELECT event_type, count(*) FILTER (seen) / 30 AS observed FROM cols WHERE col < 30 GROUP BY 1),
p AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, round(observed, 6) AS observed FROM p JOIN o USING (event_type) WHERE n >= 100 AND observed >= 0.3::double
""")
def opening_guard(t: Tables) -> DataFrame:
    cells = t.events.groupBy("event_type", (F.dayofmonth("ts") - 1).alias("col"), F.hour("ts").alias("row")).agg(F.max("value").alias("v")).filter("v > 40").drop("v")
    columns = sequence.columns_of(cells, ["event_type"], 30, 24)
    points = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return layout.claimable_walls(columns, points, ["event_type"], 100, 0.3).withColumn("observed", F.round("observed", 6))


@query("""
WITH d AS (SELECT label, vec_id // 8 AS block, vec_id, (atan2(embedding[2]::double, embedding[1]::double) + 2 * pi()) % pi() AS theta FROM embeddings),
s AS (SELECT *, CASE WHEN theta - lag(theta) OVER (PARTITION BY label, block ORDER BY theta, vec_id) > radians(20) THEN 1 ELSE 0 END AS start FROM d),
c AS (SELECT *, sum(start) OVER (PARTITION BY label, block ORDER BY theta, vec_id) AS cluster FROM s)
SELECT label, block, cluster::bigint AS cluster, count(*) AS n, round(min(theta), 6) AS lo, round(max(theta), 6) AS hi FROM c GROUP BY 1, 2, 3
""")
def angle_clusters(t: Tables) -> DataFrame:
    """Directions of a label's vectors in blocks of eight keys, so that some gaps are wide."""
    d = t.embeddings.select("label", F.floor(F.col("vec_id") / 8).alias("block"), "vec_id", F.atan2(_at(1), _at(0)).alias("a"))
    c = layout.angle_clusters(d, ["label", "block"], F.col("a"), "vec_id")
    return c.groupBy("label", "block", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("theta"), 6).alias("lo"), F.round(F.max("theta"), 6).alias("hi"))


@query("""
SELECT l_orderkey, l_linenumber, round_even((l_quantity / 8)::decimal(18, 3), 2)::double AS eighth, round_even((l_orderkey / 2)::decimal(18, 1), 0)::double AS half FROM lineitem
""")
def half_even_rounding(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", measure.half_even((F.col("l_quantity") / 8).cast("decimal(18,3)"), 2).cast("double").alias("eighth"), measure.half_even((F.col("l_orderkey") / 2).cast("decimal(18,1)"), 0).cast("double").alias("half"))


@query("""
WITH w AS (SELECT s_nationkey AS room, s_suppkey AS wall, s_acctbal / 1000 AS au, (s_suppkey % 7)::double AS av, s_acctbal / 1000 + s_suppkey % 3 AS bu, (s_suppkey % 7 + s_suppkey % 2)::double AS bv FROM supplier),
l AS (SELECT *, sqrt((bu - au) ** 2 + (bv - av) ** 2) AS len, 2.4::double + room / 100 AS ceiling FROM w),
b AS (SELECT room, min(least(au, bu)) - 0.1::double AS u, min(least(av, bv)) - 0.1::double AS v, max(greatest(au, bu)) - min(least(au, bu)) + 0.2::double AS du, max(greatest(av, bv)) - min(least(av, bv)) + 0.2::double AS dv, max(ceiling) AS ceiling FROM l GROUP BY 1),
s AS (
  SELECT room, 'wall' AS kind, wall, room + au AS ox, 0::double AS oy, 1 + av AS oz, -(bv - av) / len AS nx, 0::double AS ny, (bu - au) / len AS nz, len AS u_extent, ceiling AS v_extent, len * ceiling AS area FROM l WHERE len > 0
  UNION ALL SELECT room, 'floor', NULL, room + u, 0, 1 + v, 0, 1, 0, du, dv, 12 FROM b
  UNION ALL SELECT room, 'ceiling', NULL, room + u, ceiling, 1 + v, 0, -1, 0, du, dv, 12 FROM b)
SELECT room, kind, wall, round(ox, 6) AS ox, round(oy, 6) AS oy, round(oz, 6) AS oz, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(u_extent, 6) AS u_extent, round(v_extent, 6) AS v_extent, round(area, 6) AS area FROM s
""")
def layout_surfaces(t: Tables) -> DataFrame:
    """Each nation a room, each supplier a wall; axes x and z, up y; normals to the right of walls."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal") / 1000
    walls = t.supplier.select(F.col("s_nationkey").alias("room"), key.alias("wall"), balance.alias("au"), (key % 7).cast("double").alias("av"), (balance + key % 3).alias("bu"), (key % 7 + key % 2).cast("double").alias("bv"), F.lit(False).alias("has_opening"))
    walls = walls.withColumn("nu", F.col("bv") - F.col("av")).withColumn("nv", F.col("au") - F.col("bu"))
    axis = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    room = F.col("n_nationkey")
    frames = t.nation.select(room.alias("room"), F.array(room.cast("double"), F.lit(0.0), F.lit(1.0)).alias("origin"), axis(1, 0, 0).alias("e1"), axis(0, 0, 1).alias("e2"), axis(0, 1, 0).alias("up"), (2.4 + room / 100).alias("ceiling"), F.lit(12.0).alias("area"))
    s = layout.surfaces(walls, frames, ["room"])
    parts = [F.round(F.col(a)[i], 6).alias(f"{a[0]}{c}") for a in ("origin", "normal") for i, c in enumerate("xyz")]
    return s.select("room", "kind", "wall", *parts, *[F.round(c, 6).alias(c) for c in ("u_extent", "v_extent", "area")])


@query("""
WITH d AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'ceiling' ELSE 'wall' END AS kind, abs(embedding[1]::double) * 4 AS u, abs(embedding[2]::double) * 3 AS v, abs(embedding[3]::double) AS area FROM embeddings)
SELECT vec_id, round(least(1.0::double, 0.3::double + area), 6) AS severity, CASE WHEN kind = 'ceiling' THEN round(least(u, v, greatest(0::double, 1.5::double - (u + 0.2::double)), greatest(0::double, 1.2::double - (v + 0.1::double))), 6) END AS edge FROM d
""")
def region_context(t: Tables) -> DataFrame:
    u, v = F.abs(_at(0)) * 4, F.abs(_at(1)) * 3
    kind = F.when(F.col("label") % 2 == 0, "ceiling").otherwise("wall")
    edge = layout.edge_distance(kind, (u, v, u + 0.2, v + 0.1), F.lit(1.5), F.lit(1.2))
    return t.embeddings.select("vec_id", F.round(layout.severity(F.abs(_at(2))), 6).alias("severity"), F.round(edge, 6).alias("edge"))


def _floor():
    """A nation's suppliers of 200 consecutive keys: a floor has a bounded number of shapes."""
    return F.col("s_nationkey") + 25 * F.floor(F.col("s_suppkey") / 200)


@query("""
SELECT s_nationkey + 25 * (s_suppkey // 200) AS floor, count(*) AS shapes, 0::bigint AS overlaps, true AS settled FROM supplier GROUP BY 1
""")
def rooms_apart(t: Tables) -> DataFrame:
    """Boxes of the floors that suppliers make up, moved until none overlap; the boxes' overlaps are counted again.
    The condition, not the moves, is what SQL states."""
    key, at = F.col("s_suppkey"), F.col("s_acctbal") / 2000
    boxes = t.supplier.select(_floor().alias("floor"), key.alias("shape"), at.alias("x0"), (key % 3).cast("double").alias("y0"), (at + 2 + key % 2).alias("x1"), (key % 3 + 2).cast("double").alias("y1"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))]))
    moves = layout.apart(boxes.select("floor", "shape", corners.alias("c")).select("floor", "shape", "c.*"), ["floor"], "shape", "place")
    # floors lie apart, so that one pass over all boxes meets only boxes of a floor
    moved = boxes.join(moves, ["floor", "shape"]).select("floor", "shape", "settled", *[(F.col(c) + F.col(f"d{c[0]}") + (F.col("floor") * 1000 if c[0] == "x" else 0)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    over = spatial.box_overlaps(moved, "shape", 2.0).filter("area > 1e-9").join(moved.select(F.col("shape").alias("a"), "floor"), "a").groupBy("floor").agg(F.count(F.lit(1)).alias("o"))
    return moved.groupBy("floor").agg(F.count(F.lit(1)).alias("shapes"), F.min("settled").alias("settled")).join(over, "floor", "left").select("floor", "shapes", F.coalesce("o", F.lit(0)).cast("long").alias("overlaps"), "settled")


@query("""
SELECT r_regionkey AS room, 4::bigint AS corners, (3 + r_regionkey % 2) * (2.4::double + r_regionkey * 0.2::double) AS area FROM region
""")
def room_layouts(t: Tables) -> DataFrame:
    """Each region a rectangular room turned by its key, of points on its walls and floor; SQL has the
    area that the rings must enclose."""
    turn = F.col("room") * 0.1
    wide, deep = (3 + F.col("room") % 2).cast("double"), 2.4 + F.col("room") * 0.2
    base = t.region.select(F.col("r_regionkey").alias("room")).withColumn("w", wide).withColumn("d", deep)
    steps = lambda size: F.explode(F.transform(F.sequence(F.lit(1), F.ceil(size / 0.1).cast("int") - 1), lambda i: i * 0.1))
    heights = F.explode(F.transform(F.sequence(F.lit(4), F.lit(14)), lambda i: i * 0.1))
    walls = None
    for far, size, other in ((0, "w", "d"), (1, "w", "d"), (0, "d", "w"), (1, "d", "w")):
        side = base.withColumn("a", steps(F.col(size))).withColumn("h", heights).withColumn("b", F.col(other) * far)
        side = side.select("room", F.col("a" if size == "w" else "b").alias("x"), F.col("b" if size == "w" else "a").alias("y"), "h")
        walls = side if walls is None else walls.unionByName(side)
    floor = base.withColumn("x", steps(F.col("w"))).withColumn("y", steps(F.col("d"))).select("room", "x", "y", F.lit(0.0).alias("h"))
    spun = lambda df: df.withColumns({"x": F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y"), "y": F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y")})
    points = spun(walls.unionByName(floor)).withColumn("point", F.xxhash64("room", "x", "y", "h"))
    path = spun(base.select("room", (F.col("w") / 2).alias("x"), (F.col("d") / 2).alias("y")))
    rings = layout.extract_layout(points, path, ["room"], "point", (0.3, 1.5), radius=0.16, least=100)
    measures = spatial.ring_measures(rings, ["room", "ring"], "place", "x", "y")
    return measures.groupBy("room").agg(F.sum("n").alias("corners"), F.round(F.sum("area"), 3).alias("area"))


@query("""
WITH t AS (SELECT s_suppkey AS k, s_nationkey + 25 * (s_suppkey // 200) AS g, s_acctbal / 2000 AS x, (s_suppkey % 5)::double AS y, 2 + s_suppkey % 4 AS s FROM supplier),
p AS (SELECT a.k AS a, b.k AS b, round(greatest(0, least(a.x + a.y + a.s, b.x + b.y + b.s) - greatest(a.x, b.x) - greatest(a.y, b.y)) ** 2 / 2, 6) AS area
    FROM t a JOIN t b ON a.g = b.g AND a.k < b.k)
SELECT * FROM p WHERE area > 0
""")
def triangle_overlaps(t: Tables) -> DataFrame:
    """Right triangles of a floor's suppliers; what two of them share is such a triangle too. Only
    triangles whose boxes overlap meet; floors lie apart, so that one pass over all boxes does."""
    key, x, y, s = F.col("s_suppkey"), F.col("s_acctbal") / 2000, (F.col("s_suppkey") % 5).cast("double"), 2 + F.col("s_suppkey") % 4
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x, y + s), (x + s, y))])
    rings = t.supplier.select(key.alias("k"), ring.alias("ring"), (x + _floor() * 1000).alias("x0"), y.alias("y0"), (x + s + _floor() * 1000).alias("x1"), (y + s).alias("y1"))
    near = spatial.box_overlaps(rings, "k", 4.0).select("a", "b")
    pairs = near.join(rings.select(F.col("k").alias("a"), F.col("ring").alias("p")), "a").join(rings.select(F.col("k").alias("b"), F.col("ring").alias("q")), "b")
    return layout.intersection_areas(pairs, "p", "q").select("a", "b", F.round("area", 6).alias("area")).filter("area > 0")


@query("""
WITH b AS (SELECT l_orderkey AS k, l_partkey % 12 AS u, l_suppkey % 12 AS v, 1 + l_linenumber % 4 AS w, 1 + l_quantity::bigint % 5 AS h FROM lineitem),
c AS (SELECT DISTINCT k, u + dx AS x, v + dy AS y FROM b, (SELECT unnest(range(4)) AS dx) p, (SELECT unnest(range(5)) AS dy) q WHERE dx < w AND dy < h),
one(i) AS (SELECT unnest(range(-1, 2))), two(i) AS (SELECT unnest(range(-2, 3))),
g AS (SELECT DISTINCT k, x + a.i AS x, y + b.i AS y FROM c, one a, one b),
s AS (SELECT k, x + a.i AS x, y + b.i AS y FROM g, two a, two b GROUP BY ALL HAVING count(*) = 25),
o AS (SELECT DISTINCT k, x + a.i AS x, y + b.i AS y FROM s, one a, one b)
SELECT k, area, cleaned FROM (SELECT k, count(*) AS area FROM c GROUP BY k) LEFT JOIN (SELECT k, count(*) AS cleaned FROM o GROUP BY k) USING (k)
""")
def cleaned_plans(t: Tables) -> DataFrame:
    """An order's lines as boxes: the area of their union, and what is left of it without gaps and slivers narrower than two (null
    for lines without an order, as in the SQL's join)."""
    u, v = F.col("l_partkey") % 12, F.col("l_suppkey") % 12
    w, h = 1 + F.col("l_linenumber") % 4, 1 + F.col("l_quantity").cast("long") % 5
    boxes = t.lineitem.select(F.col("l_orderkey").alias("k"), *[c.cast("double").alias(n) for n, c in (("u0", u), ("u1", u + w), ("v0", v), ("v1", v + h))])
    out = rectilinear.cleaned_areas(boxes, ["k"], 1.0)
    return out.select("k", F.round("area").cast("long").alias("area"), F.when(F.col("k").isNotNull(), F.round("cleaned").cast("long")).alias("cleaned"))


@query("""
WITH p AS (SELECT l_suppkey % 20 AS room, l_partkey % 40 / 8 AS x, l_orderkey % 32 / 8 AS y, l_quantity / 20 + 0.01::double * (l_partkey % 40 / 8) AS h FROM lineitem),
b AS (SELECT room, floor((h - lo) / 0.02::double) AS bin, lo, count(*) AS n FROM p JOIN (SELECT room, min(h) AS lo FROM p GROUP BY room) USING (room) GROUP BY ALL),
s AS (SELECT room, min(lo + (bin + 0.5::double) * 0.02::double) AS seed FROM (SELECT *, max(n) OVER (PARTITION BY room) AS most FROM b) WHERE n >= 0.2::double * most GROUP BY room),
i AS (SELECT p.*, seed FROM p JOIN s USING (room) WHERE abs(h - seed) <= 0.08::double),
m AS (SELECT room, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, h) AS xh, covar_pop(y, h) AS yh, avg(x) AS mx, avg(y) AS my, avg(h) AS mh FROM i GROUP BY room),
f AS (SELECT room, n, (xh * yy - yh * xy) / (xx * yy - xy * xy) AS a, (yh * xx - xh * xy) / (xx * yy - xy * xy) AS b, mh, mx, my FROM m),
j AS (SELECT i.* FROM i JOIN f USING (room) WHERE abs(h - (a * x + b * y + mh - a * mx - b * my)) / sqrt(1 + a * a + b * b) <= 0.02::double),
m2 AS (SELECT room, count(*) AS n2, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, h) AS xh, covar_pop(y, h) AS yh, avg(x) AS mx, avg(y) AS my, avg(h) AS mh FROM j GROUP BY room),
f2 AS (SELECT room, n2, a, b, mh - a * mx - b * my AS c FROM (SELECT *, (xh * yy - yh * xy) / (xx * yy - xy * xy) AS a, (yh * xx - xh * xy) / (xx * yy - xy * xy) AS b FROM m2)),
g AS (SELECT s.room, coalesce(n >= 100 AND n2 >= 50 AND 1 / sqrt(1 + f2.a * f2.a + f2.b * f2.b) >= 0.95::double, false) AS good, f2.a, f2.b, f2.c, seed FROM s LEFT JOIN f USING (room) LEFT JOIN f2 USING (room)),
k AS (SELECT room, good, CASE WHEN good THEN a ELSE 0 END AS a, CASE WHEN good THEN b ELSE 0 END AS b, CASE WHEN good THEN c ELSE seed END AS c FROM g)
SELECT room, CASE WHEN count(*) < 100 THEN 'too few points' WHEN good THEN 'plane' ELSE 'band' END AS method, CASE WHEN count(*) >= 100 THEN round(a, 6) END AS a, CASE WHEN count(*) >= 100 THEN round(c, 6) END AS c, count(*) AS total,
       CASE WHEN count(*) >= 100 THEN count(*) FILTER (abs(h - (a * x + b * y + c)) / sqrt(1 + a * a + b * b) <= 0.02::double) END AS inliers
FROM p JOIN k USING (room) GROUP BY room, good, a, b, c
""")
def floor_fits(t: Tables) -> DataFrame:
    """Lines as points of twenty rooms whose heights come in steps on a slight slope: each room's floor."""
    x, y = F.col("l_partkey") % 40 / 8, F.col("l_orderkey") % 32 / 8
    points = t.lineitem.select((F.col("l_suppkey") % 20).alias("room"), x.alias("x"), y.alias("y"), (F.col("l_quantity") / 20 + 0.01 * x).alias("h"))
    out = planes.floors(points, ["room"])
    return out.select("room", "method", F.round("a", 6).alias("a"), F.round("c", 6).alias("c"), "inliers", "total")
