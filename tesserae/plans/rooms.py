"""Room-level queries over events, parts, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import histogram, rooms
from tesserae.plans.registry import Tables, query


@query("""
WITH t AS (SELECT p_brand AS room, 1.5::double + p_size / 30 AS top FROM part UNION ALL SELECT n_name, 2.4::double + s_suppkey / 1e7 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT room, CASE WHEN ends_with(room, '7') THEN 2.5::double END AS m FROM (SELECT DISTINCT p_brand AS room FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)),
s AS (SELECT room, count(*) AS n, median(top) AS mid, max(top) AS hi, max(top) - min(top) AS spread FROM t GROUP BY room),
j AS (SELECT *, n >= 3 AND spread <= 0.15::double AND mid >= 1.9::double AS agree, greatest(hi, 1.71::double) AS lower FROM r LEFT JOIN s USING (room)),
k AS (SELECT *, greatest(3.4::double, lower + 0.35::double) AS upper FROM j)
SELECT room, CASE WHEN m IS NOT NULL THEN 'measured' WHEN agree THEN 'wall_extrapolation' WHEN n > 0 THEN 'scan_cutoff_prior' ELSE 'prior' END AS method,
       round(CASE WHEN m IS NOT NULL THEN m WHEN agree THEN mid + 0.05::double WHEN n > 0 THEN (lower + upper) / 2 ELSE 2.44 END, 6) AS height,
       round(CASE WHEN m IS NOT NULL THEN m - 0.03::double WHEN agree THEN mid - 0.05::double WHEN n > 0 THEN lower ELSE 2.14 END, 6) AS ci_lo,
       round(CASE WHEN m IS NOT NULL THEN m + 0.03::double WHEN agree THEN mid + 0.35::double WHEN n > 0 THEN upper ELSE 2.74 END, 6) AS ci_hi FROM k
""")
def ceiling_choice(t: Tables) -> DataFrame:
    tops = t.part.select(F.col("p_brand").alias("room"), (1.5 + F.col("p_size") / 30).alias("top"))
    tops = tops.unionByName(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("room"), (2.4 + F.col("s_suppkey") / 1e7).alias("top")))
    names = t.part.select(F.col("p_brand").alias("room")).union(t.nation.select("n_name")).union(t.region.select("r_name")).distinct()
    out = rooms.ceilings(names.withColumn("m", F.when(F.endswith("room", F.lit("7")), 2.5)), tops, ["room"], "m", "top")
    return out.select("room", "method", *[F.round(c, 6).alias(c) for c in ("height", "ci_lo", "ci_hi")])


@query("""
WITH f AS (SELECT event_type AS room, user_id AS frame, count(*) AS n, median(CASE WHEN value > 0 THEN value END) / median(CASE WHEN 3 + user_id % 5 > 0 THEN 3 + user_id % 5 END) AS ratio FROM events GROUP BY 1, 2 HAVING count(*) >= 5),
d AS (SELECT room, 'metric_depth' AS cue, sum(n * ratio) / sum(n) AS scale, CASE WHEN count(*) > 1 THEN stddev_pop(ratio) / greatest(sum(n * ratio) / sum(n), 1e-6) ELSE 0.15 END AS s, 0.08::double AS least FROM f WHERE ratio > 0 GROUP BY 1),
e AS (SELECT event_type AS room, 2.032::double / ((100 + value) / 500 * (1 + user_id % 3)) AS v FROM events WHERE 100 + value > 0),
h AS (SELECT room, 'door_height' AS cue, median(v) AS scale, CASE WHEN count(*) > 1 THEN stddev_pop(v) / greatest(median(v), 1e-6) ELSE 0.2 END AS s, 0.18::double AS least FROM e GROUP BY 1),
c AS (SELECT event_type AS room, 'ceiling_height' AS cue, 2.44::double / max(value) AS scale, 0.3::double / 2.44::double AS s, 0::double AS least FROM events GROUP BY 1 HAVING max(value) > 0)
SELECT room, cue, round(scale, 6) AS scale, round(greatest(s, least), 6) AS sd FROM (SELECT * FROM d UNION ALL SELECT * FROM h UNION ALL SELECT * FROM c)
""")
def scale_cues(t: Tables) -> DataFrame:
    e = t.events.withColumnRenamed("event_type", "room")
    frames = e.select("room", "user_id", F.col("value").alias("metric"), (3 + F.col("user_id") % 5).alias("local"))
    doors = e.select("room", (100 + F.col("value")).alias("px"), F.lit(500.0).alias("fy"), (1 + F.col("user_id") % 3).alias("depth"))
    spans = e.groupBy("room").agg(F.max("value").alias("span"))
    out = rooms.depth_cue(frames, ["room"], "user_id", "metric", "local", 5).unionByName(rooms.door_cue(doors, ["room"], "px", "fy", "depth")).unionByName(rooms.ceiling_cue(spans, ["room"], "span"))
    return out.select("room", "cue", F.round("scale", 6).alias("scale"), F.round("sd", 6).alias("sd"))


_WALLS = """d AS (SELECT label, embedding[1]::double AS x, embedding[2]::double AS y, abs(embedding[3]::double) * 10 AS h FROM embeddings),
w(wall, ax, ay, bx, by_, top) AS (VALUES (0, -0.3, -0.1, 0.3, -0.1, 2.4), (1, 0.1, -0.3, 0.1, 0.3, 2.4), (2, -0.3, -0.3, 0.3, 0.3, 1.8)),
k AS (SELECT wall, ax::double AS ax, ay::double AS ay, bx::double AS bx, by_::double AS by_, top::double AS top, sqrt((bx - ax)::double ** 2 + (by_ - ay)::double ** 2) AS len FROM w)"""
WALLS = [(0, -0.3, -0.1, 0.3, -0.1, 2.4), (1, 0.1, -0.3, 0.1, 0.3, 2.4), (2, -0.3, -0.3, 0.3, 0.3, 1.8)]


def _points(t: Tables) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t.embeddings.select("label", at(0).alias("x"), at(1).alias("y"), (F.abs(at(2)) * 10).alias("h"))


def _walls(t: Tables) -> DataFrame:
    walls = t.spark.createDataFrame(WALLS, "wall int, ax double, ay double, bx double, by double, top double")
    return t.embeddings.select("label").distinct().crossJoin(F.broadcast(walls))


@query(f"""
WITH {_WALLS},
p AS (SELECT label, wall, len, top, h, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / len AS along, ((y - ay) * (bx - ax) - (x - ax) * (by_ - ay)) / len AS across FROM d, k)
SELECT label, wall, least(floor(along / 0.1::double), greatest(ceil(len / 0.1::double) - 1, 0))::bigint AS col, least(floor(h / 4 / 0.1::double), greatest(ceil(top / 4 / 0.1::double) - 1, 0))::bigint AS "row", count(*) AS n
FROM p WHERE abs(across) <= 0.04::double AND along BETWEEN 0 AND len AND h BETWEEN 0 AND top GROUP BY ALL
""")
def wall_band_points(t: Tables) -> DataFrame:
    # heights are a quarter, so that cells are four times as high as wide
    points, walls = _points(t).withColumn("h", F.col("h") / 4), _walls(t).withColumn("top", F.col("top") / 4)
    out = rooms.wall_cells(points, walls, ["label"], 0.04, 0.1)
    return out.select("label", "wall", F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), "n")


@query("""
WITH d AS (SELECT label, embedding[1]::double AS x, embedding[2]::double AS y, abs(embedding[3]::double) * 10 AS h FROM embeddings),
l(line, axis, coord, lo, hi) AS (VALUES (0, 0, 0.05, -0.3, 0.3), (1, 0, -0.1, -0.2, 0.4), (2, 1, 0.0, -0.4, 0.4))
SELECT label, line, count(*) AS n, round(quantile_cont(h, 0.98), 6) AS top FROM d, l
WHERE abs(CASE WHEN axis = 0 THEN x ELSE y END - coord::double) <= 0.05::double AND CASE WHEN axis = 0 THEN y ELSE x END BETWEEN lo::double AND hi::double AND h >= 0.5::double GROUP BY 1, 2 HAVING count(*) >= 3
""")
def line_support(t: Tables) -> DataFrame:
    lines = t.spark.createDataFrame([(0, 0, 0.05, -0.3, 0.3), (1, 0, -0.1, -0.2, 0.4), (2, 1, 0.0, -0.4, 0.4)], "line int, axis int, coord double, lo double, hi double")
    lines = t.embeddings.select("label").distinct().crossJoin(F.broadcast(lines))
    return rooms.line_support(_points(t), lines, ["label"], 0.05, 3).withColumn("top", F.round("top", 6))


@query("""
WITH w AS (SELECT c_nationkey AS k, c_custkey AS wall, c_acctbal AS ax, c_custkey % 2 AS v FROM customer),
l AS (SELECT s_nationkey AS k, s_suppkey AS line, s_acctbal AS coord, (s_suppkey % 2)::int AS axis FROM supplier),
j AS (SELECT w.k, wall, line, abs(ax - coord) AS d, row_number() OVER (PARTITION BY w.k, wall ORDER BY abs(ax - coord), line) AS r FROM w JOIN l ON w.k = l.k AND axis = v WHERE abs(ax - coord) <= 900)
SELECT k AS nation, wall, line, round(d, 4) AS distance FROM j WHERE r = 1
""")
def nearest_line(t: Tables) -> DataFrame:
    """Walls through (balance, balance): upright for even keys, level for odd ones."""
    b, even = F.col("c_acctbal"), F.col("c_custkey") % 2 == 0
    walls = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("wall"), (b - F.when(even, 0.0).otherwise(5.0)).alias("ax"), (b + F.when(even, 0.0).otherwise(5.0)).alias("bx"), (b - F.when(even, 5.0).otherwise(0.0)).alias("ay"), (b + F.when(even, 5.0).otherwise(0.0)).alias("by"))
    lines = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("line"), F.col("s_acctbal").alias("coord"), (F.col("s_suppkey") % 2).cast("int").alias("axis"))
    return rooms.nearest_line(walls, lines, ["nation"], 900.0).withColumn("distance", F.round("distance", 4))


@query("""
WITH d AS (SELECT label, vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings),
c(axis, at_) AS (VALUES (0, -0.4), (0, -0.1), (0, 0.1), (0, 0.4), (1, -0.4), (1, 0.0), (1, 0.2), (1, 0.4)),
s AS (SELECT axis, at_::double AS a, lead(at_::double) OVER (PARTITION BY axis ORDER BY at_) AS b FROM c),
g AS (SELECT label, u.a AS u0, u.b AS u1, v.a AS v0, v.b AS v1 FROM (SELECT DISTINCT label FROM d), s u, s v WHERE u.axis = 0 AND v.axis = 1 AND u.b IS NOT NULL AND v.b IS NOT NULL AND (u.b - u.a) * (v.b - v.a) >= 0.05::double),
f AS (SELECT DISTINCT label, (floor(x / 0.05::double) + 0.5::double) * 0.05::double AS x, (floor(y / 0.05::double) + 0.5::double) * 0.05::double AS y, 0 AS walk FROM d UNION ALL SELECT label, x, y, 1 FROM d WHERE z > 0.3::double),
h AS (SELECT g.label, u0, u1, v0, v1, count(*) FILTER (walk = 0) AS filled, max(walk) AS walk FROM g JOIN f ON g.label = f.label AND x >= u0 AND x < u1 AND y >= v0 AND y < v1 GROUP BY ALL)
SELECT label, u0, v0, filled, walk, round(filled * 0.05::double * 0.05::double / ((u1 - u0) * (v1 - v0)), 6) AS share FROM h WHERE walk = 1 OR filled * 0.05::double * 0.05::double / ((u1 - u0) * (v1 - v0)) >= 0.3::double
""")
def cell_arrangement(t: Tables) -> DataFrame:
    cuts = t.spark.createDataFrame([(0, -0.4), (0, -0.1), (0, 0.1), (0, 0.4), (1, -0.4), (1, 0.0), (1, 0.2), (1, 0.4)], "axis int, at double")
    labels = t.embeddings.select("label").distinct()
    floor = histogram.cells_of(_points(t), ["label"], F.col("x"), F.col("y"), 0.05)
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    path = t.embeddings.filter(at(2) > 0.3).select("label", at(0).alias("x"), at(1).alias("y"))
    out = rooms.cell_arrangement(labels.crossJoin(F.broadcast(cuts)), floor, path, ["label"], 0.05, 0.30, 0.05)
    return out.select("label", "u0", "v0", "filled", "walk", F.round("share", 6).alias("share"))


@query("""
WITH d AS (SELECT vec_id, label, embedding[1]::double AS d0, embedding[2]::double AS d1, embedding[3]::double AS d2, embedding[4]::double AS d3 FROM embeddings),
p AS (SELECT a.vec_id, a.d0 AS ax, a.d1 AS ay, a.d2 AS anx, a.d3 AS any_, b.d0 AS bx, b.d1 AS by_, b.d2 AS bnx, b.d3 AS bny, a.label FROM d a JOIN d b ON b.vec_id = a.vec_id + 1),
y AS (SELECT *, x - floor(x / (2 * pi())) * (2 * pi()) - pi() AS yaw FROM (SELECT *, atan2(any_, anx) + pi() - atan2(bny, bnx) + pi() AS x FROM p))
SELECT vec_id, round(yaw, 5) AS yaw, round(ax - (cos(yaw) * bx - sin(yaw) * by_), 5) AS tx, round(ay - (sin(yaw) * bx + cos(yaw) * by_), 5) AS ty,
       CASE WHEN label >= 4 AND label % 3 > 0 THEN 'keypoints+doorway' WHEN label >= 4 THEN 'keypoints' WHEN label % 3 > 0 THEN 'doorway' END AS source,
       round(CASE WHEN label >= 4 AND label % 3 > 0 THEN least(0.15::double * label, 8) + 3 WHEN label >= 4 THEN least(0.15::double * label, 8) WHEN label % 3 > 0 THEN 3 END, 6) AS confidence
FROM y
""")
def stitch_edges(t: Tables) -> DataFrame:
    """Neighbouring vectors as pairs of doors; the label as inliers, and whether there is a doorway."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    side = lambda s, shift: t.embeddings.select((F.col("vec_id") - shift).alias("vec_id"), *[at(i).alias(f"{s}{n}") for i, n in enumerate(("x", "y", "nx", "ny"))], *([F.col("label")] if s == "a" else []))
    pairs = rooms.doorway_transforms(side("a", 0).join(side("b", 1), "vec_id"))
    out = rooms.stitch_edges(pairs.withColumn("door", F.col("label") % 3 > 0), "label", "door")
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in ("yaw", "tx", "ty")], "source", F.round("confidence", 6).alias("confidence"))


@query()
def opening_consensus(t: Tables) -> DataFrame:
    """Spans of two event types on a user's time line, in days."""
    day = F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 86_400_000_000 - 19723
    spans = t.events.select("user_id", "event_type", F.col("event_id").alias("place"), F.when(F.col("value") > 20, "door").otherwise("window").alias("kind"), day.alias("start"), (day + F.greatest(F.col("value"), F.lit(1.0)) / 25).alias("stop"), F.lit(0.5).alias("score"))
    geo, sem = spans.filter("event_type = 'click'").drop("event_type"), spans.filter("event_type = 'view'").drop("event_type")
    out = rooms.cross_checked(geo, sem, ["user_id"])
    return out.select("user_id", "kind", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), F.round("score", 6).alias("score"), "sources", "note")


@query("""
WITH b AS (SELECT p_partkey, p_size * 1.0::double AS x0, p_retailprice / 10 AS y0, p_size * 2.5::double AS x1, p_retailprice / 8 AS y1 FROM part WHERE p_size * 1.5::double >= 12 AND p_retailprice / 8 - p_retailprice / 10 >= 12),
g AS (SELECT p_partkey, x0, y0, x1, y1, unnest(range(49)) AS n FROM b)
SELECT p_partkey, count(*) AS n, round(max(x0 + (x1 - x0) * (0.12::double + (0.88::double - 0.12::double) * (n % 7) / 6)), 5) AS u, round(min(y0 + (y1 - y0) * (0.12::double + (0.88::double - 0.12::double) * (n // 7) / 6)), 5) AS v FROM g GROUP BY p_partkey
""")
def box_grid_rays(t: Tables) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    boxes = t.part.select("p_partkey", (s * 1.0).alias("x0"), (p / 10).alias("y0"), (s * 2.5).alias("x1"), (p / 8).alias("y1"))
    return rooms.box_grid(boxes).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("u"), 5).alias("u"), F.round(F.min("v"), 5).alias("v"))


@query("""
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_type, event_id, value FROM r JOIN n USING (event_type) WHERE i % ceil(n / 400)::bigint = 0
""")
def even_subsample(t: Tables) -> DataFrame:
    return rooms.evenly_sampled(t.events, ["event_type"], [F.col("ts"), F.col("event_id")], 400).select("event_type", "event_id", "value")


@query("""
WITH f AS (SELECT user_id, event_type, avg((value < 5)::int) AS z FROM events GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY z DESC, user_id) AS r FROM f)
SELECT event_type, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.9), 6) AS p90, round(max(z), 6) AS worst, list(user_id ORDER BY r) FILTER (r <= 5)::varchar AS worst_frames FROM w GROUP BY event_type
""")
def confidence_stats(t: Tables) -> DataFrame:
    """Share of low values in each frame (user): mean, 90th percentile, most, and the five worst."""
    from pyspark.sql import Window

    f = t.events.groupBy("event_type", "user_id").agg(F.avg((F.col("value") < 5).cast("double")).alias("z"))
    w = f.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("z"), "user_id")))
    five = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "user_id")))), lambda x: x["user_id"].cast("string"))
    return w.groupBy("event_type").agg(F.round(F.avg("z"), 6).alias("mean"), F.round(F.percentile("z", 0.9), 6).alias("p90"), F.round(F.max("z"), 6).alias("worst"), F.concat(F.lit("["), F.array_join(five, ", "), F.lit("]")).alias("worst_frames"))


_PLAN = """f AS (SELECT DISTINCT label, floor(embedding[1]::double / 0.1::double)::bigint AS cx, floor(embedding[2]::double / 0.1::double)::bigint AS cy FROM embeddings),
e AS (SELECT label, cx AS x0, cy AS y0, cx + 1 AS x1, cy AS y1, 1 AS way FROM f UNION ALL SELECT label, cx + 1, cy, cx + 1, cy + 1, 1 FROM f UNION ALL SELECT label, cx, cy + 1, cx + 1, cy + 1, -1 FROM f UNION ALL SELECT label, cx, cy, cx, cy + 1, -1 FROM f),
s AS (SELECT label, x0, y0, x1, y1, sum(way) AS way FROM e GROUP BY ALL HAVING sum(way) <> 0)"""


def _floor_cells(t: Tables) -> DataFrame:
    cells = histogram.cells_of(_points(t), ["label"], F.col("x"), F.col("y"), 0.1)
    return cells.select("label", F.col("cx").alias("u0"), (F.col("cx") + 1).alias("u1"), F.col("cy").alias("v0"), (F.col("cy") + 1).alias("v1"))


@query(f"WITH {_PLAN} SELECT label, CASE WHEN way < 0 THEN x1 ELSE x0 END AS x0, CASE WHEN way < 0 THEN y1 ELSE y0 END AS y0, CASE WHEN way < 0 THEN x0 ELSE x1 END AS x1, CASE WHEN way < 0 THEN y0 ELSE y1 END AS y1 FROM s")
def plan_edges(t: Tables) -> DataFrame:
    return rooms.boundary_edges(_floor_cells(t), ["label"])


@query()
def plan_rings(t: Tables) -> DataFrame:
    return rooms.rings(rooms.boundary_edges(_floor_cells(t), ["label"]), ["label"])


@query()
def point_normals(t: Tables) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double").alias(f"d{i}")
    out = rooms.point_normals(t.embeddings.select("label", "vec_id", at(0), at(1), at(2)), ["label"], "vec_id", ("d0", "d1", "d2"), 0.2)
    return out.select("label", "vec_id", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")], "neighbours")


@query("""
WITH p AS (SELECT label, vec_id AS point, 320 + 400 * embedding[1]::double AS u, 240 + 400 * embedding[2]::double AS v FROM embeddings),
q AS (SELECT label, vec_id AS pixel, 320 + 600 * embedding[3]::double AS u, 240 + 600 * embedding[4]::double AS v FROM embeddings),
d AS (SELECT label, pixel, point, sqrt((q.u - p.u) * (q.u - p.u) + (q.v - p.v) * (q.v - p.v)) AS d FROM q JOIN p USING (label))
SELECT label, pixel, min(point) AS point, round(any_value(d), 6) AS distance FROM d WHERE d <= 40 AND (label, pixel, d) IN (SELECT label, pixel, min(d) FROM d GROUP BY label, pixel) GROUP BY label, pixel
""")
def nearest_reprojection(t: Tables) -> DataFrame:
    """For each pixel of a frame (label) the point of it that is seen nearest, up to 40 pixels away."""
    at = lambda i, f, c: c + f * F.get("embedding", F.lit(i)).cast("double")
    points = t.embeddings.select("label", F.col("vec_id").alias("point"), at(0, 400, F.lit(320)).alias("u"), at(1, 400, F.lit(240)).alias("v"))
    pixels = t.embeddings.select("label", F.col("vec_id").alias("pixel"), at(2, 600, F.lit(320)).alias("u"), at(3, 600, F.lit(240)).alias("v"))
    return rooms.nearest_seen(pixels, points, ["label"], "pixel", "point").withColumn("distance", F.round("distance", 6))
