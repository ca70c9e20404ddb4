"""Queries over views: embeddings as points with a normal each, 25 in a row seen by one photo, four photos in a room."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import views
from tesserae.plans.registry import Tables, query

E = "embedding"
_VIEW = ("vec_id div 100 AS room", "vec_id div 25 AS frame")


def _points(t: Tables) -> DataFrame:
    at = [(F.get(E, F.lit(i)).cast("double") * 16).alias(c) for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))]
    p = t.embeddings.select(*map(F.expr, _VIEW), *at)
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return p.withColumns({c: F.col(c) / length for c in ("nx", "ny", "nz")})


def _poses(t: Tables) -> DataFrame:
    frames = t.embeddings.selectExpr(*_VIEW).distinct()
    turn = F.col("frame") * 0.15
    none = F.lit(0.0)
    return frames.select("room", "frame", F.cos(turn).alias("qw"), none.alias("qx"), F.sin(turn).alias("qy"), none.alias("qz"), (F.col("frame") % 7 * 0.1).alias("tx"), none.alias("ty"), (F.col("frame") % 5 * -0.05).alias("tz"))


_SEEN = """
raw AS (SELECT vec_id // 100 AS room, vec_id // 25 AS frame, list_transform(embedding[1:6], lambda e: e::double * 16) AS e FROM embeddings),
p AS (SELECT room, frame, e[1] AS x, e[2] AS y, e[3] AS z, e[4] / l AS nx, e[5] / l AS ny, e[6] / l AS nz FROM (SELECT *, sqrt(e[4] ** 2 + e[5] ** 2 + e[6] ** 2) AS l FROM raw)),
b AS (SELECT frame, quantile_cont(y, 0.02) AS hi, quantile_cont(y, 0.98) AS lo FROM p GROUP BY frame HAVING count(*) >= 3),
g AS (SELECT p.*, hi, lo FROM p JOIN b USING (frame) WHERE lo > hi),
levels AS (
  SELECT room, frame, 'floor' AS kind, 0 AS place, median(y) AS o, count(*) AS n FROM g WHERE y >= lo - 0.2::double * (lo - hi) GROUP BY ALL
  UNION ALL SELECT room, frame, 'ceiling', 1, median(y), count(*) FROM g WHERE y <= hi + 0.2::double * (lo - hi) GROUP BY ALL),
a AS (SELECT *, (atan2(nz, nx) + 2 * pi()) % pi() AS angle FROM g WHERE abs(ny) < 0.35::double),
s AS (SELECT *, angle - lag(angle) OVER (PARTITION BY frame ORDER BY angle, x) > radians(20) AS cut FROM a),
c AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY angle, x) AS cluster FROM s),
m AS (SELECT frame, cluster, count(*) AS n, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM c GROUP BY ALL HAVING count(*) >= 3),
u AS (SELECT frame, cluster, n, mx / l AS mx, my / l AS my, mz / l AS mz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l FROM m)),
w AS (SELECT room, frame, cluster, n, mx, my, mz, median(x * mx + y * my + z * mz) AS o, arg_min([x, y, z], x * mz - z * mx) AS f, arg_max([x, y, z], x * mz - z * mx) AS t FROM c JOIN u USING (frame, cluster) GROUP BY ALL),
k AS (SELECT w.* FROM w LEFT JOIN levels v ON v.frame = w.frame AND v.kind = 'floor' AND v.n >= 3 WHERE v.o IS NULL OR abs(w.o) > 1.2::double * abs(v.o)),
q AS (
  SELECT room, frame, kind, place, 0.0::double AS mx, 1.0::double AS my, 0.0::double AS mz, o, n, NULL::double[] AS f, NULL::double[] AS t FROM levels WHERE n >= 3
  UNION ALL SELECT room, frame, 'wall', 2 + cluster, mx, my, mz, o, n, f, t FROM k),
d AS (SELECT *, cos(frame * 0.3::double) AS co, sin(frame * 0.3::double) AS si, frame % 7 * 0.1::double AS tx, frame % 5 * -0.05::double AS tz FROM q),
v AS (
  SELECT room, frame, kind, place::int AS place, n AS inliers, co * mx + si * mz AS nx, my AS ny, co * mz - si * mx AS nz, o + (co * mx + si * mz) * tx + (co * mz - si * mx) * tz AS away,
    [co * f[1] + si * f[3] + tx, f[2], co * f[3] - si * f[1] + tz] AS f, [co * t[1] + si * t[3] + tx, t[2], co * t[3] - si * t[1] + tz] AS t FROM d)"""


def _seen(t: Tables) -> DataFrame:
    return views.view_planes(_points(t), _poses(t), ["room"], "frame", 3)


@query(f"""
WITH {_SEEN}
SELECT room, frame, kind, place, inliers, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(away, 6) AS away, round(f[1], 6) AS start_x, round(f[3], 6) AS start_z, round(t[1], 6) AS stop_x, round(t[3], 6) AS stop_z FROM v
""")
def view_planes(t: Tables) -> DataFrame:
    n = F.col("normal")
    ends = [F.round(F.col(c)[i], 6).alias(f"{c}_{a}") for c in ("start", "stop") for i, a in ((0, "x"), (2, "z"))]
    return _seen(t).select("room", "frame", "kind", "place", "inliers", *[F.round(n[i], 6).alias(c) for i, c in enumerate(("nx", "ny", "nz"))], F.round("offset", 6).alias("away"), *ends)


_LEADERS = """WITH RECURSIVE {before}l(room, used) AS (
  SELECT room, [arg_min({{'i': i, 'v': v, 'o': o}}, i)] FROM r GROUP BY room
  UNION ALL SELECT l.room, list_append(l.used, arg_min({{'i': r.i, 'v': r.v, 'o': r.o}}, r.i)) FROM l JOIN r USING (room)
  WHERE len(list_filter(l.used, lambda u: {alike} >= 0.9::double AND abs(u.o - r.o) <= {offset}::double)) = 0 GROUP BY l.room, l.used),
led AS (SELECT room, arg_max(used, len(used)) AS used FROM l GROUP BY room),
found AS (SELECT r.room, r.i, list_filter(used, lambda u: {alike} >= 0.9::double AND abs(u.o - r.o) <= {offset}::double)[1].i AS leader FROM r JOIN led USING (room))
"""


@query(_LEADERS.format(before="r AS (SELECT label AS room, vec_id AS i, embedding[1:3]::double[] AS v, embedding[4]::double AS o FROM embeddings), ", alike="list_cosine_similarity(u.v, r.v)", offset="0.35") + "SELECT room AS label, i AS vec_id, leader FROM found")
def leader_clusters(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "vec_id", F.slice(E, 1, 3).alias("v"), F.get(E, F.lit(3)).cast("double").alias("o"))
    return views.leaders(rows, ["label"], "vec_id", "v", "o")


@query(_LEADERS.format(before=f"{_SEEN}, r AS (SELECT room, frame * 100 + place AS i, [nx, ny, nz] AS v, away AS o FROM v WHERE kind = 'wall'), ", alike="abs(list_cosine_similarity(u.v, r.v))", offset="0.35") + "SELECT room, i // 100 AS frame, i % 100 AS place, leader // 100 AS leader_frame, leader % 100 AS leader_place FROM found")
def walls_of_views(t: Tables) -> DataFrame:
    """Which view's wall first shows the wall that a view's wall is."""
    walls = _seen(t).filter("kind = 'wall'").withColumn("at", F.struct("frame", "place"))
    led = views.leaders(walls, ["room"], "at", "normal", "offset", either_way=True)
    return led.select("room", "at.*", F.col("leader.frame").alias("leader_frame"), F.col("leader.place").alias("leader_place"))


@query()
def room_walls(t: Tables) -> DataFrame:
    out = views.room_walls(_seen(t), _points(t), _poses(t), ["room"], "frame", 20, 0.2)
    return out.select("room", "leader.*", "axis", "inliers", "views", *[F.round(c, 6).alias(c) for c in ("coord", "low", "high", "agreement")])
