"""Compositions: a fused cloud, a drawn report, and the windows of the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import fusion
from tesserae.plans.registry import Tables, query
from tesserae.streaming import windows

_POINTS = """
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
n AS (SELECT label, least(5, greatest(1, count(*) // 24)) AS step FROM f GROUP BY label),
k AS (SELECT f.label, frame, unnest(embedding[17:48])::double AS e, unnest(range(32)) AS i, embedding[1]::double AS px, embedding[2]::double AS py, embedding[3]::double AS pz, 1.0::double + embedding[4] AS qw, embedding[5]::double AS qy FROM f JOIN n ON f.label = n.label WHERE frame % step = 0),
d AS (SELECT *, (i % 8) * 10 AS u, (i // 8) * 10 AS v, 2.5::double + e * 10 AS depth FROM k),
l AS (SELECT *, (u - 35) / 50 * depth AS x, (v - 15) / 50 * depth AS y, qw * qw + qy * qy AS nn FROM d WHERE depth > 0.2::double AND depth < 5.0::double AND e >= -0.2::double),
w AS (SELECT label, frame, (1 - 2 / nn * (qy * qy)) * x + (2 / nn * (qw * qy)) * depth + px AS x, y + py AS y, -(2 / nn * (qw * qy)) * x + (1 - 2 / nn * (qy * qy)) * depth + pz AS z FROM l)"""


def _points(t: Tables) -> DataFrame:
    """Frames are vectors of a label; 32 of their values are depths of an 8 by 4 grid of pixels."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    frames = fusion.strided(t.embeddings.withColumn("frame", place), ["label"], "frame", 5)
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    poses = frames.select("label", "frame", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (1.0 + at(3)).alias("qw"), F.lit(0.0).alias("qx"), at(4).alias("qy"), F.lit(0.0).alias("qz"))
    pixels = frames.select("label", "frame", F.posexplode(F.slice("embedding", 17, 32)).alias("i", "e"))
    e = F.col("e").cast("double")
    pixels = pixels.select("label", "frame", (F.col("i") % 8 * 10).alias("u"), (F.floor(F.col("i") / 8) * 10).alias("v"), (2.5 + e * 10).alias("depth"), F.when(e >= -0.2, 2).otherwise(1).alias("confidence"))
    camera = t.embeddings.select("label").distinct().withColumns({"fx": F.lit(50.0), "fy": F.lit(50.0), "cx": F.lit(35.0), "cy": F.lit(15.0)})
    return fusion.world_points(pixels, poses, camera, ["label"])


@query(f"WITH {_POINTS} SELECT label, floor(x / 0.5::double)::bigint AS v_x, floor(y / 0.5::double)::bigint AS v_y, floor(z / 0.5::double)::bigint AS v_z, count(*) AS n, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z FROM w GROUP BY 1, 2, 3, 4")
def fuse_cloud(t: Tables) -> DataFrame:
    out = fusion.fused(_points(t), ["label"], 0.5)
    return out.select("label", "v_x", "v_y", "v_z", "n", *[F.round(c, 5).alias(c) for c in ("x", "y", "z")])


@query(f"WITH {_POINTS} SELECT label, count(*) AS n, round(max(x) - min(x), 6) AS span_x, round(max(y) - min(y), 6) AS span_y, round(max(z) - min(z), 6) AS span_z, round(median(y), 6) AS median_height, round(avg((y > 0)::int), 6) AS above FROM w GROUP BY label")
def cloud_statistics(t: Tables) -> DataFrame:
    return fusion.cloud_statistics(_points(t), ["label"])


@query("""
WITH e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM events)
SELECT start, event_type, count(*) AS n, max(value) AS value, min(event_id) FILTER (value = m) AS event_id FROM (SELECT *, max(value) OVER (PARTITION BY start, event_type) AS m FROM e) GROUP BY start, event_type
""")
def window_argmax(t: Tables) -> DataFrame:
    return windows.window_argmax(t.events, ["event_type"], "ts", "value", "event_id", "6 hours", "1 hour")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
""")
def session_windows(t: Tables) -> DataFrame:
    return windows.sessions(t.events, ["user_id"], "ts", "value", "2 hours", "1 hour")
