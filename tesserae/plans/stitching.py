"""Rooms placed in one frame, over trees and circles that the star-schema tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import stitching
from tesserae.plans.registry import Tables, query


def _tree_edges(t: Tables) -> DataFrame:
    """Customer k hangs on customer k div 2, but every seventh starts a plan of its own; moves are made of its balance and nation."""
    key = F.col("c_custkey")
    hung = t.customer.filter((key > 1) & (key % 7 != 0))
    return hung.select(F.expr("c_custkey div 2").alias("a"), key.alias("b"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 10 - 1).alias("y"), (F.col("c_acctbal") / 5000).alias("yaw"), F.lit(1.0).alias("weight"))


@query("""
WITH RECURSIVE p AS (
  SELECT c_custkey AS node, c_custkey AS component, 0::double AS x, 0::double AS y, 0::double AS yaw FROM customer WHERE c_custkey = 1 OR c_custkey % 7 = 0
  UNION ALL
  SELECT c_custkey, component, x + cos(yaw) * c_acctbal / 1000 - sin(yaw) * (c_nationkey / 10 - 1), y + sin(yaw) * c_acctbal / 1000 + cos(yaw) * (c_nationkey / 10 - 1), yaw + c_acctbal / 5000
  FROM p JOIN customer ON c_custkey // 2 = node AND c_custkey > 1 AND c_custkey % 7 <> 0)
SELECT node, component, round(x, 5) AS x, round(y, 5) AS y, round(sin(yaw), 5) AS sin_yaw, round(cos(yaw), 5) AS cos_yaw FROM p
""")
def stitched_plan(t: Tables) -> DataFrame:
    """Every customer's pose in the frame of the least of its tree: moves composed by pointer jumping."""
    edges = _tree_edges(t)
    poses = stitching.spanning_poses(t.customer.select(F.col("c_custkey").alias("node")), edges)
    return poses.select("node", "component", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round(F.sin("yaw"), 5).alias("sin_yaw"), F.round(F.cos("yaw"), 5).alias("cos_yaw"))


@query("""
WITH r AS (SELECT p_partkey // 4 AS ring, p_partkey % 4 AS i, p_retailprice / 1000 AS dx, p_size / 10 AS dy FROM part),
f AS (SELECT ring FROM r GROUP BY ring HAVING count(*) = 4),
g AS (SELECT r.*, sum(dx) OVER (PARTITION BY ring) / 4 AS ex, sum(dy) OVER (PARTITION BY ring) / 4 AS ey FROM r JOIN f USING (ring))
SELECT ring * 4 + i AS node, ring * 4 AS component, round(coalesce(sum(dx - ex) OVER w, 0), 5) AS x, round(coalesce(sum(dy - ey) OVER w, 0), 5) AS y FROM g
WINDOW w AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def closed_circles(t: Tables) -> DataFrame:
    """Four rooms in a circle whose moves do not add up to nothing: least squares take a quarter of the gap off each move."""
    part = t.part.select("p_partkey", F.expr("p_partkey div 4").alias("ring"), (F.col("p_partkey") % 4).alias("i"), (F.col("p_retailprice") / 1000).alias("x"), (F.col("p_size") / 10).alias("y"))
    whole = part.groupBy("ring").count().filter("count = 4").select("ring")
    edges = part.join(whole, "ring").select(F.col("p_partkey").alias("a"), (F.col("ring") * 4 + (F.col("i") + 1) % 4).alias("b"), "x", "y", F.lit(0.0).alias("yaw"), F.lit(1.0).alias("weight"))
    poses = stitching.relaxed_poses(stitching.spanning_poses(edges.select(F.col("a").alias("node")), edges), edges)
    return poses.select("node", "component", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))
