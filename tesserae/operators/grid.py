"""Masks of grid cells as runs of rows: (keys, row, x0, x1), both ends included, disjoint and not touching in a row.

Nothing allocates the grid: a far cell is one more run, and a hole is a component of gaps between runs. Windows are over one
row of one key, or over two neighbouring ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.session import Steps


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Any runs, overlapping or touching ones made one."""
    along = Window.partitionBy(*keys, "row").orderBy("x0", "x1")
    reached = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("__new", (reached.isNull() | (F.col("x0") > reached + 1)).cast("int"))
    marked = marked.withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "row", "__island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__island")


def stamped(cells: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """The cells (keys, cx, cy) within a distance of `radius` cells of the given ones."""
    disk = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.isqrt(radius * radius - d * d)).alias("w")) for d in range(-radius, radius + 1)])
    spread = cells.select(*keys, "cx", "cy").distinct().withColumn("__s", F.explode(disk))
    at = lambda c: c.cast("long")
    return merged(spread.select(*keys, at(F.col("cy") + F.col("__s.d")).alias("row"), at(F.col("cx") - F.col("__s.w")).alias("x0"), at(F.col("cx") + F.col("__s.w")).alias("x1")), keys)


def _rows_beside(runs: DataFrame, keys: list[str], half: int, wider: int) -> DataFrame:
    """Every run in its own row and the `half` rows on either side, `wider` at both ends."""
    beside = runs.withColumn("__d", F.explode(F.array(*[F.lit(d).cast("long") for d in range(-half, half + 1)])))
    return beside.select(*keys, (F.col("row") + F.col("__d")).alias("row"), (F.col("x0") - wider).alias("x0"), (F.col("x1") + wider).alias("x1"))


def dilated(runs: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Cells whose square of 2 half + 1 holds a cell of the mask."""
    return merged(_rows_beside(runs, keys, half, half), keys)


def eroded(runs: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Cells whose square of 2 half + 1 lies in the mask: in each row, stretches that all 2 half + 1 rows around
    it hold, counted along the row."""
    held = _rows_beside(runs, keys, half, -half).filter("x0 <= x1")
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("n")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("n")))
    steps = held.select(*keys, "row", F.explode(ends).alias("e")).groupBy(*keys, "row", F.col("e.x").alias("x")).agg(F.sum("e.n").alias("n"))
    along = Window.partitionBy(*keys, "row").orderBy("x")
    counted = steps.select(*keys, "row", F.col("x").alias("x0"), (F.lead("x").over(along) - 1).alias("x1"), F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return merged(counted.filter(F.col("n") == 2 * half + 1).drop("n"), keys)


def holes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of the free cells that no path over edges of free cells joins to the outside.

    Gaps between the runs of a row are the nodes; gaps of neighbouring rows that share a column are joined. Of
    two such gaps the later start lies in the other gap, the last of its row that starts no later, so one ordered pass over two rows finds
    all pairs. A gap that reaches beyond the first or last run of a neighbouring row touches the outside."""
    along = Window.partitionBy(*keys, "row").orderBy("x0")
    gaps = runs.select(*keys, "row", (F.col("x1") + 1).alias("x0"), (F.lead("x0").over(along) - 1).alias("x1")).filter("x1 is not null")
    gaps = Steps(runs.sparkSession).keep(gaps.withColumn("node", F.struct(*keys, "row", "x0")), "gaps")
    hull = runs.groupBy(*keys, "row").agg(F.min("x0").alias("h0"), F.max("x1").alias("h1"))
    open_ends = gaps
    for side, step in (("above", 1), ("below", -1)):
        near = hull.select(*keys, (F.col("row") - step).alias("row"), F.col("h0").alias(f"{side}0"), F.col("h1").alias(f"{side}1"))
        open_ends = open_ends.join(near, [*keys, "row"], "left")
    within = lambda side: F.coalesce((F.col("x0") >= F.col(f"{side}0")) & (F.col("x1") <= F.col(f"{side}1")), F.lit(False))
    outside = open_ends.filter(~(within("above") & within("below"))).select("node")
    both = gaps.select(*keys, F.explode(F.array(F.struct(F.col("row").alias("pair"), F.lit(0).alias("side")), F.struct((F.col("row") - 1).alias("pair"), F.lit(1).alias("side")))).alias("p"), "x0", "x1", "node")
    up_to = Window.partitionBy(*keys, "p.pair").orderBy("x0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.last(F.when(F.col("p.side") == side, F.struct("x1", "node")), ignorenulls=True).over(up_to)
    other = F.when(F.col("p.side") == 0, last(1)).otherwise(last(0))
    edges = both.select("x0", F.col("node").alias("a"), other.alias("o")).filter(F.col("o.x1") >= F.col("x0")).select("a", F.col("o.node").alias("b"))
    parts = graph.components(gaps.select("node"), edges)
    leaking = parts.join(outside, "node").select("component").distinct()
    closed = parts.join(leaking, "component", "left_anti").select("node")
    return gaps.join(closed, "node").select(*keys, "row", "x0", "x1")


def interior(floor: DataFrame, path: DataFrame, keys: list[str], radius: int = 7, half: int = 2) -> DataFrame:
    """Runs of a room's inside: floor cells and disks about the camera's path, closed by a square, holes filled.
    floor and path: keys, cx, cy; either may be empty; null cells go."""
    whole = lambda df: df.filter("cx is not null and cy is not null")
    marks = stamped(whole(floor), keys, 0).unionByName(stamped(whole(path), keys, radius))
    shut = Steps(floor.sparkSession).keep(eroded(dilated(merged(marks, keys), keys, half), keys, half), "shut")
    return merged(shut.unionByName(holes(shut, keys)), keys)


def cells(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cx, cy) of all cells of the runs."""
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("cx"), F.col("row").alias("cy"))
