"""Histogram seeds, edges and coverage of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def height_bins(rows: DataFrame, keys: list[str], value: str, width: float, share: float) -> DataFrame:
    """Bins from the least value up, with their count, centre, and whether they hold at least
    `share` of the fullest bin's count (seed candidates)."""
    least = rows.groupBy(*keys).agg(F.min(value).alias("__lo"))
    counts = rows.join(least, keys).groupBy(*keys, "__lo", F.floor((F.col(value) - F.col("__lo")) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    fullest = F.max("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, "bin", "n", (F.col("__lo") + (F.col("bin") + 0.5) * width).alias("centre"), (F.col("n") >= share * fullest).alias("supported"))


def height_seeds(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest and highest supported bin's centre (floor and ceiling), and how many there are."""
    good = bins.filter("supported")
    return good.groupBy(*keys).agg(F.min("centre").alias("floor"), F.max("centre").alias("ceiling"), F.count(F.lit(1)).alias("planes"))


def densest_edge(rows: DataFrame, keys: list[str], value: str, width: float, share: float = 0.5) -> DataFrame:
    """(low, high): from each end, the outer boundary of the first bin that holds at least `share`
    of an even spread. Empty bins hold nothing, so only filled ones are looked at."""
    stats = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("total"))
    stats = stats.withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width)))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.col("bins") - 1, F.floor((F.col(value) - F.col("lo")) / step))).otherwise(0)
    counts = rows.join(stats, keys).groupBy(*keys, "lo", "hi", "total", "bins", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    good = F.col("n") >= share * F.col("total") / F.col("bins")
    ends = counts.groupBy(*keys, "lo", "hi", "bins").agg(F.min(F.when(good, F.col("bin"))).alias("first"), F.max(F.when(good, F.col("bin"))).alias("last"))
    return ends.select(*keys, F.coalesce(F.col("lo") + F.col("first") * step, "lo").alias("low"), F.coalesce(F.col("lo") + (F.col("last") + 1) * step, "hi").alias("high"))


def cells_of(rows: DataFrame, keys: list[str], x: Column, y: Column, size: float) -> DataFrame:
    return rows.select(*keys, F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy")).distinct()


def patchiness(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (cx, cy) of each key: how many, the share of their bounding box that is filled, and
    the share whose eight neighbours are all filled. Each cell votes for its nine places, so it is
    one aggregation and no self-join."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    votes = cells.withColumn("d", near).groupBy(*keys, (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")).agg(
        F.count(F.lit(1)).alias("votes"), F.max(((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).cast("int")).alias("own"))
    own = votes.filter("own = 1")
    box = (F.max("cx") - F.min("cx") + 1) * (F.max("cy") - F.min("cy") + 1)
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) / box).alias("fill"), F.avg((F.col("votes") == 9).cast("double")).alias("interior"))


def voxel_means(rows: DataFrame, keys: list[str], axes: list[str], size: float) -> DataFrame:
    """Mean point and count of each voxel of a grid with a fixed origin."""
    cells = [F.floor(F.col(a) / size).alias(f"v_{a}") for a in axes]
    return rows.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in axes])
