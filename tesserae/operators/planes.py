"""Floors and ceilings of rooms: planes fitted in a seeded band of heights, counted on the whole cloud, and accepted
or refused with a reason.

A plane is h = a x + b y + c over the floor axes. Everything is sums for each room: a band is chosen by counts of heights, the fit
is least squares over the band and again over what lies near it, and the count is one pass over all points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import histogram, spatial

#: Fixed values of the measurement protocol, metres and counts.
HORIZONTAL = 0.95
BIN, SHARE, BAND = 0.02, 0.20, 0.08
FLOOR_NEAR, FLOOR_POINTS, FLOOR_BAND_POINTS, PLANE_POINTS = 0.02, 100, 100, 50
CEILING_NEAR, CEILING_LEAST, ABOVE_CAMERA = 0.04, 1.90, 0.15
CEILING_SHARE, CEILING_POINTS, CEILING_INTERIOR, CEILING_CELL = 0.02, 400, 0.15, 0.15


def _cosine() -> Column:
    return 1 / F.sqrt(1 + F.col("a") * F.col("a") + F.col("b") * F.col("b"))


def _near(distance: float) -> Column:
    return F.abs(F.col("h") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c"))) * _cosine() <= distance


def _band_fit(points: DataFrame, seeds: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """(keys, seed, in_band, in_plane, a, b, c): the fit in the band about each seed, made again on the points near the first
    one; in_plane are those points. Null where a band has no area."""
    band = points.join(seeds, keys).filter(F.abs(F.col("h") - F.col("seed")) <= BAND)
    first = spatial.plane_fit(band, keys, "x", "y", "h").withColumnRenamed("n", "in_band")
    close = band.join(first, keys).filter(_near(distance)).select(*keys, "x", "y", "h")
    again = spatial.plane_fit(close, keys, "x", "y", "h").withColumnRenamed("n", "in_plane")
    return seeds.join(first.select(*keys, "in_band"), keys, "left").join(again, keys, "left")


def floors(points: DataFrame, keys: list[str], distance: float = FLOOR_NEAR, least: int = FLOOR_POINTS, band_least: int = FLOOR_BAND_POINTS, plane_least: int = PLANE_POINTS) -> DataFrame:
    """(keys, method, a, b, c, inliers, total): the floor of each room of points (keys, x, y, h).

    The seed is the lowest well filled bin of heights, not the fullest. A plane with points enough that is level is the floor
    ("plane"); else the seed's height is ("band"); a room with fewer than `least` points has none ("too few points"). Inliers are
    counted on the whole cloud. Points with a null or NaN place do not count."""
    whole = points.select(*keys, "x", "y", "h").filter(" and ".join(f"{c} is not null and not isnan({c})" for c in ("x", "y", "h")))
    seeds = histogram.height_seeds(histogram.height_bins(whole, keys, "h", BIN, SHARE), keys).select(*keys, F.col("floor").alias("seed"))
    fit = _band_fit(whole, seeds, keys, distance)
    good = F.coalesce((F.col("in_band") >= band_least) & (F.col("in_plane") >= plane_least) & (_cosine() >= HORIZONTAL), F.lit(False))
    plane = fit.withColumn("good", good).select(*keys, "good", *[F.when(F.col("good"), F.col(n)).otherwise(other).alias(n) for n, other in (("a", F.lit(0.0)), ("b", F.lit(0.0)), ("c", F.col("seed")))])
    counted = whole.join(plane, keys).groupBy(*keys, "good", "a", "b", "c").agg(F.count_if(_near(distance)).alias("inliers"), F.count(F.lit(1)).alias("total"))
    few = F.col("total") < least
    value = lambda c: F.when(~few, F.col(c)).alias(c)
    return counted.select(*keys, F.when(few, "too few points").when(F.col("good"), "plane").otherwise("band").alias("method"), value("a"), value("b"), value("c"), value("inliers"), "total")


def ceilings(points: DataFrame, rooms: DataFrame, keys: list[str], distance: float = CEILING_NEAR, least: int = CEILING_POINTS, share: float = CEILING_SHARE, band_least: int = PLANE_POINTS) -> DataFrame:
    """(keys, reason, a, b, c, inliers, interior, total): the ceiling of each of the rooms (keys, floor, camera: heights), or why there is none.

    Looked for above the camera and a believable height, in the highest well filled bin's band. In this order, refused are: few points
    above, an empty band, no plane in it, a plane that is not level, few inliers in the whole cloud, one too low, and an outline: a
    ring where walls end has hardly a cell with all eight neighbours. reason is null for a ceiling that is accepted; the plane is
    given as far as it was found."""
    whole = points.select(*keys, "x", "y", "h").filter(" and ".join(f"{c} is not null and not isnan({c})" for c in ("x", "y", "h")))
    high = F.greatest(F.col("camera") + ABOVE_CAMERA, F.col("floor") + CEILING_LEAST)
    placed = whole.join(rooms.select(*keys, "floor", "camera"), keys)
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("h") > high).alias("above"))
    above = placed.filter(F.col("h") > high).select(*keys, "x", "y", "h")
    seeds = histogram.height_seeds(histogram.height_bins(above, keys, "h", BIN, SHARE), keys).select(*keys, F.col("ceiling").alias("seed"))
    fit = _band_fit(above, seeds, keys, distance)
    near = whole.join(fit.filter("c is not null").select(*keys, "a", "b", "c"), keys).filter(_near(distance))
    corner = near.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.count(F.lit(1)).alias("inliers"))
    cells = histogram.cells_of(near.join(corner, keys), keys, F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), CEILING_CELL)
    patch = histogram.patchiness(cells, keys).select(*keys, "interior")
    out = rooms.select(*keys, "floor").join(counts, keys, "left").join(fit, keys, "left").join(corner.select(*keys, "inliers"), keys, "left").join(patch, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    needed = F.greatest(F.lit(least), F.floor(share * zero("total")))
    reason = F.when(zero("above") < needed, "few points above").when(zero("in_band") < band_least, "empty band").when((zero("in_plane") < band_least) | F.col("c").isNull(), "no plane")
    reason = reason.when(_cosine() < HORIZONTAL, "not level").when(zero("inliers") < needed, "few inliers").when(F.col("c") - F.col("floor") < CEILING_LEAST, "too low").when(F.coalesce("interior", F.lit(0.0)) < CEILING_INTERIOR, "outline")
    return out.select(*keys, reason.alias("reason"), "a", "b", "c", zero("inliers").alias("inliers"), "interior", zero("total").alias("total"))
