"""Depth frames to a cloud: stride, unproject, filter, move, voxels, statistics. One plan over
all captures and frames; pixels are never shuffled before their voxels are summed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import finite, moved, quaternion_matrix, unprojected
from tesserae.operators.histogram import voxel_means


def strided(frames: DataFrame, keys: list[str], index: str, stride: int, least: int = 24) -> DataFrame:
    """Every stride-th frame, with a smaller stride where fewer than `least` frames would stay."""
    n = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    step = F.least(F.lit(stride), F.greatest(F.lit(1), F.floor(F.col("__n") / least)))
    return frames.join(n, keys).filter(F.col(index) % step == 0).drop("__n")


def world_points(pixels: DataFrame, poses: DataFrame, camera: DataFrame, keys: list[str], confidence: int = 2, near: float = 0.2, far: float = 5.0) -> DataFrame:
    """pixels (keys, frame, u, v, depth, confidence) to (keys, frame, x, y, z). poses (keys, frame,
    x, y, z, qw, qx, qy, qz); camera (keys, fx, fy, cx, cy), a row for each capture. Bounds on
    depth are open; frames without a pose are left out."""
    kept = pixels.filter((F.col("confidence") >= confidence) & (F.col("depth") > near) & (F.col("depth") < far))
    p = poses.select(*keys, "frame", *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "z", "qw", "qx", "qy", "qz")])
    j = kept.join(p, [*keys, "frame"]).join(camera, keys)
    local = unprojected(F.col("u"), F.col("v"), F.col("depth"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    turn = quaternion_matrix(F.col("p_qw"), F.col("p_qx"), F.col("p_qy"), F.col("p_qz"))
    x, y, z = moved(turn, local, (F.col("p_x"), F.col("p_y"), F.col("p_z")))
    return j.select(*keys, "frame", x.alias("x"), y.alias("y"), z.alias("z")).filter(finite(F.col("x"), F.col("y"), F.col("z")))


def fused(points: DataFrame, keys: list[str], voxel: float) -> DataFrame:
    """Mean points of voxels; as they are where the voxel is 0 or less."""
    return voxel_means(points, keys, ["x", "y", "z"], voxel) if voxel > 0 else points.select(*keys, "x", "y", "z")


def cloud_statistics(points: DataFrame, keys: list[str], floor: float = 0.0) -> DataFrame:
    spans = [F.round(F.max(c) - F.min(c), 6).alias(f"span_{c}") for c in ("x", "y", "z")]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *spans, F.round(F.percentile("y", 0.5), 6).alias("median_height"), F.round(F.avg((F.col("y") > floor).cast("double")), 6).alias("above"))
