"""Vector, camera and plane expressions over double columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def array_dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return array_dot(a, b) / F.sqrt(array_dot(a, a) * array_dot(b, b))


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def wrapped(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def yaw_of(forward_x: Column, forward_z: Column) -> Column:
    return F.atan2(forward_x, forward_z)


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length but 0; for length 0 all entries are null."""
    n = w * w + x * x + y * y + z * z
    s = F.when(n > 0, F.lit(2.0) / n)
    one = F.lit(1.0)
    return [
        [one - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
        [s * (x * y + w * z), one - s * (x * x + z * z), s * (y * z - w * x)],
        [s * (x * z - w * y), s * (y * z + w * x), one - s * (x * x + y * y)],
    ]


def ray_direction(u: Column, v: Column, fx, fy, cx, cy) -> Vector:
    return (u - cx) / fx, (v - cy) / fy, F.lit(1.0)


def unprojected(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> Vector:
    """Camera coordinates of a pixel; depth is along the camera's axis."""
    dx, dy, _ = ray_direction(u, v, fx, fy, cx, cy)
    return dx * depth, dy * depth, depth


def moved(rotation: list[list[Column]], p: Vector, shift: Vector) -> Vector:
    return tuple(dot(tuple(row), p) + t for row, t in zip(rotation, shift))


def on_plane(origin: Vector, direction: Vector, point: Vector, normal: Vector, least_cosine: float = 0.10, near: float = 0.2, far: float = 6.0) -> Column:
    """Distance along a ray to a plane; null for grazing rays and outside (near, far)."""
    facing = dot(direction, normal)
    t = F.when(F.abs(facing) > least_cosine, -dot(tuple(o - p for o, p in zip(origin, point)), normal) / facing)
    return F.when((t > near) & (t < far), t)


def plane_height(a: Column, b: Column, c: Column, d: Column, x: Column, z: Column) -> Column:
    """y of the plane a x + b y + c z + d = 0; null for a vertical plane."""
    return F.when(b != 0, -(a * x + c * z + d) / b)


def equivalent_focal(focal35: Column, width: Column, field: float = 65.0) -> Column:
    """Focal length in pixels from the 35 mm equivalent, else from a field of view in degrees."""
    return F.coalesce(focal35 / 36.0 * width, width / (2 * math.tan(math.radians(field) / 2)))
