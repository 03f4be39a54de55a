"""Point gates: validity, rigid transform, region, height; and their accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.config import Grid
from gridloom.functions.lattice import d


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < d(float("inf")))


def transform(x: Column, y: Column, z: Column, pose: Column) -> tuple[Column, Column, Column]:
    """A row-major 4 x 4 pose (array of 16) applied to a point."""
    p = [F.element_at(pose, i + 1) for i in range(16)]
    return tuple(x * p[4 * r] + y * p[4 * r + 1] + z * p[4 * r + 2] + p[4 * r + 3] for r in range(3))


def inverse_transform(x: Column, y: Column, z: Column, pose: Column) -> tuple[Column, Column, Column]:
    """The rigid inverse: the transposed rotation of the point less the translation."""
    p = [F.element_at(pose, i + 1) for i in range(16)]
    dx, dy, dz = x - p[3], y - p[7], z - p[11]
    return tuple(dx * p[c] + dy * p[4 + c] + dz * p[8 + c] for c in range(3))


def pose_is_valid(pose: Column) -> Column:
    """Bottom row (0, 0, 0, 1) within 1e-12 and a rotation: orthonormal, determinant 1, within 1e-3."""
    p = [F.element_at(pose, i + 1) for i in range(16)]
    rows = [[p[4 * r + c] for c in range(3)] for r in range(3)]
    ok = F.size(pose) == 16
    for c, want in zip(p[12:], (0, 0, 0, 1)):
        ok = ok & (F.abs(c - d(want)) <= d(1e-12))
    for a in range(3):
        for b in range(3):
            dot = sum((x * y for x, y in zip(rows[a], rows[b])), d(0))
            ok = ok & (F.abs(dot - d(float(a == b))) <= d(1e-3))
    (a, b, c), (e, f, g), (h, i, j) = rows
    det = a * (f * j - g * i) - b * (e * j - g * h) + c * (e * i - f * h)
    return F.coalesce(ok & (F.abs(det - d(1)) <= d(1e-3)), F.lit(False))


def classify(points: DataFrame, grid: Grid) -> DataFrame:
    """Adds mx, my, mz (map coordinates) and status; points need x, y, z, pose, and sx, sy of the sensor.

    status is invalid, outside (region), high or accepted: each point has exactly one.
    """
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    valid = finite(x) & finite(y) & finite(z)
    valid = valid & (F.greatest(F.abs(x), F.abs(y), F.abs(z)) <= d(grid.max_abs_coordinate_m)) & (F.sqrt(x * x + y * y + z * z) >= d(grid.min_range_m))
    mx, my, mz = transform(x, y, z, F.col("pose"))
    out = points.withColumns({"mx": mx, "my": my, "mz": mz})
    dx, dy = F.col("mx") - F.col("sx"), F.col("my") - F.col("sy")
    planar = F.sqrt(dx * dx + dy * dy) if grid.footprint == "radial" else F.greatest(F.abs(dx), F.abs(dy))
    inside = (planar < d(grid.radii_m[-1])) & (F.greatest(F.abs("mx"), F.abs("my")) <= d(grid.max_abs_coordinate_m))
    status = F.when(~valid, "invalid").when(~inside, "outside").when(F.abs("mz") > d(grid.max_abs_height_m), "high").otherwise("accepted")
    return out.withColumn("status", status)


def accept(points: DataFrame, grid: Grid) -> DataFrame:
    return classify(points, grid).where("status = 'accepted'")


def accounting(points: DataFrame, grid: Grid) -> DataFrame:
    """frame_id and the number of points of each status; they add up to n_input."""
    n = lambda s: F.count_if(F.col("status") == s)
    return classify(points, grid).groupBy("frame_id").agg(
        F.count("*").alias("n_input"), n("invalid").alias("n_invalid"), n("outside").alias("n_outside"), n("high").alias("n_high"), n("accepted").alias("n_accepted")
    )
