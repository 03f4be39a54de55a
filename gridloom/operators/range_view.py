"""Spherical range image: nearest return per pixel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import Grid
from gridloom.functions.lattice import d


def pixels(points: DataFrame, grid: Grid) -> DataFrame:
    """Adds range_m, eligible, pixel_row, pixel_col; returns outside the field of view are not eligible."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    low, high = math.radians(grid.fov_down_deg), math.radians(grid.fov_up_deg)
    out = points.withColumns({"range_m": F.sqrt(x * x + y * y + z * z), "elevation": F.atan2(z, F.sqrt(x * x + y * y)), "azimuth": F.atan2(y, x)})
    row = F.floor((d(high) - F.col("elevation")) / d(high - low) * d(grid.rows))
    col = F.floor((F.col("azimuth") + d(math.pi)) / d(2 * math.pi) * d(grid.columns))
    return out.withColumns(
        {
            "eligible": (F.col("range_m") > 0) & F.col("elevation").between(d(low), d(high)),
            "pixel_row": F.greatest(F.least(row, F.lit(grid.rows - 1)), F.lit(0)).cast("int"),
            "pixel_col": F.pmod(col, F.lit(grid.columns)).cast("int"),
        }
    )


def range_image(points: DataFrame, grid: Grid) -> DataFrame:
    """frame_id, pixel_row, pixel_col, range_m, point_id: equal ranges keep the smallest id."""
    best = F.min(F.struct("range_m", "point_id"))
    return pixels(points, grid).where("eligible").groupBy("frame_id", "pixel_row", "pixel_col").agg(best.alias("b")).select("frame_id", "pixel_row", "pixel_col", "b.range_m", "b.point_id")


def range_summary(points: DataFrame, grid: Grid) -> DataFrame:
    """Filled pixels, collisions and returns outside the field of view of each frame."""
    per = pixels(points, grid).groupBy("frame_id", F.when(F.col("eligible"), F.struct("pixel_row", "pixel_col")).alias("pixel")).agg(F.count("*").alias("n"))
    inside = F.col("pixel").isNotNull()
    return per.groupBy("frame_id").agg(
        F.count_if(inside).alias("filled"),
        (F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)) - F.count_if(inside)).alias("collisions"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outside"),
    )
