"""Free space from sampled ground-beam corridors, less occupied cells and a safety margin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import FreeSpace, Grid
from gridloom.functions.labels import GROUND, GROUND_CLASSES, NONGROUND
from gridloom.functions.lattice import base_index, d, floor_div, pick
from gridloom.operators.cells import keyed

UNKNOWN, OCCUPIED, FREE, STALE, AMBIGUOUS = range(5)
CELL = ("frame_id", "level", "ix", "iy")


def partition_points(points: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Adds obstacle, clean and doubtful; support (frame_id, point_id) are the points of obstacle candidates."""
    obstacle: Column = F.col("ground") == NONGROUND
    if support is not None:
        points = points.join(support.select("frame_id", "point_id").distinct().withColumn("_held", F.lit(True)), ["frame_id", "point_id"], "left")
        obstacle = obstacle | F.coalesce("_held", F.lit(False))
    points = points.withColumn("obstacle", obstacle).withColumn("clean", (F.col("ground") == GROUND) & F.col("semantic").isin(*GROUND_CLASSES))
    return points.withColumn("doubtful", ~F.col("obstacle") & ~F.col("clean")).drop("_held")


def beams(points: DataFrame, grid: Grid, free: FreeSpace) -> DataFrame:
    """Clean ground returns that can prove space: adds fraction (where the corridor starts) and dist; needs sz, range_m."""
    dx, dy = F.col("mx") - F.col("sx"), F.col("my") - F.col("sy")
    out = points.where(F.col("clean") & (F.col("range_m") >= d(grid.ground_min_range_m)))
    out = out.withColumns({"dx": dx, "dy": dy, "dist": F.sqrt(dx * dx + dy * dy), "drop": F.col("sz") - F.col("mz")}).where("dist > 0 and drop > 0")
    length = F.least(d(free.corridor_m), d(free.tau_m) * F.col("dist") / F.col("drop"))
    return out.withColumn("fraction", F.greatest(d(0), d(1) - length / F.col("dist")))


def corridor_cells(beam: DataFrame, grid: Grid, free: FreeSpace) -> DataFrame:
    """CELL, ray_support, beam_point_id: cells strictly inside which a beam's corridor was sampled."""
    count = F.ceil(F.col("dist") * (d(1) - F.col("fraction")) / d(free.step_m)).cast("int")
    rays = beam.where(count > 0).select("frame_id", "point_id", "sx", "sy", "dx", "dy", "dist", "fraction", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    rays = rays.withColumn("u", F.col("fraction") + F.col("k") * d(free.step_m) / F.col("dist")).where("u < 1")
    rays = rays.withColumns({"mx": F.col("sx") + F.col("u") * F.col("dx"), "my": F.col("sy") + F.col("u") * F.col("dy")})
    rays = keyed(rays, grid).withColumn("w", pick(F.col("level"), grid.widths_m))
    inside = F.lit(True)
    for m, i in (("mx", "ix"), ("my", "iy")):
        low = F.col(i) * F.col("w")
        inside = inside & (F.col(m) - low > d(free.epsilon_m)) & (low + F.col("w") - F.col(m) > d(free.epsilon_m))
    # Samples of one beam in one cell merge before the shuffle. The test is an aggregate, as a filter would be
    # pushed below the lattice columns and repeat their whole expressions, beyond what Java can compile.
    pairs = rays.groupBy(*CELL, "point_id").agg(F.bool_or(inside).alias("inside")).where("inside")
    return pairs.groupBy(*CELL).agg(F.count("*").alias("ray_support"), F.min("point_id").alias("beam_point_id"))


def occupied_keys(points: DataFrame, grid: Grid) -> DataFrame:
    """CELL of all cells that hold a return, by the lattice rule and by plain division at every level."""
    own = keyed(points, grid).select(*CELL)
    plain = [points.select("frame_id", F.lit(k).alias("level"), F.floor(F.col("mx") / d(w)).cast("long").alias("ix"), F.floor(F.col("my") / d(w)).cast("long").alias("iy")) for k, w in enumerate(grid.widths_m)]
    out = own
    for p in plain:
        out = out.unionByName(p)
    return out.distinct()


def near_conflicts(points: DataFrame, grid: Grid, free: FreeSpace) -> DataFrame:
    """CELL of all cells within the margin (in whole cells) of a return that is not clean ground."""
    bad = points.where(~F.col("clean")).select("frame_id", base_index(F.col("mx")).alias("bx"), base_index(F.col("my")).alias("by"))
    out = None
    for k, (ratio, width) in enumerate(zip(grid.ratios, grid.widths_m)):
        steps = math.ceil(free.margin_m / width) + 1
        cells = bad.select("frame_id", F.lit(k).alias("level"), floor_div(F.col("bx"), ratio).alias("x"), floor_div(F.col("by"), ratio).alias("y")).distinct()
        span = F.sequence(F.lit(-steps), F.lit(steps))
        # Rows first, then columns: distinct after each keeps the expansion near the covered area.
        around = lambda c: F.explode(F.transform(span, lambda i: c + i))
        cells = cells.select("frame_id", "level", around(F.col("x")).alias("ix"), "y").distinct()
        cells = cells.select("frame_id", "level", "ix", around(F.col("y")).alias("iy")).distinct()
        out = cells if out is None else out.unionByName(cells)
    return out


def free_cells(points: DataFrame, grid: Grid, free: FreeSpace) -> DataFrame:
    """CELL, ray_support, beam_point_id, rejected of the kept free cells, by (level, ix, iy) up to the cap of a frame; rejected: cells of the frame beyond the cap."""
    found = corridor_cells(beams(points, grid, free), grid, free)
    found = found.join(occupied_keys(points, grid), list(CELL), "left_anti").join(near_conflicts(points, grid, free), list(CELL), "left_anti")
    order = Window.partitionBy("frame_id").orderBy("level", "ix", "iy")
    total = F.count("*").over(Window.partitionBy("frame_id"))
    found = found.withColumns({"nth": F.row_number().over(order), "rejected": F.greatest(F.lit(0).cast("long"), total - F.lit(free.max_cells))})
    return found.where(F.col("nth") <= free.max_cells).drop("nth")


def occupancy(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """CELL, obstacle_support, occupancy of observed cells; cells are a snapshot's CELL and ambiguous."""
    per = keyed(points, grid).groupBy(*CELL).agg(F.count_if("obstacle").alias("obstacle_support"), F.count_if("doubtful").alias("n_doubtful"))
    out = cells.join(per, list(CELL), "left").fillna(0, ["obstacle_support", "n_doubtful"])
    doubtful = F.col("ambiguous") | ((F.col("obstacle_support") == 0) & (F.col("n_doubtful") > 0))
    state = F.when(doubtful, AMBIGUOUS).when(F.col("obstacle_support") > 0, OCCUPIED).otherwise(UNKNOWN)
    return out.select(*CELL, "obstacle_support", state.alias("occupancy"))


def published(occupied: DataFrame, free: DataFrame) -> DataFrame:
    """Snapshot cells and free cells in one table, with defaults for what a kind lacks."""
    a = occupied.select(*CELL, "occupancy", "obstacle_support", F.lit(0).cast("long").alias("ray_support"), F.lit(-1).cast("long").alias("beam_point_id"))
    b = free.select(*CELL, F.lit(FREE).alias("occupancy"), F.lit(0).cast("long").alias("obstacle_support"), "ray_support", "beam_point_id")
    return a.unionByName(b)
