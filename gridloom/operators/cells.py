"""Per-frame cell snapshot: one hash aggregation by (frame, level, ix, iy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.config import Grid
from gridloom.functions.labels import GROUND, MOVING, NONGROUND, STATIONARY, UNKNOWN
from gridloom.functions.lattice import base_index, cell, d, owner_level, pick
from gridloom.operators.gates import finite

KEY = ("frame_id", "level", "ix", "iy")


def keyed(points: DataFrame, grid: Grid, ahead: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Adds bx, by and the owning cell's level, ix, iy to accepted points (mx, my, sx, sy)."""
    out = points.withColumns({"bx": base_index(F.col("mx")), "by": base_index(F.col("my"))})
    out = out.withColumn("level", owner_level(F.col("bx"), F.col("by"), F.col("sx"), F.col("sy"), grid, ahead))
    return out.withColumns({"ix": cell(F.col("level"), F.col("bx"), grid), "iy": cell(F.col("level"), F.col("by"), grid)})


def class_counts(semantic: str = "semantic") -> list[Column]:
    return [F.count_if(F.col(semantic) == k).alias(f"c{k}") for k in range(20)]


def dominant(counts: Column) -> Column:
    """The most frequent class; 0 if several are equally frequent."""
    top = F.array_max(counts)
    return F.when(F.size(F.filter(counts, lambda c: c == top)) > 1, 0).otherwise(F.array_position(counts, top).cast("int") - 1)


def snapshot(points: DataFrame, grid: Grid) -> DataFrame:
    """Evidence of each observed cell; points need KEY, mz, ground, semantic, motion, intensity."""
    h = F.rint(F.col("mz") * d(100)).cast("long")
    ground, obstacle = F.col("ground") == GROUND, F.col("ground") == NONGROUND
    known = finite(F.col("intensity"))
    low = lambda mask: F.coalesce(F.min(F.when(mask, h)), F.lit(0)).cast("int")
    high = lambda mask: F.coalesce(F.max(F.when(mask, h)), F.lit(0)).cast("int")
    agg = points.groupBy(*KEY).agg(
        F.count("*").alias("point_count"),
        F.count_if(ground).alias("ground_count"),
        F.count_if(F.col("ground") == UNKNOWN).alias("unknown_ground_count"),
        F.count_if(obstacle).alias("obstacle_count"),
        low(ground).alias("g_low"),
        high(ground).alias("g_high"),
        F.coalesce(F.sum(F.when(ground, h)), F.lit(0)).alias("g_sum"),
        F.coalesce(F.sum(F.when(ground, h * h)), F.lit(0)).alias("g_square"),
        low(F.lit(True)).alias("observed_min_cm"),
        high(F.lit(True)).alias("observed_max_cm"),
        low(obstacle).alias("obstacle_min_cm"),
        high(obstacle).alias("obstacle_max_cm"),
        F.count_if(F.col("motion") == STATIONARY).alias("n_still"),
        F.count_if(F.col("motion") == MOVING).alias("n_moving"),
        F.count_if(known).alias("n_intensity"),
        F.coalesce(F.sum(F.when(known, F.col("intensity").cast("double"))), d(0)).alias("s_intensity"),
        *class_counts(),
    )
    evidence = F.array(*[F.col(f"c{k}") for k in range(20)])
    n = F.greatest("ground_count", F.lit(1))
    mean = F.col("g_sum") / n
    size = pick(F.col("level"), grid.widths_m)
    agg = agg.withColumns({"span_cm": F.col("g_high") - F.col("g_low"), "evidence": evidence})
    agg = agg.withColumn("ambiguous", (F.col("ground_count") > 0) & (F.col("span_cm") > grid.ambiguous_span_m * 100))
    valid = (F.col("ground_count") > 0) & ~F.col("ambiguous")
    return agg.select(
        *KEY,
        ((F.col("ix") + d(0.5)) * size).alias("center_x_m"),
        ((F.col("iy") + d(0.5)) * size).alias("center_y_m"),
        size.alias("size_m"),
        "point_count",
        "ground_count",
        "unknown_ground_count",
        F.when(valid, F.rint(mean)).otherwise(d(0)).cast("int").alias("ground_height_cm"),
        valid.alias("ground_valid"),
        F.col("span_cm").alias("ground_span_cm"),
        (F.greatest(F.col("g_square") / n - mean * mean, d(0)) / d(10000)).alias("ground_spread_m2"),
        "ambiguous",
        "observed_min_cm",
        "observed_max_cm",
        "obstacle_min_cm",
        "obstacle_max_cm",
        (F.col("obstacle_count") > 0).alias("obstacle_valid"),
        dominant(F.col("evidence")).alias("semantic"),
        F.array_join(F.col("evidence").cast("array<string>"), ",").alias("semantic_evidence"),
        (F.size(F.filter(F.slice("evidence", 2, 19), lambda c: c > 0)) > 1).alias("semantic_conflict"),
        F.when(F.col("n_moving") > 0, MOVING).when(F.col("n_still") == F.col("point_count"), STATIONARY).otherwise(UNKNOWN).alias("motion"),
        (F.col("s_intensity") / F.greatest("n_intensity", F.lit(1))).alias("intensity_mean"),
        (F.col("n_intensity") > 0).alias("intensity_valid"),
    )
