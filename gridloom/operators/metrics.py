"""Evaluation: confusion and IoU by range, matching, association, percentiles, diffs, voxel scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.labels import GROUND_CLASSES, class_of_raw
from gridloom.functions.lattice import d, pick

BANDS = ("0-20m", "20-50m", "50m+")
VOXEL_M, VOXELS, VOXEL_ORIGIN = 0.2, (256, 256, 32), (0.0, -25.6, -2.0)


def band(r: Column) -> Column:
    return F.when(r < 20, BANDS[0]).when(r < 50, BANDS[1]).otherwise(BANDS[2])


def confusion(points: DataFrame) -> DataFrame:
    """band ('all' too), pred, truth, n of points (pred, truth, range_m)."""
    p = points.withColumn("band", band(F.col("range_m")))
    out = p.groupingSets([["band", "pred", "truth"], ["pred", "truth"]], "band", "pred", "truth").agg(F.count("*").alias("n"))
    return out.withColumn("band", F.coalesce("band", F.lit("all")))


def class_iou(conf: DataFrame) -> DataFrame:
    """band, cls, tp, union, iou of classes 1..19; points of unknown truth count for nothing, a class without points scores 0."""
    valid = conf.where(F.col("truth") != 0)
    per = valid.select("band", F.explode(F.array(F.struct(F.col("pred").alias("cls"), F.lit(True).alias("p"), F.lit(False).alias("t")), F.struct(F.col("truth").alias("cls"), F.lit(False).alias("p"), F.lit(True).alias("t")))).alias("s"), "pred", "truth", "n")
    agg = per.groupBy("band", "s.cls").agg(F.sum(F.when(F.col("s.t") & (F.col("pred") == F.col("truth")), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    agg = agg.where("cls > 0").withColumn("union", F.col("both") - F.col("tp"))
    return agg.select("band", "cls", "tp", "union", (F.col("tp") / F.col("union")).alias("iou"))


def semantic_metrics(conf: DataFrame) -> DataFrame:
    """band, points, labeled_points, unknown_predictions, unknown_coverage, miou_19, accuracy."""
    base = conf.groupBy("band").agg(
        F.sum("n").alias("points"),
        F.sum(F.when(F.col("truth") != 0, F.col("n")).otherwise(0)).alias("labeled_points"),
        F.sum(F.when(F.col("pred") == 0, F.col("n")).otherwise(0)).alias("unknown_predictions"),
        F.sum(F.when((F.col("truth") != 0) & (F.col("truth") == F.col("pred")), F.col("n")).otherwise(0)).alias("hits"),
    )
    iou = class_iou(conf).groupBy("band").agg((F.sum("iou") / d(19)).alias("miou_19"))
    return base.join(iou, "band", "left").select("band", "points", "labeled_points", "unknown_predictions", (F.col("unknown_predictions") / F.col("points")).alias("unknown_coverage"), "miou_19", F.try_divide("hits", "labeled_points").alias("accuracy"))


def match_segments(points: DataFrame, least: int = 1) -> DataFrame:
    """frame_id, label, gt, pred, iou of segments that overlap by more than half; points (frame_id, label, gt, pred; 0: none).

    IoU over one half makes a match unique, so no greedy loop is needed.
    """
    t = points.where("gt > 0").groupBy("frame_id", "label", "gt").agg(F.count("*").alias("n_gt")).where(F.col("n_gt") >= least)
    p = points.where("pred > 0").groupBy("frame_id", "label", "pred").agg(F.count("*").alias("n_pred")).where(F.col("n_pred") >= least)
    both = points.where("gt > 0 and pred > 0").groupBy("frame_id", "label", "gt", "pred").agg(F.count("*").alias("n"))
    both = both.join(t, ["frame_id", "label", "gt"]).join(p, ["frame_id", "label", "pred"])
    out = both.withColumn("iou", F.col("n") / (F.col("n_gt") + F.col("n_pred") - F.col("n")))
    return out.where("iou > 0.5").select("frame_id", "label", "gt", "pred", "iou")


def association(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Per label: tp, fp, fn, id switches, fragmentations, false tracks, weighted Jaccard.

    truth (frame_id, label, gt), predicted (frame_id, label, pred), matches (frame_id, label, gt, pred).
    """
    w = Window.partitionBy("label", "gt").orderBy("frame_id")
    seen = truth.join(matches.select("frame_id", "label", "gt", "pred"), ["frame_id", "label", "gt"], "left")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumns({"last": F.last("pred", ignorenulls=True).over(before), "was": F.lag(F.col("pred").isNotNull()).over(w)})
    hit = F.col("pred").isNotNull() & F.col("last").isNotNull()
    per = seen.groupBy("label").agg(
        F.count_if(F.col("pred").isNotNull()).alias("tp"),
        F.count_if(F.col("pred").isNull()).alias("fn"),
        F.count_if(hit & (F.col("last") != F.col("pred"))).alias("id_switches"),
        F.count_if(hit & ~F.col("was")).alias("fragmentations"),
    )
    n_gt = truth.groupBy("label", "gt").agg(F.count("*").alias("n_gt"))
    n_pred = predicted.groupBy("label", "pred").agg(F.count("*").alias("n_pred"))
    pairs = matches.groupBy("label", "gt", "pred").agg(F.count("*").alias("n")).join(n_gt, ["label", "gt"]).join(n_pred, ["label", "pred"])
    weight = pairs.groupBy("label").agg(F.sum(F.col("n") * F.col("n") / (F.col("n_gt") + F.col("n_pred") - F.col("n"))).alias("weighted"))
    lone = n_pred.join(matches.select("label", "pred").distinct(), ["label", "pred"], "left_anti").groupBy("label").agg(F.count("*").alias("false_tracks"))
    fp = predicted.join(matches.select("frame_id", "label", "pred"), ["frame_id", "label", "pred"], "left_anti").groupBy("label").agg(F.count("*").alias("fp"))
    out = per.join(weight, "label", "left").join(lone, "label", "left").join(fp, "label", "left").fillna(0, ["false_tracks", "fp", "weighted"])
    return out.select("label", "tp", "fp", "fn", "id_switches", "fragmentations", "false_tracks", F.try_divide("weighted", "tp").alias("association_jaccard"))


def panoptic_quality(truth: DataFrame, predicted: DataFrame, matches: DataFrame, *by: str) -> DataFrame:
    """by, tp, fp, fn, recall, pq of segments; truth and predicted have frame_id, by and gt or pred, matches iou too."""
    key = ["frame_id", *by]
    t = truth.join(matches.select(*key, "gt", "iou"), [*key, "gt"], "left").groupBy(*by).agg(F.count("iou").alias("tp"), F.count_if(F.col("iou").isNull()).alias("fn"), F.coalesce(F.sum("iou"), d(0)).alias("s"))
    p = predicted.join(matches.select(*key, "pred"), [*key, "pred"], "left_anti").groupBy(*by).agg(F.count("*").alias("fp"))
    out = t.join(p, list(by), "left").fillna(0, ["fp"])
    return out.select(*by, "tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("s", F.col("tp") + (F.col("fp") + F.col("fn")) / d(2)).alias("pq"))


def deadlines(df: DataFrame, value: str, limit: float, *by: str) -> DataFrame:
    """Runs, misses and the worst overrun of a time limit."""
    over = F.col(value) > limit
    return df.groupBy(*by).agg(F.count(value).alias("runs"), F.count_if(over).alias("misses"), F.coalesce(F.max(F.when(over, F.col(value) - d(limit))), d(0)).alias("worst"))


def coverage(cells: DataFrame, state: str, radius: float, *by: str) -> DataFrame:
    """Area (m2) of each state among cells whose centres lie within a radius of the sensor (center_x_m, center_y_m, size_m, sx, sy)."""
    dx, dy = F.col("center_x_m") - F.col("sx"), F.col("center_y_m") - F.col("sy")
    return cells.where(F.sqrt(dx * dx + dy * dy) < radius).groupBy(*by, state).agg(F.count("*").alias("cells"), F.sum(F.col("size_m") * F.col("size_m")).alias("area_m2"))


def percentiles(df: DataFrame, value: str, *by: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact linear percentiles and the maximum of each group."""
    p = F.percentile(value, F.array(*map(d, at)))
    names = [f"p{round(x * 100)}" for x in at]
    return df.groupBy(*by).agg(p.alias("p"), F.max(value).alias("max"), F.count(value).alias("n")).select(*by, *[F.element_at("p", i + 1).alias(n) for i, n in enumerate(names)], "max", "n")


def run_diff(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ between two runs or that one of them lacks, with the number of differing columns."""
    one, two = (t.select(*key, F.struct(*values).alias(n)) for t, n in ((a, "one"), (b, "two")))
    both = one.join(two, key, "full")
    unlike = sum((F.when(F.col(f"one.{v}").eqNullSafe(F.col(f"two.{v}")), 0).otherwise(1) for v in values), F.lit(0))
    out = both.withColumns({"missing": F.when(F.col("one").isNull(), "first").when(F.col("two").isNull(), "second").otherwise("none"), "differing": unlike})
    return out.where((F.col("differing") > 0) | (F.col("missing") != "none")).select(*key, "missing", "differing")


def payload_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def agreement(df: DataFrame, one: str, two: str, score_one: str, score_two: str, *by: str) -> DataFrame:
    """Share of equal classes and largest and 99.9th-percentile score difference."""
    delta = F.abs(F.col(score_one) - F.col(score_two))
    return df.groupBy(*by).agg(F.avg((F.col(one) == F.col(two)).cast("double")).alias("agreement"), F.max(delta).alias("max_delta"), F.percentile(delta, d(0.999)).alias("p999_delta"), F.count("*").alias("n"))


def drivability(cells: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and IoU of drivable against true drivable cells (booleans drivable, truth; truth null: unlabelled)."""
    n = lambda a, b: F.count_if((F.col("drivable") == a) & (F.col("truth") == b))
    agg = cells.where("truth is not null").groupBy(*by).agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    return agg.select(*by, "tp", "fp", "fn", "tn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"))


def recall_gap(cells: DataFrame, sigma_limit: float, *by: str) -> DataFrame:
    """Why true drivable cells are not shown drivable: the first reason that applies (truth, drivable, seen, stale, occupied, sigma, step, semantic_ok)."""
    reason = (
        F.when(~F.col("seen"), "never-seen")
        .when(F.col("stale"), "stale")
        .when(F.col("occupied"), "occupied")
        .when(F.col("sigma") > sigma_limit, "uncertain-height")
        .when(F.col("step"), "step")
        .when(~F.col("semantic_ok"), "class")
        .otherwise("other")
    )
    return cells.where("truth and not drivable").groupBy(*by, reason.alias("reason")).agg(F.count("*").alias("cells"))


# ---------------------------------------------------------------- voxels


def voxel(x: Column, y: Column, z: Column) -> list[Column]:
    return [F.floor((c - d(o)) / d(VOXEL_M)).cast("int") for c, o in zip((x, y, z), VOXEL_ORIGIN)]


def inside(vx: Column, vy: Column, vz: Column) -> Column:
    return vx.between(0, VOXELS[0] - 1) & vy.between(0, VOXELS[1] - 1) & vz.between(0, VOXELS[2] - 1)


def voxel_iou(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """frame_id, both, union, iou of two voxel sets (frame_id, vx, vy, vz); 1 where both are empty."""
    key = ["frame_id", "vx", "vy", "vz"]
    a, b = (t.select(*key).distinct().withColumn(n, F.lit(1)) for t, n in ((ours, "a"), (theirs, "b")))
    out = a.join(b, key, "full").groupBy("frame_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("*").alias("union"))
    return out.withColumn("iou", F.col("both") / F.col("union"))


def free_samples(cells: DataFrame, widths: tuple[float, ...], tau: float = 0.10, spacing: float = 0.1) -> DataFrame:
    """Sample points covering each free cell and the claimed height band: adds x, y, z (map coordinates)."""
    out = None
    heights = [-VOXEL_M + 0.1 * i for i in range(int(math.floor((tau + 2 * VOXEL_M + 1e-9) / 0.1)) + 1)]
    for k, w in enumerate(widths):
        n = math.ceil(w / spacing) + 1
        offsets = [1e-6 + i * ((w - 2e-6) / (n - 1)) for i in range(n)]
        grid = F.explode(F.array(*[F.struct(d(a).alias("a"), d(b).alias("b")) for a in offsets for b in offsets]))
        part = cells.where(F.col("level") == k).select("*", grid.alias("o"))
        part = part.withColumns({"x": F.col("ix") * d(w) + F.col("o.a"), "y": F.col("iy") * d(w) + F.col("o.b")}).drop("o")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("dz", F.explode(F.array(*map(d, heights)))).withColumn("z", F.col("return_z_m") + F.col("dz")).drop("dz")


def score_free_cells(cells: DataFrame, voxels: DataFrame, widths: tuple[float, ...], tau: float = 0.10) -> DataFrame:
    """Per free cell: inside the volume, verifiable, false_free, moving_hit, unknown_hit, occluded_hit, blocking class.

    cells (frame_id, level, ix, iy, return_z_m) in the voxel grid's frame; voxels (frame_id, vx, vy, vz, raw,
    invalid, occluded) hold every voxel that is not plainly empty and valid.
    """
    s = free_samples(cells, widths, tau)
    vx, vy, vz = voxel(F.col("x"), F.col("y"), F.col("z"))
    s = s.withColumns({"vx": vx, "vy": vy, "vz": vz}).where(inside(F.col("vx"), F.col("vy"), F.col("vz")))
    s = s.select("frame_id", "level", "ix", "iy", "vx", "vy", "vz").distinct()
    s = s.join(voxels, ["frame_id", "vx", "vy", "vz"], "left").fillna({"raw": 0, "invalid": False, "occluded": False})
    cls = class_of_raw(F.col("raw"))
    s = s.withColumns({"cls": cls, "valid": ~F.col("invalid")})
    held = F.col("valid") & (F.col("raw") != 0)
    bad = held & (F.col("cls") != 0) & ~F.col("cls").isin(*GROUND_CLASSES)
    still = bad & (F.col("raw") < 252)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    got = s.groupBy("frame_id", "level", "ix", "iy").agg(
        any_(F.col("valid")).alias("verifiable"),
        any_(still).alias("false_free"),
        any_(bad & (F.col("raw") >= 252)).alias("moving_hit"),
        any_(held & (F.col("cls") == 0)).alias("unknown_hit"),
        any_(F.col("valid") & F.col("occluded") & (F.col("raw") == 0)).alias("occluded_hit"),
        F.coalesce(F.max(F.when(still, F.col("cls"))), F.lit(0)).alias("blocking_class"),
        F.lit(True).alias("inside"),
    )
    flags = ["inside", "verifiable", "false_free", "moving_hit", "unknown_hit", "occluded_hit"]
    return cells.join(got, ["frame_id", "level", "ix", "iy"], "left").fillna(False, flags).fillna(0, ["blocking_class"])


def false_free_rates(scored: DataFrame, widths: tuple[float, ...], *by: str) -> DataFrame:
    """Counts, areas (cm2) and rates of scored free cells."""
    ok, bad = F.col("verifiable"), F.col("verifiable") & F.col("false_free")
    area = F.round(pick(F.col("level"), widths) * pick(F.col("level"), widths) * 1e4).cast("long")
    agg = scored.groupBy(*by).agg(
        F.count("*").alias("free_cells"),
        F.count_if("inside").alias("inside_volume"),
        F.count_if(ok).alias("verifiable"),
        F.count_if(bad).alias("false_free"),
        F.count_if(ok & F.col("moving_hit")).alias("moving_trace_hits"),
        F.sum(F.when(ok, area).otherwise(0)).alias("verifiable_area_cm2"),
        F.sum(F.when(bad, area).otherwise(0)).alias("false_free_area_cm2"),
    )
    return agg.withColumns({"false_free_rate": F.try_divide("false_free", "verifiable"), "area_rate": F.try_divide("false_free_area_cm2", "verifiable_area_cm2")})
