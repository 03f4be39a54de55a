"""Data-quality rules, gates with three outcomes, and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import Fusion, Grid, Limits
from gridloom.functions.lattice import d, pick

LIMIT = 1 << 25


def cell_rules(grid: Grid) -> dict[str, Column]:
    """Rules of one published cell (level, ix, iy, size_m, center_x_m, center_y_m, ground_valid, ground_height_cm, point_count); true: broken."""
    w = pick(F.col("level"), grid.widths_m)
    return {
        "level": ~F.col("level").between(0, len(grid.sizes_cm) - 1),
        "index": (F.abs("ix") >= LIMIT) | (F.abs("iy") >= LIMIT),
        "geometry": (F.col("size_m") != w) | (F.col("center_x_m") != (F.col("ix") + d(0.5)) * w) | (F.col("center_y_m") != (F.col("iy") + d(0.5)) * w),
        "ground": ~F.col("ground_valid") & (F.col("ground_height_cm") != 0),
        "support": F.col("point_count") < 1,
    }


def terrain_rules(s: Fusion, now: Column) -> dict[str, Column]:
    """Rules of one fused cell (terrain, occupancy, flags, semantic, ground_valid, ground_sigma_m, ground_height_m, last_seen)."""
    stale = now - F.col("last_seen") > round(s.stale_s * 1e9)
    drivable = F.col("terrain") == 1
    return {
        "range": ~F.col("terrain").between(0, 4) | ~F.col("occupancy").between(0, 3) | ~F.col("flags").between(0, 7) | ~F.col("semantic").between(0, 19),
        "time": (F.col("last_seen") < 0) | (F.col("last_seen") > now),
        "valid": F.col("ground_valid") != F.col("ground_sigma_m").between(0, s.valid_sigma_m),
        "height": ~F.col("ground_valid") & (F.col("ground_height_m") != 0),
        "stale": ((F.col("terrain") == 4) != stale) | ((F.col("occupancy") == 3) != stale),
        "drivable": drivable & (~F.col("ground_valid") | ~F.col("semantic").isin(*s.drivable) | (F.col("flags").bitwiseAND(F.lit(3)) != 0)),
    }


def violations(df: DataFrame, rules: dict[str, Column], *by: str) -> DataFrame:
    """by, rule, broken for every rule (0 too), in one pass."""
    agg = df.groupBy(*by).agg(*[F.count_if(c).alias(f"_{n}") for n, c in rules.items()])
    return agg.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{n}").alias("broken")) for n in rules])).alias("r")).select(*by, "r.rule", "r.broken")


def repeated_cells(cells: DataFrame, *by: str) -> DataFrame:
    """Cells that are published more than once."""
    return cells.groupBy(*by, "level", "ix", "iy").agg(F.count("*").alias("n")).where("n > 1")


def covered_cells(cells: DataFrame, grid: Grid, *by: str) -> DataFrame:
    """Cells that a published coarser cell covers, once for each that does: every cell's ancestors look for themselves in one semi-join."""
    own = pick(F.col("level"), [float(r) for r in grid.ratios])
    up = lambda c, k: F.floor(F.col(c) / (d(grid.ratios[k]) / own)).cast("long")
    if len(grid.ratios) == 1:
        return cells.select(*by, "level", "ix", "iy").limit(0)
    above = [F.when((F.col("level") >= 0) & (F.col("level") < k), F.struct(F.lit(k).alias("k"), up("ix", k).alias("cx"), up("iy", k).alias("cy"))) for k in range(1, len(grid.ratios))]
    fine = cells.select(*by, "level", "ix", "iy", F.explode(F.filter(F.array(*above), lambda x: x.isNotNull())).alias("a"))
    coarse = cells.select(*by, F.col("level").alias("k"), F.col("ix").alias("cx"), F.col("iy").alias("cy"))
    return fine.select(*by, "level", "ix", "iy", "a.*").join(coarse, [*by, "k", "cx", "cy"], "left_semi").select(*by, "level", "ix", "iy")


def segment_crosses(x0: Column, y0: Column, dx: Column, dy: Column, low: tuple[Column, Column], high: tuple[Column, Column]) -> Column:
    """Whether the open segment from (x0, y0) by (dx, dy) passes through the open rectangle before its end (slab test)."""
    ok: Column = F.lit(True)
    enter, leave = d(0), d(1)
    for s, v, lo, hi in zip((x0, y0), (dx, dy), low, high):
        still = v == 0
        ok = ok & (~still | ((lo < s) & (s < hi)))
        step = F.when(still, d(1)).otherwise(v)
        a, b = (lo - s) / step, (hi - s) / step
        enter = F.when(still, enter).otherwise(F.greatest(enter, F.least(a, b)))
        leave = F.when(still, leave).otherwise(F.least(leave, F.greatest(a, b)))
    return ok & (enter < leave) & (enter < 1) & (leave > 0)


def unsupported_free(free: DataFrame, beams: DataFrame, grid: Grid) -> DataFrame:
    """Free cells whose proof beam is missing, ends in the cell or does not cross it (free: frame_id, level, ix, iy, beam_point_id, ray_support; beams: frame_id, point_id, sx, sy, mx, my)."""
    w = pick(F.col("level"), grid.widths_m)
    j = free.join(beams.select("frame_id", F.col("point_id").alias("beam_point_id"), "sx", "sy", "mx", "my"), ["frame_id", "beam_point_id"], "left")
    low, high = (F.col("ix") * w, F.col("iy") * w), (F.col("ix") * w + w, F.col("iy") * w + w)
    ends = (F.col("mx") >= low[0]) & (F.col("mx") < high[0]) & (F.col("my") >= low[1]) & (F.col("my") < high[1])
    crosses = segment_crosses(F.col("sx"), F.col("sy"), F.col("mx") - F.col("sx"), F.col("my") - F.col("sy"), low, high)
    return j.where(F.col("mx").isNull() | (F.col("ray_support") < 1) | ends | ~crosses).select("frame_id", "level", "ix", "iy", "beam_point_id")


def margin_breaches(free: DataFrame, conflicts: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """Free cells with a conflict point nearer than the margin: points meet cells by buckets of the coarsest width, then by distance."""
    w = pick(F.col("level"), grid.widths_m)
    size = max(grid.widths_m[-1], margin)
    f = free.select("frame_id", "level", "ix", "iy", (F.col("ix") * w).alias("x0"), (F.col("iy") * w).alias("y0"), w.alias("w"))
    f = f.withColumns({"qx": F.floor(F.col("x0") / size), "qy": F.floor(F.col("y0") / size)})
    c = conflicts.select("frame_id", "mx", "my", F.floor(F.col("mx") / size).alias("px"), F.floor(F.col("my") / size).alias("py"))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1, 2) for b in (-1, 0, 1, 2)]))
    c = c.select("*", near.alias("o")).withColumns({"qx": F.col("px") - F.col("o.a"), "qy": F.col("py") - F.col("o.b")})
    dx = F.greatest(F.col("x0") - F.col("mx"), F.col("mx") - F.col("x0") - F.col("w"), d(0))
    dy = F.greatest(F.col("y0") - F.col("my"), F.col("my") - F.col("y0") - F.col("w"), d(0))
    return f.join(c, ["frame_id", "qx", "qy"]).where(F.sqrt(dx * dx + dy * dy) < margin).select("frame_id", "level", "ix", "iy").distinct()


def lifecycle_violations(tracks: DataFrame, max_misses: int = 3) -> DataFrame:
    """Track rows that do not follow from the frame before (sequence, frame_id, track_id, instance_id, lifecycle, birth_ns, last_observed_ns, ts_ns)."""
    w = Window.partitionBy("sequence", "track_id").orderBy("frame_id")
    # Misses since the last observation: rows after it.
    t = tracks.withColumns({"seen": F.col("instance_id").isNotNull(), "was": F.lag("lifecycle").over(w), "birth": F.lag("birth_ns").over(w), "before": F.lag("last_observed_ns").over(w)})
    t = t.withColumn("block", F.sum(F.col("seen").cast("int")).over(w))
    t = t.withColumn("misses", F.row_number().over(Window.partitionBy("sequence", "track_id", "block").orderBy("frame_id")) - 1)
    expected = F.when(F.col("was").isNull(), "tentative").when(F.col("seen"), "confirmed").when((F.col("was") == "tentative") | (F.col("misses") >= max_misses), "expired").otherwise("occluded")
    wrong = (
        F.when(F.col("lifecycle") != expected, "lifecycle")
        .when(F.col("birth").isNotNull() & (F.col("birth") != F.col("birth_ns")), "birth-changed")
        .when(F.col("was") == "expired", "reused-id")
        .when(F.col("seen") & (F.col("last_observed_ns") != F.col("ts_ns")), "observation-time")
        .when(~F.col("seen") & (F.col("last_observed_ns") != F.col("before")), "observation-time")
    )
    return t.withColumn("rule", wrong).where("rule is not null").select("sequence", "frame_id", "track_id", "rule")


# The stages of a result, each with its schema number, and what later stages must bring along.
STAGES = {"diagnostic": 1, "semantic": 2, "candidate": 3, "tracking": 4, "visibility": 5, "complete": 6}
_SHA = "^[0-9a-f]{64}$"


def identity_violations(results: DataFrame, scans: DataFrame) -> DataFrame:
    """sequence, frame_id, rule of results that are not of the scan they name.

    results: sequence, frame_id, arrival (their order), ts_ns, schema, stage, run_id, revision, scan_digest, config_digest, weights_digest
    (null: no model), pose_quality, n_input; scans: sequence, frame_id, scan_ns, digest, n_points.
    """
    w = Window.partitionBy("sequence").orderBy("arrival", "frame_id")
    r = results.withColumns({"_frame": F.max("frame_id").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_ts": F.max("ts_ns").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    j = r.join(scans, ["sequence", "frame_id"], "left")
    number = F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("stage"))
    sha = lambda c: F.coalesce(F.col(c).rlike(_SHA), F.lit(False))
    learned = F.col("stage").isin("semantic", "candidate", "tracking", "visibility")
    rules = {
        "stage": number.isNull(),
        "schema": F.coalesce(number != F.col("schema"), F.lit(False)),
        "provenance": F.coalesce(F.col("run_id") == "", F.lit(True)) | ~sha("revision") | ~sha("config_digest"),
        "scan": F.col("digest").isNull() | (F.col("digest") != F.col("scan_digest")) | (F.col("scan_ns") != F.col("ts_ns")),
        "order": F.coalesce((F.col("frame_id") <= F.col("_frame")) | (F.col("ts_ns") <= F.col("_ts")), F.lit(False)),
        "count": F.coalesce(F.col("n_input") != F.col("n_points"), F.lit(False)),
        "pose": ~F.col("pose_quality").isin("unverified", "verified", "degraded") | ((F.col("stage") == "complete") & (F.col("pose_quality") == "unverified")),
        "model": (learned & ~sha("weights_digest")) | ((F.col("stage") == "diagnostic") & F.col("weights_digest").isNotNull()),
    }
    return _broken(j, rules, "sequence", "frame_id")


def _broken(df: DataFrame, rules: dict[str, Column], *keep: str) -> DataFrame:
    """keep, rule of each row and rule that it breaks."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(hits).alias("rule"))


def point_violations(points: DataFrame, source: DataFrame, stage: str) -> DataFrame:
    """frame_id, point_id, rule of result points (frame_id, point_id, place, semantic, confidence, support, reason, motion).

    source (frame_id, point_id, at) are the scan's points and their order; accepted ones keep it.
    """
    j = points.join(source.select("frame_id", "point_id", "at"), ["frame_id", "point_id"], "left")
    before = F.max("at").over(Window.partitionBy("frame_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("_before", before)
    unit = lambda c: F.col(c).isNotNull() & F.col(c).between(0, 1) & ~F.isnan(c)
    rules = {
        "alignment": F.col("at").isNull() | (F.col("at") <= F.col("_before")),
        "class": ~F.col("semantic").between(0, 19) | ~F.col("motion").between(0, 2),
        "confidence": ~unit("confidence"),
        "support": ~F.col("support").between(0, 2) | ~F.col("reason").between(0, 2),
        "unknown-reason": (F.col("semantic") == 0) & (F.col("reason") == 0),
        "unsupported": (F.col("semantic") != 0) & (F.col("support") == 0),
    }
    if stage == "diagnostic":
        rules["claims"] = (F.col("semantic") != 0) | (F.col("motion") != 0) | (F.col("support") != 0)
    elif stage != "complete":
        rules["claims"] = (F.col("motion") != 0) | (F.col("support") != (F.col("semantic") != 0).cast("int"))
    return _broken(j, rules, "frame_id", "point_id")


def instance_violations(instances: DataFrame, points: DataFrame, atol: float = 1e-6) -> DataFrame:
    """frame_id, instance_id, rule of instances that do not follow from their points.

    instances: frame_id, instance_id, semantic, score, status, point_ids, x0 .. z1 (bounds), center_x .. center_z;
    points: frame_id, point_id, mx, my, mz, semantic, the accepted points. Bounds and classes are computed again
    from the points; one point is of one instance at most; ids count from 0 in a frame.
    """
    key = ("frame_id", "instance_id")
    own = instances.select(*key, "semantic", F.explode("point_ids").alias("point_id"))
    j = own.join(points.select("frame_id", "point_id", "mx", "my", "mz", F.col("semantic").alias("_class")), ["frame_id", "point_id"], "left")
    shared = own.groupBy("frame_id", "point_id").agg(F.count_distinct("instance_id").alias("_owners")).where("_owners > 1")
    j = j.join(shared, ["frame_id", "point_id"], "left")
    again = j.groupBy(*key).agg(
        F.count_if(F.col("mx").isNull()).alias("_lost"),
        F.count_if((F.col("semantic") != 0) & (F.col("_class") != F.col("semantic"))).alias("_other"),
        F.count_if(F.col("_owners").isNotNull()).alias("_shared"),
        *[f(f"m{a}").alias(f"_{n}_{a}") for a in "xyz" for n, f in (("low", F.min), ("high", F.max))],
    )
    out = instances.join(again, list(key), "left").withColumn("_nth", F.row_number().over(Window.partitionBy("frame_id").orderBy("instance_id")) - 1)
    n, geometry, bounds = F.size("point_ids"), F.lit(False), F.lit(False)
    for a in "xyz":
        low, high, centre = F.col(f"{a}0"), F.col(f"{a}1"), F.col(f"center_{a}")
        known = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < d(float("inf"))), F.lit(False))
        geometry = geometry | ~known(low) | ~known(high) | ~known(centre) | (low > centre) | (centre > high)
        bounds = bounds | (F.abs(low - F.col(f"_low_{a}")) > atol) | (F.abs(high - F.col(f"_high_{a}")) > atol)
    rules = {
        "id": F.col("instance_id") != F.col("_nth"),
        "support": (n < 1) | (F.coalesce("_lost", F.lit(0)) > 0) | (F.size(F.array_distinct("point_ids")) != n),
        "support-order": F.sort_array("point_ids") != F.col("point_ids"),
        "overlap": F.coalesce("_shared", F.lit(0)) > 0,
        "class": ~F.col("semantic").between(0, 19) | F.isnan("score") | ~F.col("score").between(0, 1),
        "status": ~F.col("status").isin("observed", "ambiguous"),
        "ambiguity": (F.col("status") == "observed") & ((F.col("semantic") == 0) | (n < 3)),
        "geometry": geometry,
        "bounds": bounds,
        "class-support": F.coalesce("_other", F.lit(0)) > 0,
    }
    return _broken(out, rules, *key)


def track_violations(tracks: DataFrame, instances: DataFrame) -> DataFrame:
    """sequence, frame_id, track_id, rule of single track rows; instances: sequence, frame_id, instance_id of the same frames."""
    known = instances.select("sequence", "frame_id", F.col("instance_id").alias("_own")).distinct()
    j = tracks.join(known, (tracks["sequence"] == known["sequence"]) & (tracks["frame_id"] == known["frame_id"]) & (tracks["instance_id"] == known["_own"]), "left").select(*(tracks[c] for c in tracks.columns), "_own")
    j = j.withColumn("_times", F.count("*").over(Window.partitionBy("sequence", "frame_id", "track_id")))
    rules = {
        "id": (F.col("track_id") < 0) | (F.col("_times") > 1),
        "instance": F.col("instance_id").isNotNull() & F.col("_own").isNull(),
        "lifecycle": ~F.col("lifecycle").isin("tentative", "confirmed", "occluded", "expired"),
        "time": (F.col("birth_ns") < 0) | (F.col("birth_ns") > F.col("last_observed_ns")) | (F.col("last_observed_ns") > F.col("ts_ns")),
        "confidence": F.isnan("confidence") | ~F.col("confidence").between(0, 1),
    }
    return _broken(j, rules, "sequence", "frame_id", "track_id")


def resource_rules(limits: Limits = Limits()) -> dict[str, Column]:
    """Rules of a frame's diagnostics (input_points, map_cells, track_count, cells, tracks, queue_depth, queue_age_ms,
    dropped, invalid, process_ms, rss, device, device_status, swap, receipt, audit, disk_free); what is null is not judged."""
    c = F.col
    over = {
        "points": c("input_points") > limits.max_points, "map": c("map_cells") > limits.max_map_cells, "tracks": c("track_count") > limits.max_tracks,
        "queue": c("queue_depth") > limits.max_queue_depth, "queue-age": c("queue_age_ms") > d(limits.max_queue_age_ms), "memory": c("rss") > limits.max_process_rss_bytes,
        "device": c("device") > limits.max_device_memory_bytes, "swap": c("swap") > limits.max_swap_delta_bytes, "receipt": c("receipt") > limits.max_receipt_bytes,
        "audit": c("audit") > limits.max_audit_bytes, "disk": c("disk_free") < limits.min_disk_free_bytes,
    }
    counters = ("queue_depth", "dropped", "invalid", "rss", "device", "swap", "receipt", "audit", "disk_free")
    negative = F.exists(F.array(*[c(n).cast("long") for n in counters]), lambda x: F.coalesce(x < 0, F.lit(False)))
    wrong = {
        "timing": F.isnan("process_ms") | (c("process_ms") < 0) | (c("process_ms") == d(float("inf"))),
        "counter": negative,
        "state-size": (c("map_cells") != c("cells")) | (c("track_count") != c("tracks")),
        "device-sample": ~c("device_status").isin("unavailable", "sampled") | ((c("device_status") == "sampled") & c("device").isNull()),
    }
    return {n: F.coalesce(x, F.lit(False)) for n, x in (over | wrong).items()}


def gate(value: Column, limit: float | None, at_most: bool) -> Column:
    """passed, failed, or not-verified where the value or the limit is missing or not finite."""
    if limit is None:
        return F.lit("not-verified")
    bad = value > limit if at_most else value < limit
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not-verified").when(bad, "failed").otherwise("passed")


# The thresholds of the evaluation sheet (metric, limit, whether the value must be at most the limit).
GATES = (
    ("miou_19", 0.65, False), ("class_iou_min", 0.10, False), ("unknown_coverage", 0.01, True), ("range_miou_near", 0.60, False),
    ("range_miou_middle", 0.45, False), ("range_miou_far", 0.20, False), ("range_unknown", 0.02, True), ("thing_pq", 0.65, False),
    ("class_recall_min", 0.70, False), ("near_recall", 0.90, False), ("middle_recall", 0.85, False), ("far_recall", 0.70, False),
    ("small_recall", 0.85, False), ("medium_recall", 0.90, False), ("large_recall", 0.90, False),
    ("unmatched_per_100", 100.0, True), ("unsupported_free_cells", 0.0, True), ("false_free_rate", None, True), ("terrain_iou", None, False),
    ("false_drivable_rate", None, True), ("static_velocity_error_m", None, True), ("moving_velocity_error_m", None, True),
)


def gate_checks(metrics: DataFrame, gates=GATES) -> DataFrame:
    """run, metric, value, status of each gate; metrics (run, metric, value), one row each at most."""
    table = metrics.sparkSession.createDataFrame([(m, x, at) for m, x, at in gates], "metric string, bound double, at_most boolean")
    runs = metrics.select("run").distinct()
    # A gate for each run: the gates are a fixed short list.
    wanted = runs.select("run", F.explode(F.array(*[F.lit(m) for m, _, _ in gates])).alias("metric")).join(F.broadcast(table), "metric")
    j = wanted.join(metrics, ["run", "metric"], "left")
    v, b = F.col("value"), F.col("bound")
    missing = b.isNull() | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    status = F.when(missing, "not-verified").when((F.col("at_most") & (v > b)) | (~F.col("at_most") & (v < b)), "failed").otherwise("passed")
    return j.select("run", "metric", "value", status.alias("status"))


def overall(checks: DataFrame) -> DataFrame:
    """run, status, failures, missing: not-verified if a gate lacks evidence, else failed if one failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    agg = checks.groupBy("run").agg(n("failed").alias("failures"), n("not-verified").alias("missing"))
    return agg.withColumn("status", F.when(F.col("missing") > 0, "not-verified").when(F.col("failures") > 0, "failed").otherwise("passed"))


def receipts(cells: DataFrame, broken: DataFrame, *by: str) -> DataFrame:
    """by, rows, digest, status, error of each frame: a digest of its rows that does not depend on their order.

    Rows are hashed one by one; the digest covers the sorted hashes of a frame, which a scan bounds.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(cells.columns))), 256)
    body = cells.select(*by, row.alias("h")).groupBy(*by).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"))
    bad = broken.where("broken > 0").groupBy(*by).agg(F.min("rule").alias("error"))
    out = body.join(bad, list(by), "left")
    return out.withColumns({"status": F.when(F.col("error").isNull(), "accepted").otherwise("rejected"), "digest": F.when(F.col("error").isNull(), F.col("digest"))})


def audited(frames: DataFrame, every: int) -> DataFrame:
    """Adds deep: every n-th accepted frame of a sequence gets the deep audit, beginning with the first."""
    nth = F.row_number().over(Window.partitionBy("sequence").orderBy("frame_id")) - 1
    return frames.where("status = 'accepted'").withColumn("deep", nth % every == 0)
