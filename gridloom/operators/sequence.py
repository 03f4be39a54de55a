"""Window operators over ordered sequences: poses, motion, gaps, flicker, and order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import Motion
from gridloom.functions.lattice import d

#: Speed below which the heading is not trusted, and the largest stretch ahead.
MIN_SPEED, MAX_STRETCH = 0.5, 2.0


def pose_speed(poses: DataFrame) -> DataFrame:
    """Adds speed, hx, hy, stretch, reason from each frame's pose and its predecessor's (sequence, frame_id, ts_ns, px, py)."""
    w = Window.partitionBy("sequence").orderBy("frame_id")
    p = poses.withColumns({"dx": F.col("px") - F.lag("px").over(w), "dy": F.col("py") - F.lag("py").over(w), "dt": (F.col("ts_ns") - F.lag("ts_ns").over(w)) / d(1e9)})
    p = p.withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    p = p.withColumn("speed", F.coalesce(F.col("len") / F.col("dt"), d(0)))
    fast = F.col("speed") >= MIN_SPEED
    return p.select(
        *poses.columns,
        "speed",
        F.when(fast, F.col("dx") / F.col("len")).otherwise(d(1)).alias("hx"),
        F.when(fast, F.col("dy") / F.col("len")).otherwise(d(0)).alias("hy"),
        F.when(fast, d(1) + F.least(F.col("speed") / d(10), d(MAX_STRETCH - 1))).otherwise(d(1)).alias("stretch"),
        F.when(F.col("dt").isNull(), "first-pose").when(fast, "moving").otherwise("below-heading-threshold").alias("reason"),
    )


def order_violations(frames: DataFrame) -> DataFrame:
    """Frames whose id or time does not grow within their sequence, in order of arrival."""
    w = Window.partitionBy("sequence").orderBy("arrival")
    f = frames.withColumns({"prev_frame": F.lag("frame_id").over(w), "prev_ts": F.lag("ts_ns").over(w)})
    return f.where((F.col("frame_id") <= F.col("prev_frame")) | (F.col("ts_ns") <= F.col("prev_ts")))


def frame_gaps(frames: DataFrame, key: str = "sequence") -> DataFrame:
    """Adds gap: frames missing since the predecessor (0 for the first)."""
    w = Window.partitionBy(key).orderBy("frame_id")
    return frames.withColumn("gap", F.coalesce(F.col("frame_id") - F.lag("frame_id").over(w) - 1, F.lit(0)))


def motion_state(obs: DataFrame, m: Motion = Motion(), max_gap: int = 1) -> DataFrame:
    """Adds observations (of the last three, without a gap), span_s, speed, state, reason (track_id, frame_id, ts_ns, px, py, pz).

    state is 2 (moving), 1 (stationary) or 0 (unknown); a gap of over max_gap - 1 frames restarts the history.
    """
    w = Window.partitionBy("track_id").orderBy("frame_id")
    o = obs.withColumns({"g1": F.col("frame_id") - F.lag("frame_id").over(w) <= max_gap, "g2": F.lag("frame_id").over(w) - F.lag("frame_id", 2).over(w) <= max_gap})
    one, two = F.coalesce("g1", F.lit(False)), F.coalesce(F.col("g1") & F.col("g2"), F.lit(False))
    o = o.withColumn("observations", F.when(two, 3).when(one, 2).otherwise(1))
    first = lambda c: F.when(F.col("observations") == 3, F.lag(c, 2).over(w)).when(F.col("observations") == 2, F.lag(c).over(w)).otherwise(F.col(c))
    o = o.withColumns({f"f_{c}": first(c) for c in ("ts_ns", "px", "py", "pz")})
    o = o.withColumn("span_s", (F.col("ts_ns") - F.col("f_ts_ns")) / d(1e9))
    ready = (F.col("observations") == 3) & (F.col("span_s") >= m.min_span_s)
    v = [(F.col(c) - F.col(f"f_{c}")) / F.when(F.col("span_s") > 0, F.col("span_s")) for c in ("px", "py", "pz")]
    o = o.withColumn("speed", F.when(ready, F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])))
    state = F.when(F.col("speed") > m.moving_min, 2).when(F.col("speed") < m.stationary_max, 1).otherwise(0)
    o = o.withColumn("state", state)
    reason = F.when(F.col("speed").isNull(), "insufficient-history").when(F.col("state") > 0, "estimated").otherwise("threshold-band")
    return o.withColumn("reason", reason).select(*obs.columns, "observations", "span_s", "speed", "state", "reason")


def flicker(cells: DataFrame, state: str) -> DataFrame:
    """Per frame: cells seen in the frame before too, and how many changed state (frame_id, level, ix, iy, state)."""
    now = cells.select("frame_id", "level", "ix", "iy", F.col(state).alias("now"))
    before = cells.select((F.col("frame_id") + 1).alias("frame_id"), "level", "ix", "iy", F.col(state).alias("before"))
    both = now.join(before, ["frame_id", "level", "ix", "iy"])
    return both.groupBy("frame_id").agg(F.count("*").alias("common"), F.count_if(F.col("now") != F.col("before")).alias("changed"))


def camera_to_map(poses: DataFrame, calibration: list[float]) -> DataFrame:
    """sequence, frame_id, pose (16) of the sensor in the map: camera pose times calibration, from the first frame's sensor.

    poses.pose has 12 or 16 row-major numbers; calibration maps sensor to camera.
    """
    cal = F.array(*map(d, [*calibration[:12], 0, 0, 0, 1]))
    whole = F.concat(F.slice("pose", 1, 12), F.array(d(0), d(0), d(0), d(1)))
    p = poses.select("sequence", "frame_id", product(whole, cal).alias("t"))
    first = F.first("t").over(Window.partitionBy("sequence").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = p.withColumn("origin", first)
    return p.select("sequence", "frame_id", product(rigid_inverse(F.col("origin")), F.col("t")).alias("pose"))


def product(a, b):
    """The product of two row-major 4 x 4 matrices."""
    at = lambda m, r, c: F.element_at(m, 4 * r + c + 1)
    return F.array(*[sum((at(a, r, k) * at(b, k, c) for k in range(1, 4)), at(a, r, 0) * at(b, 0, c)) for r in range(4) for c in range(4)])


def rigid_inverse(m):
    at = lambda r, c: F.element_at(m, 4 * r + c + 1)
    rows = []
    for r in range(3):
        rows += [at(0, r), at(1, r), at(2, r), -(at(0, r) * at(0, 3) + at(1, r) * at(1, 3) + at(2, r) * at(2, 3))]
    return F.array(*rows, d(0), d(0), d(0), d(1))
