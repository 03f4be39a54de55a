"""Temporal fusion: per-cell folds of scan evidence, and the terrain view of the last state.

A cell's state depends on its own scans alone, so fusion is a fold over each cell's scans in
time: aggregate() over a sorted array, no Python. Storage is 32-bit as the state's contract
says, arithmetic 64-bit. A cell that left the window between two scans starts anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import Fusion, Grid
from gridloom.functions.labels import GROUND, NONGROUND
from gridloom.functions.lattice import base_index, d, floor_div, owner_level

CELL = ("sequence", "level", "ix", "iy")
STATE = "struct<log_odds:float,height:float,variance:float,height_ns:bigint,low:float,high:float,last_seen:bigint,last_hit:bigint,last_free:bigint,observations:int,classes:array<int>>"
T_UNKNOWN, T_DRIVABLE, T_NOT, T_OBSTACLE, T_STALE = range(5)
CURB, DROP, OVERHANG = 1, 2, 4


def half_window(radius: float, width: float) -> int:
    return math.ceil(radius / width) + 1


def scan_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Each scan's evidence in the window's cells of every level (points: sequence, frame_id, ts_ns, mx, my, mz, ground, semantic, sx, sy)."""
    bx, by = base_index(F.col("mx")), base_index(F.col("my"))
    cx, cy = base_index(F.col("sx")), base_index(F.col("sy"))
    per = F.array(
        *[
            F.struct(F.lit(k).alias("level"), floor_div(bx, r).alias("ix"), floor_div(by, r).alias("iy"), floor_div(cx, r).alias("cx"), floor_div(cy, r).alias("cy"), F.lit(half_window(radius, w)).alias("half"))
            for k, (r, w, radius) in enumerate(zip(grid.ratios, grid.widths_m, grid.radii_m))
        ]
    )
    rows = points.select("sequence", "frame_id", "ts_ns", "mz", "ground", "semantic", F.explode(per).alias("c"))
    rows = rows.where((F.abs(F.col("c.ix") - F.col("c.cx")) <= F.col("c.half")) & (F.abs(F.col("c.iy") - F.col("c.cy")) <= F.col("c.half")))
    g, o = F.col("ground") == GROUND, F.col("ground") == NONGROUND
    agg = rows.groupBy("sequence", "frame_id", "ts_ns", "c.level", "c.ix", "c.iy").agg(
        F.count("*").alias("n"),
        F.count_if(g).alias("n_ground"),
        F.sum(F.when(g, F.col("mz")).otherwise(d(0))).alias("s1"),
        F.sum(F.when(g, F.col("mz") * F.col("mz")).otherwise(d(0))).alias("s2"),
        F.count_if(o).alias("n_obstacle"),
        F.min(F.when(o, F.col("mz"))).alias("low"),
        F.max(F.when(o, F.col("mz"))).alias("high"),
        *[F.count_if(F.col("semantic") == k).alias(f"c{k}") for k in range(20)],
    )
    mean = F.col("s1") / F.greatest("n_ground", F.lit(1))
    return agg.select(
        *CELL,
        "frame_id",
        "ts_ns",
        "n",
        "n_ground",
        "n_obstacle",
        "low",
        "high",
        mean.alias("mean_z"),
        F.greatest(F.col("s2") / F.greatest("n_ground", F.lit(1)) - mean * mean, d(0)).alias("spread"),
        F.array(*[F.col(f"c{k}") for k in range(20)]).alias("classes"),
        F.lit(False).alias("is_free"),
    )


def f32(c: Column) -> Column:
    return c.cast("float")


def step_log_odds(log_odds: Column, hit: Column, ground: Column, free: Column, s: Fusion) -> Column:
    """One scan's change: hit, else ground seen without a hit; then a free proof; then the bounds. 32-bit after each."""
    out = F.when(hit, f32(log_odds + f32(d(s.hit)))).when(ground, f32(log_odds - f32(d(s.ground_clear)))).otherwise(log_odds)
    out = F.when(free, f32(out - f32(d(s.miss)))).otherwise(out)
    return F.greatest(F.least(out, f32(d(s.high))), f32(d(s.low)))


def fresh() -> Column:
    f0 = F.lit(0.0).cast("float")
    never = F.lit(-1).cast("long")
    values = dict(log_odds=f0, height=f0, variance=F.lit(float("inf")).cast("float"), height_ns=never, low=f0, high=f0, last_seen=never, last_hit=never, last_free=never, observations=F.lit(0), classes=F.array(*[F.lit(0)] * 20))
    return F.struct(*(v.alias(k) for k, v in values.items())).cast(STATE)


def merge(state: Column, scan: Column, s: Fusion) -> Column:
    """The state after one scan (fields of scan_cells, plus restart)."""
    a = {k: F.when(scan["restart"], fresh()[k]).otherwise(state[k]) for k in ("log_odds", "height", "variance", "height_ns", "low", "high", "last_seen", "last_hit", "last_free", "observations", "classes")}
    hit, ground = scan["n_obstacle"] > 0, scan["n_ground"] > 0
    noise = F.greatest(scan["spread"], d(s.height_noise_m**2)) / F.greatest(scan["n_ground"], F.lit(1))
    elapsed = F.when(a["height_ns"] >= 0, (scan["ts_ns"] - a["height_ns"]) / d(1e9)).otherwise(d(0))
    prior = a["variance"].cast("double") + d(s.process_noise) * elapsed
    height = a["height"].cast("double")
    restart = (prior == d(float("inf"))) | (F.abs(scan["mean_z"] - height) > d(s.reset_jump_m))
    safe = F.when(restart, d(0)).otherwise(prior)
    gain = safe / (safe + noise)
    faded = F.zip_with(
        a["classes"],
        scan["classes"],
        lambda old, new: F.least(F.rint(f32(f32(old) * f32(d(s.decay))) + f32(f32(new) * f32(f32(d(50)) / f32(scan["n"])))).cast("int"), F.lit(255)),
    )
    seen = scan["n"] > 0
    return F.struct(
        step_log_odds(a["log_odds"], hit, ground, scan["is_free"], s).alias("log_odds"),
        F.when(ground, f32(F.when(restart, scan["mean_z"]).otherwise(height + gain * (scan["mean_z"] - height)))).otherwise(a["height"]).alias("height"),
        F.when(ground, f32(F.when(restart, noise).otherwise((d(1) - gain) * safe))).otherwise(a["variance"]).alias("variance"),
        F.when(ground, scan["ts_ns"]).otherwise(a["height_ns"]).alias("height_ns"),
        F.when(hit, f32(scan["low"])).otherwise(a["low"]).alias("low"),
        F.when(hit, f32(scan["high"])).otherwise(a["high"]).alias("high"),
        F.when(seen | scan["is_free"], scan["ts_ns"]).otherwise(a["last_seen"]).alias("last_seen"),
        F.when(hit, scan["ts_ns"]).otherwise(a["last_hit"]).alias("last_hit"),
        F.when(scan["is_free"], scan["ts_ns"]).otherwise(a["last_free"]).alias("last_free"),
        F.when(seen, a["observations"] + 1).otherwise(a["observations"]).alias("observations"),
        F.when(seen, faded).otherwise(a["classes"]).alias("classes"),
    ).cast(STATE)


def spans(frames: DataFrame) -> DataFrame:
    """sequence, i, j and the extremes of cx and cy over the 2**j frames from the i-th on (frames: sequence, i, x0, x1, y0, y1).

    Levels double, so a sequence of n frames has n log n rows and any stretch of frames is two of them. The driver
    only learns the length of the longest sequence.
    """
    longest = frames.agg(F.max("i")).first()[0] or 1
    w = Window.partitionBy("sequence").orderBy("i")
    ends = (("x0", F.least), ("x1", F.greatest), ("y0", F.least), ("y1", F.greatest))
    out = frames
    for j in range(1, longest.bit_length()):
        out = out.withColumns({f"{c}_{j}": f(F.col(c if j == 1 else f"{c}_{j - 1}"), F.lead(c if j == 1 else f"{c}_{j - 1}", 1 << (j - 1)).over(w)) for c, f in ends})
    level = lambda j: F.struct(F.lit(j).alias("j"), *(F.col(c if j == 0 else f"{c}_{j}").alias(c) for c, _ in ends))
    return out.select("sequence", "i", F.explode(F.array(*map(level, range(longest.bit_length())))).alias("s")).select("sequence", "i", "s.*")


def mark_restarts(scans: DataFrame, centres: DataFrame, grid: Grid) -> DataFrame:
    """Adds restart: the cell lay outside the window in some frame since its scan before.

    centres (sequence, frame_id, cx, cy) are the sensor's base indices. A cell was outside in some frame between
    two of its scans exactly if the window's extremes over those frames leave it out, so each scan row meets at most two rows
    of spans(). Scans without frames between carry a key that no span has, spread over frames.
    """
    known = centres.groupBy("sequence", "frame_id").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    every = known.select("sequence", "frame_id").unionByName(scans.select("sequence", "frame_id")).distinct().join(known, ["sequence", "frame_id"], "left")
    every = every.withColumn("i", F.row_number().over(Window.partitionBy("sequence").orderBy("frame_id")))
    table = spans(every.drop("frame_id"))
    s = scans.join(every.select("sequence", "frame_id", F.col("i").alias("_i")), ["sequence", "frame_id"])
    n = F.col("_i") - F.lag("_i").over(Window.partitionBy(*CELL).orderBy("frame_id")) - 1
    # bin() of the number of frames between has one digit more than the level of the widest span that fits.
    s = s.withColumn("_n", F.coalesce(n, F.lit(0))).withColumn("_j", F.when(F.col("_n") > 0, F.length(F.bin(F.col("_n").cast("long"))) - 1).otherwise(-1))
    starts = {"_p": F.col("_i") - F.col("_n"), "_q": F.col("_i") - F.when(F.col("_n") > 0, F.expr("shiftleft(1L, _j)")).otherwise(0)}
    s = s.withColumns(starts)
    for key, tag in (("_p", "a"), ("_q", "b")):
        own = table.select("sequence", F.col("i").alias(key), F.col("j").alias("_j"), *(F.col(c).alias(f"_{c}{tag}") for c in ("x0", "x1", "y0", "y1")))
        s = s.join(own, ["sequence", key, "_j"], "left")
    away: Column = F.lit(False)
    for k, (r, width, radius) in enumerate(zip(grid.ratios, grid.widths_m, grid.radii_m)):
        half = half_window(radius, width)
        out = F.lit(False)
        for index, c in (("ix", "x"), ("iy", "y")):
            low, high = F.least(f"_{c}0a", f"_{c}0b"), F.greatest(f"_{c}1a", f"_{c}1b")
            out = out | (F.col(index) - floor_div(low, r) > half) | (floor_div(high, r) - F.col(index) > half)
        away = away | ((F.col("level") == k) & out)
    return s.select(*scans.columns, F.coalesce(away, F.lit(False)).alias("restart"))


def fold(scans: DataFrame, s: Fusion, key: tuple[str, ...] = CELL) -> DataFrame:
    """key and the fields of STATE after the last of each cell's scans."""
    fields = ["ts_ns", "n", "n_ground", "n_obstacle", "low", "high", "mean_z", "spread", "classes", "is_free", "restart"]
    history = F.sort_array(F.collect_list(F.struct(*fields)))
    out = scans.groupBy(*key).agg(history.alias("scans"))
    return out.select(*key, F.aggregate("scans", fresh(), lambda a, x: merge(a, x, s)).alias("s")).select(*key, "s.*")


def dominant(classes: Column) -> Column:
    """The class of the largest evidence among 1..19 (the smallest id of equals), 0 without evidence."""
    known = F.slice(classes, 2, 19)
    top = F.array_max(known)
    return F.when(top > 0, F.array_position(known, top).cast("int")).otherwise(0)


def owned(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells that the lattice assigns to their own level; cells need level, ix, iy, sx, sy."""
    b = {c: F.expr("CASE " + " ".join(f"WHEN level = {k} THEN {c} * {r}" for k, r in enumerate(grid.ratios)) + " END") for c in ("ix", "iy")}
    first = owner_level(b["ix"], b["iy"], F.col("sx"), F.col("sy"), grid)
    return cells.where(first == F.col("level"))


def steps(state: DataFrame, s: Fusion) -> DataFrame:
    """Adds rise and drop: the largest height differences to the four neighbours with trusted ground."""
    trusted = state.where(F.col("variance") <= f32(d(s.valid_sigma_m**2))).select(*CELL, F.col("height").cast("double").alias("other"))
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = trusted.select("*", around.alias("o")).select("sequence", "level", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), "other")
    best = near.groupBy(*CELL).agg(F.max("other").alias("_high"), F.min("other").alias("_low"))
    out = state.join(best, list(CELL), "left")
    h = F.col("height").cast("double")
    return out.withColumns({"rise": F.greatest(F.coalesce(F.col("_high") - h, d(0)), d(0)), "drop": F.greatest(F.coalesce(h - F.col("_low"), d(0)), d(0))}).drop("_high", "_low")


def terrain(state: DataFrame, now: Column, s: Fusion) -> DataFrame:
    """Adds occupancy, terrain, flags and the published heights to a state with rise and drop."""
    stale_ns = round(s.stale_s * 1e9)
    sigma = F.sqrt(F.col("variance").cast("double"))
    ok = sigma <= d(s.valid_sigma_m)
    stale = now - F.col("last_seen") > stale_ns
    occupied = (F.col("last_hit") == now) | (F.col("log_odds").cast("double") >= d(float(s.occupied_at)))
    free = (F.col("last_free") >= 0) & (now - F.col("last_free") <= stale_ns) & (F.col("last_free") > F.col("last_hit")) & (F.col("log_odds").cast("double") <= d(s.free_at))
    state = state.withColumns({"semantic": dominant(F.col("classes")), "ground_valid": ok, "occupied": occupied, "stale": stale})
    clear = F.col("low").cast("double") - F.col("height").cast("double")
    blocking = F.col("occupied") & (~F.col("ground_valid") | (clear < s.clearance_m))
    over = F.col("occupied") & F.col("ground_valid") & (clear >= s.clearance_m)
    curb, fall = (F.col("ground_valid") & (F.col(c) > s.step_limit_m) for c in ("rise", "drop"))
    road = F.col("semantic").isin(*s.drivable)
    kind = (
        F.when(F.col("stale"), T_STALE)
        .when(blocking, T_OBSTACLE)
        .when(F.col("ground_valid") & road & ~curb & ~fall, T_DRIVABLE)
        .when(curb | fall, T_NOT)
        .when(F.col("ground_valid") & (F.col("semantic") != 0) & ~road, T_NOT)
        .otherwise(T_UNKNOWN)
    )
    return state.withColumns(
        {
            "occupancy": F.when(F.col("stale"), 3).when(F.col("occupied"), 1).when(free, 2).otherwise(0),
            "terrain": kind,
            "flags": curb.cast("int") * CURB + fall.cast("int") * DROP + over.cast("int") * OVERHANG,
            "ground_height_m": F.when(F.col("ground_valid"), F.col("height").cast("double")).otherwise(d(0)),
            "ground_sigma_m": F.when(sigma < float("inf"), sigma).otherwise(d(-1)),
        }
    )


def summary(view: DataFrame) -> DataFrame:
    """Counts of a published view by terrain, occupancy and flag."""
    n = lambda c: F.count_if(c)
    return view.groupBy("sequence").agg(
        F.count("*").alias("published_cells"),
        *[n(F.col("terrain") == k).alias(f"terrain_{k}") for k in range(5)],
        *[n(F.col("occupancy") == k).alias(f"occupancy_{k}") for k in range(4)],
        *[n(F.col("flags").bitwiseAND(F.lit(bit)) > 0).alias(name) for bit, name in ((CURB, "curb_cells"), (DROP, "drop_cells"), (OVERHANG, "overhang_cells"))],
    )
