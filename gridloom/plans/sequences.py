"""Queries of sequence operators: poses, motion, gaps, flicker, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.config import Fusion, Grid
from gridloom.functions import lattice
from gridloom.functions.lattice import d
from gridloom.operators import cells, contracts, fusion, gates, sequence
from gridloom.plans import duck
from gridloom.plans.duck import num
from gridloom.plans.views import view, view_sql
from gridloom.streaming import replay

GRID, FUSION = Grid(), Fusion()
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SPEED = f"""SELECT sequence, frame_id, coalesce(sqrt(dx*dx + dy*dy) / dt, 0) AS speed, dx, dy, dt, sqrt(dx*dx + dy*dy) AS len FROM (SELECT *,
  px - lag(px) OVER w AS dx, py - lag(py) OVER w AS dy, CAST(ts_ns - lag(ts_ns) OVER w AS DOUBLE) / 1e9 AS dt FROM ({view_sql('poses')}) WINDOW w AS (PARTITION BY sequence ORDER BY frame_id))"""


@query(f"""SELECT sequence, frame_id, round(speed, 6) AS speed, round(CASE WHEN speed >= 0.5 THEN dx / len ELSE 1 END, 6) AS hx, round(CASE WHEN speed >= 0.5 THEN dy / len ELSE 0 END, 6) AS hy,
  round(CASE WHEN speed >= 0.5 THEN 1 + least(speed / 10, 1) ELSE 1 END, 6) AS stretch, CASE WHEN dt IS NULL THEN 'first-pose' WHEN speed >= 0.5 THEN 'moving' ELSE 'below-heading-threshold' END AS reason FROM ({_SPEED})""")
def pose_speed(spark, sf_dir):
    out = sequence.pose_speed(view(spark, sf_dir, "poses"))
    return out.select("sequence", "frame_id", *(F.round(c, 6).alias(c) for c in ("speed", "hx", "hy", "stretch")), "reason")


@query(f"SELECT sequence, gap, count(*) AS frames FROM (SELECT sequence, coalesce(frame_id - lag(frame_id) OVER (PARTITION BY sequence ORDER BY frame_id) - 1, 0) AS gap FROM ({view_sql('poses')})) GROUP BY sequence, gap")
def frame_gaps(spark, sf_dir):
    return sequence.frame_gaps(view(spark, sf_dir, "poses")).groupBy("sequence", "gap").agg(F.count("*").alias("frames"))


_ARRIVED = f"SELECT sequence, frame_id, ts_ns, CAST(frame_id + CASE WHEN frame_id % 10 = 3 THEN 5 ELSE 0 END AS BIGINT) * 2 + frame_id % 2 AS arrival FROM ({view_sql('poses')})"


@query(f"""SELECT sequence, frame_id, prev_frame FROM (SELECT *, lag(frame_id) OVER w AS prev_frame, lag(ts_ns) OVER w AS prev_ts FROM ({_ARRIVED}) WINDOW w AS (PARTITION BY sequence ORDER BY arrival))
  WHERE frame_id <= prev_frame OR ts_ns <= prev_ts""")
def order_violations(spark, sf_dir):
    f = view(spark, sf_dir, "poses")
    f = f.withColumn("arrival", (F.col("frame_id") + F.when(F.col("frame_id") % 10 == 3, 5).otherwise(0)) * 2 + F.col("frame_id") % 2)
    return sequence.order_violations(f).select("sequence", "frame_id", "prev_frame")


# A track's frames are the user's events in order, so that most follow each other.
_OBS = f"SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY event_id) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS f FROM ({view_sql('observations')})"
_OBS = f"SELECT track_id, event_id, px / (1 + event_id % 4 * 20) AS px, py / (1 + event_id % 4 * 20) AS py, pz, CAST(sum(1 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY event_id) AS BIGINT) AS frame_id FROM ({view_sql('observations')})"


def _observations(spark, sf_dir):
    from pyspark.sql import Window

    o = view(spark, sf_dir, "observations").drop("frame_id")
    scale = F.lit(1) + F.col("event_id") % 4 * 20
    step = F.sum(F.lit(1) + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).over(Window.partitionBy("track_id").orderBy("event_id"))
    o = o.withColumns({"px": F.col("px") / scale, "py": F.col("py") / scale, "frame_id": step})
    return o.withColumn("ts_ns", F.col("frame_id") * 150000000)


@query(f"""WITH o AS (SELECT *, frame_id * 150000000 AS ts_ns FROM ({_OBS})), g AS (SELECT *, coalesce(frame_id - lag(frame_id) OVER w <= 1, false) AS g1, coalesce(lag(frame_id) OVER w - lag(frame_id, 2) OVER w <= 1, false) AS g2,
  lag(ts_ns, 2) OVER w AS t2, lag(ts_ns) OVER w AS t1, lag(px, 2) OVER w AS x2, lag(py, 2) OVER w AS y2 FROM o WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
s AS (SELECT *, CASE WHEN g1 AND g2 THEN 3 WHEN g1 THEN 2 ELSE 1 END AS n, CAST(ts_ns - CASE WHEN g1 AND g2 THEN t2 WHEN g1 THEN t1 ELSE ts_ns END AS DOUBLE) / 1e9 AS span FROM g),
v AS (SELECT *, CASE WHEN n = 3 AND span >= {num(0.2)} THEN sqrt((px - x2) / span * ((px - x2) / span) + (py - y2) / span * ((py - y2) / span)) END AS speed FROM s)
SELECT track_id, frame_id, CAST(n AS INTEGER) AS observations, round(span, 6) AS span_s, coalesce(round(speed, 6), -1) AS speed, CAST(CASE WHEN speed > {num(0.8)} THEN 2 WHEN speed < {num(0.2)} THEN 1 ELSE 0 END AS INTEGER) AS state,
  CASE WHEN speed IS NULL THEN 'insufficient-history' WHEN speed > {num(0.8)} OR speed < {num(0.2)} THEN 'estimated' ELSE 'threshold-band' END AS reason FROM v""")
def motion_state(spark, sf_dir):
    out = sequence.motion_state(_observations(spark, sf_dir))
    return out.select("track_id", "frame_id", "observations", F.round("span_s", 6).alias("span_s"), F.coalesce(F.round("speed", 6), d(-1)).alias("speed"), "state", "reason")


_STATES = f"SELECT frame_id, level, ix, iy, max(ground) AS state FROM ({duck.keyed(view_sql('dense_points'), GRID)}) GROUP BY frame_id, level, ix, iy"


@query(f"""WITH s AS MATERIALIZED ({_STATES}) SELECT a.frame_id, count(*) AS common, count(*) FILTER (WHERE a.state <> b.state) AS changed
  FROM s a JOIN s b ON a.frame_id = b.frame_id + 1 AND a.level = b.level AND a.ix = b.ix AND a.iy = b.iy GROUP BY a.frame_id""")
def cell_flicker(spark, sf_dir):
    k = cells.keyed(view(spark, sf_dir, "dense_points"), GRID).groupBy("frame_id", "level", "ix", "iy").agg(F.max("ground").alias("state"))
    return sequence.flicker(k, "state")


_HEADING, _STRETCH = (0.6, 0.8), 1.7


def _ahead_sql(k: int) -> str:
    """Whether the level-k block of base cell (ux, uy) meets the forward half-ellipse: the least of its four edges' minima, each edge clipped to what lies ahead."""
    w, (hx, hy) = GRID.widths_m[k], map(num, _HEADING)
    scale = f"(1 / ({num(_STRETCH)} * {num(_STRETCH)}) - 1)"
    ax, ay, c = f"(1 + {scale} * {hx} * {hx})", f"(1 + {scale} * {hy} * {hy})", f"({scale} * {hx} * {hy})"
    x0, y0 = (f"({duck.div(u, GRID.ratios[k])} * {num(w)} - {s})" for u, s in (("ux", "sx"), ("uy", "sy")))
    x1, y1 = f"({x0} + {num(w)})", f"({y0} + {num(w)})"
    edges = [(x, y0, y1, hx, hy, ax, ay) for x in (x0, x1)] + [(y, x0, x1, hy, hx, ay, ax) for y in (y0, y1)]
    listed = ", ".join("{'f': %s, 'l': greatest(%s, -%s * %s / %s), 'h': %s, 'a': %s, 'b': %s}" % (f, lo, hf, f, hr, hi, af, ar) for f, lo, hi, hf, hr, af, ar in edges)
    at = f"least(greatest(-{c} * e.f / e.b, e.l), e.h)"
    least = f"list_min(list_transform([{listed}], lambda e: CASE WHEN e.l <= e.h THEN e.a * e.f * e.f + 2 * {c} * e.f * {at} + e.b * {at} * {at} ELSE CAST('Infinity' AS DOUBLE) END))"
    return f"(CASE WHEN {x0} <= 0 AND {x1} >= 0 AND {y0} <= 0 AND {y1} >= 0 THEN 0 ELSE sqrt(greatest({least}, 0)) END < {num(GRID.radii_m[k - 1])})"


@query(f"""SELECT frame_id, CAST(CASE WHEN NOT n2 THEN 2 WHEN NOT n1 THEN 1 ELSE 0 END AS INTEGER) AS level, count(*) AS points FROM (
  SELECT *, {', '.join(f"{duck.near('ux', 'uy', k, GRID)} OR {_ahead_sql(k)} AS n{k}" for k in (1, 2))} FROM (SELECT *, {duck.base('mx')} AS ux, {duck.base('my')} AS uy FROM ({view_sql('wide_points')}))) GROUP BY ALL""")
def foveated_levels(spark, sf_dir):
    """Points per level when blocks ahead of a moving sensor are refined further."""
    p = view(spark, sf_dir, "wide_points")
    out = cells.keyed(p, GRID, (*map(d, _HEADING), d(_STRETCH)))
    return out.groupBy("frame_id", "level").agg(F.count("*").alias("points"))


# Fixed values of the fixture: quarter and 3-4-5 turns; where the sensor sits on the camera.
_TURNS, _MOUNT = ((1.0, 0.0), (0.6, 0.8), (0.0, 1.0), (0.8, -0.6)), (0.27, -0.08, -0.12)
_TURN_SQL = f"""SELECT sequence, frame_id, c, s, px + c * {num(_MOUNT[0])} - s * {num(_MOUNT[1])} AS x, py + s * {num(_MOUNT[0])} + c * {num(_MOUNT[1])} AS y FROM (
  SELECT *, {', '.join(f"list_extract([{', '.join(num(v[i]) for v in _TURNS)}], frame_id % 4 + 1) AS {n}" for i, n in ((0, 'c'), (1, 's')))} FROM ({view_sql('poses')}))"""


def _poses(spark, sf_dir):
    p = view(spark, sf_dir, "poses")
    c, s = (F.element_at(F.array(*[d(v[i]) for v in _TURNS]), (F.col("frame_id") % 4 + 1).cast("int")) for i in (0, 1))
    return p.withColumn("pose", F.array(c, -s, d(0), F.col("px"), s, c, d(0), F.col("py"), d(0), d(0), d(1), d(0.5), d(0), d(0), d(0), d(1)))


@query(f"""WITH p AS ({_TURN_SQL}), o AS (SELECT *, first(c) OVER w AS c0, first(s) OVER w AS s0, first(x) OVER w AS x0, first(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY sequence ORDER BY frame_id))
SELECT sequence, frame_id, round(c0 * c + s0 * s, 6) + 0.0 AS cosine, round(c0 * (x - x0) + s0 * (y - y0), 6) + 0.0 AS x, round(c0 * (y - y0) - s0 * (x - x0), 6) + 0.0 AS y FROM o""")
def sensor_poses(spark, sf_dir):
    """Sensor poses in the first frame's sensor coordinates, from camera poses and the calibration."""
    cal = [1, 0, 0, _MOUNT[0], 0, 1, 0, _MOUNT[1], 0, 0, 1, _MOUNT[2]]
    out = sequence.camera_to_map(_poses(spark, sf_dir), cal)
    return out.select("sequence", "frame_id", *[(F.round(F.element_at("pose", i), 6) + 0.0).alias(n) for n, i in (("cosine", 1), ("x", 4), ("y", 8))])


@query(f"""SELECT sequence, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS rejected FROM (
  SELECT sequence, frame_id % 7 <> 2 AND frame_id % 11 <> 3 AND frame_id % 13 <> 5 AND frame_id % 17 <> 6 AS ok FROM ({view_sql('poses')})) GROUP BY sequence""")
def pose_validity(spark, sf_dir):
    """Poses that are rigid and those that are not: stretched, mirrored, of a wrong bottom row, or too short."""
    f = F.col("frame_id")
    swap = lambda at, value: lambda x, i: F.when(i == at, value(x)).otherwise(x)
    pose = F.col("pose")
    for when, change in (
        (f % 7 == 2, F.transform(pose, lambda x, i: F.when(i < 12, x * 1.01).otherwise(x))),
        (f % 11 == 3, F.transform(pose, swap(10, lambda x: -x))),
        (f % 13 == 5, F.transform(pose, swap(15, lambda x: x + 0.5))),
        (f % 17 == 6, F.slice(pose, 1, 12)),
    ):
        pose = F.when(when, change).otherwise(pose)
    ok = gates.pose_is_valid(pose)
    return _poses(spark, sf_dir).groupBy("sequence").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"))


@query(f"""SELECT sequence, frame_id, (row_number() OVER (PARTITION BY sequence ORDER BY frame_id) - 1) % 5 = 0 AS deep FROM ({view_sql('poses')}) WHERE frame_id % 3 <> 1""")
def audit_schedule(spark, sf_dir):
    """Which accepted frames get the deep audit: every fifth of a sequence."""
    f = view(spark, sf_dir, "poses").withColumn("status", F.when(F.col("frame_id") % 3 == 1, "rejected").otherwise("accepted"))
    return contracts.audited(f, 5).select("sequence", "frame_id", "deep")


@query("SELECT strftime(start, '%Y-%m-%d %H') AS start, strftime(start + INTERVAL 1 HOUR, '%Y-%m-%d %H') AS stop, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY ALL)")
def event_windows(spark, sf_dir):
    """Events by hour and type."""
    out = replay.event_windows(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round(F.col("total") + 1e-9, 4))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH") for c in ("start", "stop")})


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS stop, count(*) AS n FROM s GROUP BY user_id, nth""")
def event_sessions(spark, sf_dir):
    """Each user's sessions, ended by half an hour without events."""
    out = replay.event_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "stop")})


# ---------------------------------------------------------------- fusion


_IN_WINDOW = " UNION ALL ".join(
    f"SELECT frame_id, {k} AS level, {duck.div('ux', r)} AS ix, {duck.div('uy', r)} AS iy, {duck.div('cx', r)} AS wx, {duck.div('cy', r)} AS wy, {fusion.half_window(radius, w)} AS half, mz, ground, semantic FROM p"
    for k, (r, w, radius) in enumerate(zip(GRID.ratios, GRID.widths_m, GRID.radii_m))
)


@query(f"""WITH p AS MATERIALIZED (SELECT *, {duck.base('mx')} AS ux, {duck.base('my')} AS uy, {duck.base('sx')} AS cx, {duck.base('sy')} AS cy FROM ({view_sql('wide_points')}) WHERE motion <> 2), r AS (SELECT * FROM ({_IN_WINDOW}) WHERE abs(ix - wx) <= half AND abs(iy - wy) <= half)
SELECT frame_id, level, ix, iy, count(*) AS n, count(*) FILTER (WHERE ground = 1) AS n_ground, count(*) FILTER (WHERE ground = 2) AS n_obstacle, coalesce(min(mz) FILTER (WHERE ground = 2), -99) AS low, coalesce(max(mz) FILTER (WHERE ground = 2), -99) AS high,
  round(coalesce(avg(mz) FILTER (WHERE ground = 1), 0) + 1e-11, 7) AS mean_z, count(*) FILTER (WHERE semantic = 9) AS road FROM r GROUP BY frame_id, level, ix, iy""")
def scan_evidence(spark, sf_dir):
    """Each scan's evidence in the window's cells of every level, without moving points."""
    p = view(spark, sf_dir, "wide_points").where("motion <> 2").withColumns({"sequence": F.lit(0), "ts_ns": F.col("frame_id") * 100_000_000})
    out = fusion.scan_cells(p, GRID)
    return out.select("frame_id", "level", "ix", "iy", "n", "n_ground", "n_obstacle", *[F.coalesce(c, d(-99)).alias(c) for c in ("low", "high")], F.round(F.col("mean_z") + 1e-11, 7).alias("mean_z"), F.element_at("classes", 10).alias("road"))


_EVERY = " UNION ALL ".join(f"SELECT DISTINCT {k} AS level, {duck.div('ux', r)} AS ix, {duck.div('uy', r)} AS iy, {duck.div('ux', r)} * {r} AS ux, {duck.div('uy', r)} * {r} AS uy, sx, sy FROM p" for k, r in enumerate(GRID.ratios))


@query(f"""WITH p AS MATERIALIZED (SELECT *, {duck.base('mx')} AS ux, {duck.base('my')} AS uy FROM ({view_sql('wide_points')})) SELECT level, ix, iy FROM (SELECT *, {duck.level('ux', 'uy', GRID)} AS own FROM ({_EVERY})) WHERE own = level""")
def owned_cells(spark, sf_dir):
    """Of the cells of all levels that hold a point, those that the lattice assigns to their own level."""
    p = view(spark, sf_dir, "wide_points").select(lattice.base_index(F.col("mx")).alias("bx"), lattice.base_index(F.col("my")).alias("by"), "sx", "sy")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), lattice.floor_div(F.col("bx"), r).alias("ix"), lattice.floor_div(F.col("by"), r).alias("iy")) for k, r in enumerate(GRID.ratios)]))
    every = p.select(each.alias("c"), "sx", "sy").select("c.*", "sx", "sy").distinct()
    return fusion.owned(every, GRID).select("level", "ix", "iy")


_ROUTE = f"SELECT sequence, frame_id, frame_id % 3 AS level, {duck.base('px')} AS cx, {duck.base('py')} AS cy, o % 10 AS lane FROM (SELECT *, CAST(px * 10 AS BIGINT) + frame_id AS o FROM ({view_sql('poses')}))"


@query(f"""WITH r AS MATERIALIZED ({_ROUTE}), s AS (SELECT sequence, frame_id, level, lane * 40 AS ix, lane - 5 AS iy, lag(frame_id) OVER (PARTITION BY sequence, level, lane ORDER BY frame_id) AS prev FROM r),
c AS (SELECT DISTINCT sequence, frame_id, {', '.join(f"{duck.div('cx', r)} AS x{k}, {duck.div('cy', r)} AS y{k}" for k, r in enumerate(GRID.ratios))} FROM r)
SELECT s.sequence, s.frame_id, s.level, s.ix, s.iy, coalesce(bool_or(CASE s.level {' '.join(f"WHEN {k} THEN abs(s.ix - x{k}) > {fusion.half_window(radius, w)} OR abs(s.iy - y{k}) > {fusion.half_window(radius, w)}" for k, (w, radius) in enumerate(zip(GRID.widths_m, GRID.radii_m)))} END), false) AS restart
FROM s LEFT JOIN c ON c.sequence = s.sequence AND c.frame_id > s.prev AND c.frame_id < s.frame_id GROUP BY ALL""")
def window_restarts(spark, sf_dir):
    """Which scans of a cell begin anew, as the cell left the moving window since its scan before."""
    p = view(spark, sf_dir, "poses")
    lane = ((F.col("px") * 10).cast("long") + F.col("frame_id")) % 10
    s = p.select("sequence", "frame_id", (F.col("frame_id") % 3).cast("int").alias("level"), (lane * 40).alias("ix"), (lane - 5).alias("iy"))
    centres = p.select("sequence", "frame_id", lattice.base_index(F.col("px")).alias("cx"), lattice.base_index(F.col("py")).alias("cy"))
    return fusion.mark_restarts(s, centres, GRID).select("sequence", "frame_id", "level", "ix", "iy", "restart")


def _scans(spark, sf_dir):
    s = view(spark, sf_dir, "cell_scans")
    return s.select(
        "cell_id", "ts_ns", (F.col("n_ground") + F.col("n_obstacle")).alias("n"), "n_ground", "n_obstacle", d(0.4).alias("low"), d(1.2).alias("high"), "mean_z", "spread",
        F.array(*[((F.col("event_id") % 19 == k) | (F.col("event_id") % 7 == k)).cast("long") for k in range(20)]).alias("classes"), "is_free", F.lit(False).alias("restart"),
    )


_FOLD = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, n_ground + n_obstacle AS n, row_number() OVER (PARTITION BY cell_id ORDER BY ts_ns) AS k FROM ({view_sql('cell_scans')})),
r(cell_id, k, lo, h, v, hns, hit_ns, free_ns, seen_ns, obs) AS (
  SELECT DISTINCT cell_id, CAST(0 AS BIGINT), CAST(0 AS FLOAT), CAST(0 AS FLOAT), CAST('Infinity' AS FLOAT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), 0 FROM e
  UNION ALL SELECT cell_id, k,
    greatest(least(CASE WHEN is_free THEN CAST(l1 - CAST(0.4 AS FLOAT) AS FLOAT) ELSE l1 END, CAST(3.5 AS FLOAT)), CAST(-2 AS FLOAT)),
    CASE WHEN n_ground > 0 THEN CAST(CASE WHEN again THEN mean_z ELSE hd + gain * (mean_z - hd) END AS FLOAT) ELSE h END,
    CASE WHEN n_ground > 0 THEN CAST(CASE WHEN again THEN noise ELSE (1 - gain) * safe END AS FLOAT) ELSE v END,
    CASE WHEN n_ground > 0 THEN ts_ns ELSE hns END, CASE WHEN n_obstacle > 0 THEN ts_ns ELSE hit_ns END, CASE WHEN is_free THEN ts_ns ELSE free_ns END,
    CASE WHEN n > 0 OR is_free THEN ts_ns ELSE seen_ns END, obs + CASE WHEN n > 0 THEN 1 ELSE 0 END
  FROM (SELECT *, safe / (safe + noise) AS gain FROM (SELECT *, CASE WHEN again THEN {num(0.0)} ELSE prior END AS safe FROM (SELECT *, (prior = CAST('Infinity' AS DOUBLE) OR abs(mean_z - hd) > {num(0.5)}) AS again FROM (
    SELECT e.*, r.h, r.v, r.hns, r.hit_ns, r.free_ns, r.seen_ns, r.obs, CAST(r.h AS DOUBLE) AS hd,
      CAST(r.v AS DOUBLE) + {num(0.0025)} * CASE WHEN r.hns >= 0 THEN CAST(e.ts_ns - r.hns AS DOUBLE) / 1e9 ELSE 0 END AS prior,
      greatest(e.spread, {num(0.03**2)}) / greatest(e.n_ground, 1) AS noise,
      CASE WHEN e.n_obstacle > 0 THEN CAST(r.lo + CAST(0.85 AS FLOAT) AS FLOAT) WHEN e.n_ground > 0 THEN CAST(r.lo - CAST(0.2 AS FLOAT) AS FLOAT) ELSE r.lo END AS l1
    FROM r JOIN e ON r.cell_id = e.cell_id AND e.k = r.k + 1)))))
SELECT cell_id, round(CAST(lo AS DOUBLE), 5) + 0.0 AS log_odds, round(CAST(h AS DOUBLE), 5) + 0.0 AS height, round(CAST(v AS DOUBLE), 7) AS variance, hns AS height_ns, hit_ns AS last_hit, free_ns AS last_free, seen_ns AS last_seen, obs AS observations
FROM r WHERE k = (SELECT max(k) FROM e WHERE e.cell_id = r.cell_id)"""


@query(_FOLD)
def fusion_fold(spark, sf_dir):
    """Log-odds and Kalman height of each cell after its last scan."""
    f = fusion.fold(_scans(spark, sf_dir), FUSION, ("cell_id",))
    return f.select("cell_id", (F.round(F.col("log_odds").cast("double"), 5) + 0.0).alias("log_odds"), (F.round(F.col("height").cast("double"), 5) + 0.0).alias("height"), F.round(F.col("variance").cast("double"), 7).alias("variance"), "height_ns", "last_hit", "last_free", "last_seen", "observations")


_EVIDENCE = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT cell_id, event_id, n_ground + n_obstacle AS n, row_number() OVER (PARTITION BY cell_id ORDER BY ts_ns) AS k FROM ({view_sql('cell_scans')}) WHERE n_ground + n_obstacle > 0),
r(cell_id, k, c) AS (SELECT DISTINCT cell_id, CAST(0 AS BIGINT), [0 for x in range(20)] FROM e UNION ALL
  SELECT e.cell_id, e.k, list_transform(range(20), lambda i: least(CAST(round_even(CAST(CAST(r.c[i + 1] AS FLOAT) * CAST(0.8 AS FLOAT) AS FLOAT) + CAST((CASE WHEN e.event_id % 19 = i OR e.event_id % 7 = i THEN 1 ELSE 0 END) * CAST(CAST(50 AS FLOAT) / CAST(e.n AS FLOAT) AS FLOAT) AS FLOAT), 0) AS INTEGER), 255)) FROM r JOIN e ON e.cell_id = r.cell_id AND e.k = r.k + 1)
SELECT cell_id, array_to_string(c, ',') AS classes, CAST(CASE WHEN list_max(c[2:20]) > 0 THEN list_position(c[2:20], list_max(c[2:20])) ELSE 0 END AS INTEGER) AS semantic FROM r WHERE k = (SELECT max(k) FROM e WHERE e.cell_id = r.cell_id)"""


@query(_EVIDENCE)
def fusion_evidence(spark, sf_dir):
    """Decayed class evidence of each cell and the class it shows."""
    f = fusion.fold(_scans(spark, sf_dir).where("n > 0"), FUSION, ("cell_id",))
    return f.select("cell_id", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"), fusion.dominant(F.col("classes")).alias("semantic"))


def _state(spark, sf_dir):
    """A synthetic fused state: the dense points of all frames, cell by cell."""
    k = cells.keyed(view(spark, sf_dir, "dense_points"), GRID)
    return k.groupBy(F.lit(0).alias("sequence"), "level", "ix", "iy").agg(
        F.rint(F.avg("mz") * 100).cast("long").alias("cm"), F.count("*").alias("n"), F.max("semantic").alias("top"), F.count_if(F.col("ground") == 2).alias("n_o"), F.max("frame_id").alias("last")
    )


_STATE = f"SELECT level, ix, iy, CAST(round_even(avg(mz) * 100, 0) AS BIGINT) AS cm, count(*) AS n, max(semantic) AS top, count(*) FILTER (WHERE ground = 2) AS n_o, max(frame_id) AS last FROM ({duck.keyed(view_sql('dense_points'), GRID)}) GROUP BY level, ix, iy"
_TRUST = "(n % 3 <> 0)"


@query(f"""WITH s AS MATERIALIZED ({_STATE}) SELECT level, ix, iy, round(greatest(coalesce(max(o), h) - h, 0), 4) AS rise, round(greatest(h - coalesce(min(o), h), 0), 4) AS dropped FROM (
  SELECT a.level, a.ix, a.iy, CAST(CAST(CAST(a.cm AS DOUBLE) / 100 AS FLOAT) AS DOUBLE) AS h, CAST(CAST(CAST(b.cm AS DOUBLE) / 100 AS FLOAT) AS DOUBLE) AS o FROM s a LEFT JOIN s b ON b.level = a.level AND (b.n % 3 <> 0) AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1) GROUP BY level, ix, iy, h""")
def neighbour_steps(spark, sf_dir):
    s = _state(spark, sf_dir).withColumns({"height": (F.col("cm").cast("double") / 100).cast("float"), "variance": F.when(F.col("n") % 3 != 0, 0.001).otherwise(0.5).cast("float")})
    out = fusion.steps(s, FUSION)
    return out.select("level", "ix", "iy", F.round("rise", 4).alias("rise"), F.round("drop", 4).alias("dropped"))


_TERRAIN_ALL = f"""WITH s AS MATERIALIZED ({_STATE}), n AS (SELECT a.*, CAST(CAST(CAST(a.cm AS DOUBLE) / 100 AS FLOAT) AS DOUBLE) AS h, max(CAST(CAST(CAST(b.cm AS DOUBLE) / 100 AS FLOAT) AS DOUBLE)) AS hi, min(CAST(CAST(CAST(b.cm AS DOUBLE) / 100 AS FLOAT) AS DOUBLE)) AS lo
  FROM s a LEFT JOIN s b ON b.level = a.level AND {_TRUST.replace('n %', 'b.n %')} AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 GROUP BY ALL),
t AS (SELECT *, n % 3 <> 0 AS ok, last < 5 AS stale, last_hit = 7 OR lodds >= {num(0.85)} AS occ, (n % 3 <> 0) AND greatest(coalesce(hi - h, 0), 0) > {num(0.1)} AS curb, (n % 3 <> 0) AND greatest(coalesce(h - lo, 0), 0) > {num(0.1)} AS fall,
  CASE WHEN n % 2 = 0 THEN {num(1.5)} ELSE {num(0.0)} END - h AS clear FROM (SELECT *, CASE WHEN n_o > 6 THEN last ELSE -1 END AS last_hit, CASE WHEN n_o > 9 THEN 1.0 ELSE -1.0 END AS lodds FROM n))
SELECT ok, stale, h, top, level, ix, iy, CAST(CASE WHEN stale THEN 4 WHEN occ AND (NOT ok OR clear < 2) THEN 3 WHEN ok AND top IN (9, 10) AND NOT curb AND NOT fall THEN 1 WHEN curb OR fall THEN 2 WHEN ok AND top NOT IN (0, 9, 10) THEN 2 ELSE 0 END AS INTEGER) AS terrain,
  CAST(CASE WHEN stale THEN 3 WHEN occ THEN 1 WHEN n % 5 = 0 AND last >= 5 AND last > last_hit AND lodds <= {num(-0.8)} THEN 2 ELSE 0 END AS INTEGER) AS occupancy,
  CAST(CASE WHEN curb THEN 1 ELSE 0 END + CASE WHEN fall THEN 2 ELSE 0 END + CASE WHEN occ AND ok AND clear >= 2 THEN 4 ELSE 0 END AS INTEGER) AS flags FROM t"""
_TERRAIN = f"SELECT level, ix, iy, terrain, occupancy, flags FROM ({_TERRAIN_ALL})"


def _terrain(spark, sf_dir):
    s = _state(spark, sf_dir)
    second = 1_000_000_000
    s = s.withColumns(
        {
            "height": (F.col("cm").cast("double") / 100).cast("float"),
            "variance": F.when(F.col("n") % 3 != 0, 0.001).otherwise(0.5).cast("float"),
            "last_seen": F.col("last") * second,
            "last_hit": F.when(F.col("n_o") > 6, F.col("last") * second).otherwise(-1),
            "last_free": F.when(F.col("n") % 5 == 0, F.col("last") * second).otherwise(-1),
            "log_odds": F.when(F.col("n_o") > 9, 1.0).otherwise(-1.0).cast("float"),
            "low": F.when(F.col("n") % 2 == 0, 1.5).otherwise(0.0).cast("float"),
            "classes": F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (i == F.col("top")).cast("int")),
        }
    )
    return fusion.terrain(fusion.steps(s, FUSION), F.lit(7 * second), FUSION)


@query(_TERRAIN)
def terrain_view(spark, sf_dir):
    return _terrain(spark, sf_dir).select("level", "ix", "iy", "terrain", "occupancy", "flags")


@query(f"""SELECT count(*) AS published_cells, {', '.join(f'count(*) FILTER (WHERE terrain = {k}) AS terrain_{k}' for k in range(5))}, {', '.join(f'count(*) FILTER (WHERE occupancy = {k}) AS occupancy_{k}' for k in range(4))},
  count(*) FILTER (WHERE flags & 1 > 0) AS curb_cells, count(*) FILTER (WHERE flags & 2 > 0) AS drop_cells, count(*) FILTER (WHERE flags & 4 > 0) AS overhang_cells FROM ({_TERRAIN})""")
def fused_summary(spark, sf_dir):
    return fusion.summary(_terrain(spark, sf_dir)).drop("sequence")
