"""Queries of evaluation, data-quality and tracking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.config import FreeSpace, Fusion, Grid
from gridloom.functions.labels import CLASS_OF_RAW
from gridloom.functions.lattice import d, floor_div, pick
from gridloom.operators import cells, contracts, freespace, metrics, tracks
from gridloom.plans import duck
from gridloom.plans.duck import num
from gridloom.plans.freespace import _FREE_SQL, scan
from gridloom.plans.mapping import _snapshot_sql
from gridloom.plans.sequences import _TERRAIN, _TERRAIN_ALL, _terrain
from gridloom.plans.views import view, view_sql

GRID, FREE, FUSION = Grid(), FreeSpace(), Fusion()
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BAND = "CASE WHEN range_m < 20 THEN '0-20m' WHEN range_m < 50 THEN '20-50m' ELSE '50m+' END"
_CONF = f"SELECT coalesce(band, 'all') AS band, pred, truth, count(*) AS n FROM (SELECT *, {_BAND} AS band FROM ({view_sql('predictions')})) GROUP BY GROUPING SETS ((band, pred, truth), (pred, truth))"


@query(_CONF)
def confusion_by_band(spark, sf_dir):
    return metrics.confusion(view(spark, sf_dir, "predictions"))


_IOU = f"""SELECT band, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n) - sum(tp) AS BIGINT) AS "union" FROM (
  SELECT band, pred AS cls, 0 AS tp, n FROM c WHERE truth <> 0 UNION ALL SELECT band, truth, CASE WHEN pred = truth THEN n ELSE 0 END, n FROM c WHERE truth <> 0) WHERE cls > 0 GROUP BY band, cls"""


@query(f"""WITH c AS ({_CONF}) SELECT band, cls, tp, "union", round(tp / CAST("union" AS DOUBLE), 9) AS iou FROM ({_IOU})""")
def class_iou(spark, sf_dir):
    return metrics.class_iou(metrics.confusion(view(spark, sf_dir, "predictions"))).withColumn("iou", F.round("iou", 9))


@query(f"""WITH c AS ({_CONF}), i AS (SELECT band, sum(tp / CAST("union" AS DOUBLE)) / 19 AS miou FROM ({_IOU}) GROUP BY band)
SELECT c.band, CAST(sum(n) AS BIGINT) AS points, CAST(sum(CASE WHEN truth <> 0 THEN n ELSE 0 END) AS BIGINT) AS labeled_points, CAST(sum(CASE WHEN pred = 0 THEN n ELSE 0 END) AS BIGINT) AS unknown_predictions,
 round(sum(CASE WHEN pred = 0 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS unknown_coverage, round(any_value(miou), 9) AS miou_19,
 round(sum(CASE WHEN truth <> 0 AND truth = pred THEN n ELSE 0 END) / CAST(sum(CASE WHEN truth <> 0 THEN n ELSE 0 END) AS DOUBLE), 9) AS accuracy FROM c JOIN i ON c.band = i.band GROUP BY c.band""")
def miou(spark, sf_dir):
    out = metrics.semantic_metrics(metrics.confusion(view(spark, sf_dir, "predictions")))
    return out.withColumns({c: F.round(c, 9) for c in ("unknown_coverage", "miou_19", "accuracy")})


_SEG = """SELECT event_id % 8 AS frame_id, CAST(1 + (event_id - event_id % 8) / 8 % 3 AS INTEGER) AS label, CAST((event_id - event_id % 64) / 64 % 40 + 1 AS BIGINT) AS gt,
  CAST(CASE WHEN user_id % 4 = 0 THEN 0 WHEN (event_id - event_id % 64) / 64 % 40 % 3 = 2 AND user_id % 4 > 1 THEN 77 ELSE (event_id - event_id % 64) / 64 % 40 + 1 + event_id % 8 / 4 * 100 END AS BIGINT) AS pred FROM events"""
_SEG = _SEG.replace("(event_id - event_id % 8) / 8", "((event_id - event_id % 8) // 8)").replace("(event_id - event_id % 64) / 64", "((event_id - event_id % 64) // 64)").replace("event_id % 8 / 4", "(event_id % 8 // 4)")


def _segments(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    block = F.expr("(event_id - event_id % 64) div 64 % 40")
    pred = F.when(F.col("user_id") % 4 == 0, 0).when((block % 3 == 2) & (F.col("user_id") % 4 > 1), 77).otherwise(block + 1 + F.expr("event_id % 8 div 4") * 100)
    return e.select((F.col("event_id") % 8).alias("frame_id"), F.expr("cast(1 + (event_id - event_id % 8) div 8 % 3 as int)").alias("label"), (block + 1).alias("gt"), pred.cast("long").alias("pred"))


_MATCH = """t AS (SELECT frame_id, label, gt, count(*) AS n_gt FROM s GROUP BY ALL), p AS (SELECT frame_id, label, pred, count(*) AS n_pred FROM s WHERE pred > 0 GROUP BY ALL),
m AS (SELECT frame_id, label, gt, pred, n / CAST(n_gt + n_pred - n AS DOUBLE) AS iou FROM (SELECT frame_id, label, gt, pred, count(*) AS n FROM s WHERE pred > 0 GROUP BY ALL) JOIN t USING (frame_id, label, gt) JOIN p USING (frame_id, label, pred) WHERE n / CAST(n_gt + n_pred - n AS DOUBLE) > 0.5)"""


@query(f"WITH s AS MATERIALIZED ({_SEG}), {_MATCH} SELECT frame_id, label, gt, pred, round(iou, 9) AS iou FROM m")
def iou_match(spark, sf_dir):
    return metrics.match_segments(_segments(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


@query(f"""WITH s AS MATERIALIZED ({_SEG}), {_MATCH}, j AS (SELECT t.frame_id, t.label, t.gt, m.pred FROM t LEFT JOIN m USING (frame_id, label, gt)),
w AS (SELECT *, last_value(pred IGNORE NULLS) OVER (PARTITION BY label, gt ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(pred IS NOT NULL) OVER (PARTITION BY label, gt ORDER BY frame_id) AS was FROM j),
g AS (SELECT label, gt, count(*) AS n_gt FROM t GROUP BY ALL), q AS (SELECT label, pred, count(*) AS n_pred FROM p GROUP BY ALL),
a AS (SELECT label, sum(n * n / CAST(n_gt + n_pred - n AS DOUBLE)) AS wt FROM (SELECT label, gt, pred, count(*) AS n FROM m GROUP BY ALL) JOIN g USING (label, gt) JOIN q USING (label, pred) GROUP BY label)
SELECT w.label, count(*) FILTER (WHERE pred IS NOT NULL) AS tp, (SELECT count(*) FROM p WHERE p.label = w.label AND NOT EXISTS (SELECT 1 FROM m WHERE m.frame_id = p.frame_id AND m.label = p.label AND m.pred = p.pred)) AS fp,
 count(*) FILTER (WHERE pred IS NULL) AS fn, count(*) FILTER (WHERE pred IS NOT NULL AND last IS NOT NULL AND last <> pred) AS id_switches, count(*) FILTER (WHERE pred IS NOT NULL AND last IS NOT NULL AND NOT was) AS fragmentations,
 (SELECT count(*) FROM q WHERE q.label = w.label AND NOT EXISTS (SELECT 1 FROM m WHERE m.label = q.label AND m.pred = q.pred)) AS false_tracks,
 round(any_value(wt) / count(*) FILTER (WHERE pred IS NOT NULL), 9) AS association_jaccard FROM w LEFT JOIN a ON a.label = w.label GROUP BY w.label""")
def association_report(spark, sf_dir):
    s = _segments(spark, sf_dir)
    t, p = s.select("frame_id", "label", "gt").distinct(), s.where("pred > 0").select("frame_id", "label", "pred").distinct()
    return metrics.association(t, p, metrics.match_segments(s)).withColumn("association_jaccard", F.round("association_jaccard", 9))


@query(f"""WITH s AS MATERIALIZED ({_SEG}), {_MATCH}, j AS (SELECT t.label, iou FROM t LEFT JOIN m USING (frame_id, label, gt)),
f AS (SELECT p.label, count(*) AS fp FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.frame_id = p.frame_id AND m.label = p.label AND m.pred = p.pred) GROUP BY p.label)
SELECT j.label, count(iou) AS tp, coalesce(any_value(fp), 0) AS fp, count(*) - count(iou) AS fn, round(count(iou) / CAST(count(*) AS DOUBLE), 9) AS recall,
 round(coalesce(sum(iou), 0) / (count(iou) + (coalesce(any_value(fp), 0) + count(*) - count(iou)) / {num(2.0)}), 9) AS pq FROM j LEFT JOIN f ON f.label = j.label GROUP BY j.label""")
def panoptic_quality(spark, sf_dir):
    s = _segments(spark, sf_dir)
    t, p = s.select("frame_id", "label", "gt").distinct(), s.where("pred > 0").select("frame_id", "label", "pred").distinct()
    return metrics.panoptic_quality(t, p, metrics.match_segments(s), "label").withColumns({"recall": F.round("recall", 9), "pq": F.round("pq", 9)})


@query("SELECT event_type, count(value) AS runs, count(*) FILTER (WHERE value > 40) AS misses, round(coalesce(max(value) FILTER (WHERE value > 40) - 40, 0), 6) AS worst FROM events GROUP BY event_type")
def deadline_summary(spark, sf_dir):
    return metrics.deadlines(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 40.0, "event_type").withColumn("worst", F.round("worst", 6))


@query(f"""SELECT frame_id, semantic, count(*) AS cells, round(sum(size_m * size_m), 6) AS area_m2 FROM ({_snapshot_sql(view_sql("wide_points"), GRID)})
  WHERE sqrt((center_x_m - {num(0.027)}) * (center_x_m - {num(0.027)}) + (center_y_m - {num(-0.038)}) * (center_y_m - {num(-0.038)})) < 20 GROUP BY frame_id, semantic""")
def coverage_area(spark, sf_dir):
    """Area of each class within 20 m of the sensor."""
    c = _snapshot(spark, sf_dir).withColumns({"sx": d(0.027), "sy": d(-0.038)})
    return metrics.coverage(c, "semantic", 20.0, "frame_id").withColumn("area_m2", F.round("area_m2", 6))


@query(f"""WITH s AS ({_snapshot_sql(view_sql("dense_points"), GRID)}) SELECT a.frame_id, a.level, a.ix, a.iy, a.semantic AS shown, b.semantic AS truth FROM s a JOIN s b
  ON b.frame_id = (a.frame_id + 1) % 8 AND a.level = b.level AND a.ix = b.ix AND a.iy = b.iy WHERE b.semantic <> 0""")
def cell_truth_majority(spark, sf_dir):
    """What a cell shows against the majority class of another scan's points in it."""
    s = cells.snapshot(cells.keyed(view(spark, sf_dir, "dense_points"), GRID), GRID).select("frame_id", "level", "ix", "iy", "semantic")
    truth = s.where("semantic <> 0").select(((F.col("frame_id") + 7) % 8).alias("frame_id"), "level", "ix", "iy", F.col("semantic").alias("truth"))
    return s.withColumnRenamed("semantic", "shown").join(truth, ["frame_id", "level", "ix", "iy"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    out = metrics.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query(f"SELECT CAST(coalesce(frame_id, -1) AS BIGINT) AS frame_id, CAST(coalesce(truth, -1) AS INTEGER) AS label, count(*) AS points FROM ({view_sql('predictions')}) GROUP BY ROLLUP (frame_id, truth)")
def dataset_rollup(spark, sf_dir):
    out = view(spark, sf_dir, "predictions").rollup("frame_id", "truth").agg(F.count("*").alias("points"))
    return out.select(F.coalesce("frame_id", F.lit(-1)).alias("frame_id"), F.coalesce("truth", F.lit(-1)).alias("label"), "points")


_RUN_A = "SELECT o_orderkey AS frame_id, o_orderstatus AS state, CAST(o_custkey % 5 AS INTEGER) AS cells FROM orders WHERE o_orderkey % 50 <> 7"
_RUN_B = "SELECT o_orderkey AS frame_id, CASE WHEN o_orderkey % 30 = 1 THEN 'X' ELSE o_orderstatus END AS state, CAST(o_custkey % 5 + CASE WHEN o_orderkey % 60 = 1 THEN 1 ELSE 0 END AS INTEGER) AS cells FROM orders WHERE o_orderkey % 50 <> 9"


def _runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    a = o.where(k % 50 != 7).select(k.alias("frame_id"), F.col("o_orderstatus").alias("state"), (F.col("o_custkey") % 5).cast("int").alias("cells"))
    b = o.where(k % 50 != 9).select(k.alias("frame_id"), F.when(k % 30 == 1, "X").otherwise(F.col("o_orderstatus")).alias("state"), (F.col("o_custkey") % 5 + F.when(k % 60 == 1, 1).otherwise(0)).cast("int").alias("cells"))
    return a, b


@query(f"""SELECT * FROM (SELECT coalesce(a.frame_id, b.frame_id) AS frame_id, CASE WHEN a.frame_id IS NULL THEN 'first' WHEN b.frame_id IS NULL THEN 'second' ELSE 'none' END AS missing,
  CAST(CASE WHEN a.state IS NOT DISTINCT FROM b.state THEN 0 ELSE 1 END + CASE WHEN a.cells IS NOT DISTINCT FROM b.cells THEN 0 ELSE 1 END AS INTEGER) AS differing FROM ({_RUN_A}) a FULL JOIN ({_RUN_B}) b ON a.frame_id = b.frame_id) WHERE differing > 0 OR missing <> 'none'""")
def run_diff(spark, sf_dir):
    return metrics.run_diff(*_runs(spark, sf_dir), ["frame_id"], ["state", "cells"])


@query(f"SELECT *, 'first' AS side FROM (({_RUN_A}) EXCEPT ALL ({_RUN_B})) UNION ALL SELECT *, 'second' FROM (({_RUN_B}) EXCEPT ALL ({_RUN_A}))")
def payload_diff(spark, sf_dir):
    return metrics.payload_diff(*_runs(spark, sf_dir))


@query(f"""SELECT frame_id, round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 9) AS agreement, round(max(abs(range_m - range_m * (1 + pred / 1000.0::DOUBLE))), 6) AS max_delta,
  round(quantile_cont(abs(range_m - range_m * (1 + pred / 1000.0::DOUBLE)), 0.999), 6) AS p999_delta, count(*) AS n FROM ({view_sql('predictions')}) GROUP BY frame_id""")
def class_agreement(spark, sf_dir):
    p = view(spark, sf_dir, "predictions").withColumn("other", F.col("range_m") * (d(1) + F.col("pred") / d(1000)))
    out = metrics.agreement(p, "pred", "truth", "range_m", "other", "frame_id")
    return out.withColumns({"agreement": F.round("agreement", 9), "max_delta": F.round("max_delta", 6), "p999_delta": F.round("p999_delta", 6)})


_DRIVE = f"SELECT level, ix, iy, terrain = 1 AS drivable, CASE WHEN (ix + iy) % 4 = 0 THEN NULL ELSE (ix + 2 * iy) % 3 > 0 END AS truth, occupancy, flags, terrain FROM ({_TERRAIN})"


def _driven(spark, sf_dir):
    t = _terrain(spark, sf_dir)
    truth = F.when((F.col("ix") + F.col("iy")) % 4 == 0, None).otherwise((F.col("ix") + 2 * F.col("iy")) % 3 > 0)
    return t.withColumns({"drivable": F.col("terrain") == 1, "truth": truth})


@query(f"""SELECT level, tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(tp / CAST(tp + fp + fn AS DOUBLE), 9) AS iou FROM (
  SELECT level, count(*) FILTER (WHERE drivable AND truth) AS tp, count(*) FILTER (WHERE drivable AND NOT truth) AS fp, count(*) FILTER (WHERE NOT drivable AND truth) AS fn, count(*) FILTER (WHERE NOT drivable AND NOT truth) AS tn
  FROM ({_DRIVE}) WHERE truth IS NOT NULL GROUP BY level)""")
def drivability_confusion(spark, sf_dir):
    return metrics.drivability(_driven(spark, sf_dir), "level").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "iou")})


@query(f"""SELECT reason, count(*) AS cells FROM (SELECT CASE WHEN terrain = 4 THEN 'stale' WHEN occupancy = 1 THEN 'occupied' WHEN flags & 3 > 0 THEN 'step' ELSE 'class' END AS reason FROM ({_DRIVE}) WHERE truth AND NOT drivable) GROUP BY reason""")
def recall_gap(spark, sf_dir):
    c = _driven(spark, sf_dir).withColumns({"seen": F.lit(True), "stale": F.col("terrain") == 4, "occupied": F.col("occupancy") == 1, "sigma": d(0), "step": F.col("flags").bitwiseAND(F.lit(3)) > 0, "semantic_ok": F.lit(False)})
    return metrics.recall_gap(c, FUSION.valid_sigma_m)


_VOX_A = f"SELECT DISTINCT frame_id, CAST(floor(mx / {num(0.2)}) AS INTEGER) AS vx, CAST(floor((my - {num(-25.6)}) / {num(0.2)}) AS INTEGER) AS vy, CAST(floor((mz - {num(-2.0)}) / {num(0.2)}) AS INTEGER) AS vz FROM ({view_sql('returns')})"
_VOX_A = f"SELECT * FROM ({_VOX_A}) WHERE vx BETWEEN 0 AND 255 AND vy BETWEEN 0 AND 255 AND vz BETWEEN 0 AND 31"


def _voxels(spark, sf_dir):
    vx, vy, vz = metrics.voxel(F.col("mx"), F.col("my"), F.col("mz"))
    v = view(spark, sf_dir, "returns").withColumns({"vx": vx, "vy": vy, "vz": vz})
    return v.where(metrics.inside(F.col("vx"), F.col("vy"), F.col("vz")))


@query(f"""WITH a AS ({_VOX_A}), b AS (SELECT * FROM a WHERE (vx + vy) % 5 > 0 UNION SELECT frame_id, vx + 1, vy, vz FROM a WHERE (vx + vy) % 5 = 0 AND vx < 255)
SELECT coalesce(a.frame_id, b.frame_id) AS frame_id, count(*) FILTER (WHERE a.vx IS NOT NULL AND b.vx IS NOT NULL) AS both, count(*) AS "union", round(count(*) FILTER (WHERE a.vx IS NOT NULL AND b.vx IS NOT NULL) / CAST(count(*) AS DOUBLE), 9) AS iou
FROM a FULL JOIN b ON a.frame_id = b.frame_id AND a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz GROUP BY 1""")
def voxel_iou(spark, sf_dir):
    a = _voxels(spark, sf_dir).select("frame_id", "vx", "vy", "vz")
    kept = (F.col("vx") + F.col("vy")) % 5 > 0
    b = a.where(kept).unionByName(a.where(~kept & (F.col("vx") < 255)).withColumn("vx", F.col("vx") + 1))
    return metrics.voxel_iou(a, b).withColumn("iou", F.round("iou", 9))


_RAWS = "CASE WHEN semantic = 9 THEN 40 WHEN semantic = 11 THEN 48 WHEN semantic = 0 THEN 1 WHEN point_id % 48 = 3 THEN 252 ELSE 10 END"
_SCENE = f"""SELECT frame_id, vx, vy, vz, max(raw) AS raw, bool_or(point_id % 10 = 4) AS invalid FROM (SELECT frame_id, point_id, {_RAWS} AS raw, CAST(floor(mx / {num(0.2)}) AS INTEGER) AS vx,
  CAST(floor((my - {num(-25.6)}) / {num(0.2)}) AS INTEGER) AS vy, CAST(floor((mz - {num(-2.0)}) / {num(0.2)}) AS INTEGER) AS vz FROM ({view_sql('returns')})) WHERE vx BETWEEN 0 AND 255 AND vy BETWEEN 0 AND 255 AND vz BETWEEN 0 AND 31 GROUP BY ALL"""


def _sample_sql() -> str:
    parts = []
    heights = [-0.2 + 0.1 * i for i in range(6)]
    import math

    for k, w in enumerate(GRID.widths_m):
        n = math.ceil(w / 0.1) + 1
        offsets = [1e-6 + i * ((w - 2e-6) / (n - 1)) for i in range(n)]
        values = lambda xs: f"unnest([{', '.join(num(x) for x in xs)}])"
        parts.append(f"SELECT frame_id, level, ix, iy, ix * {num(w)} + a AS x, iy * {num(w)} + b AS y, z + h AS z FROM f, (SELECT {values(offsets)} AS a), (SELECT {values(offsets)} AS b), (SELECT {values(heights)} AS h) WHERE level = {k}")
    return " UNION ALL ".join(parts)


_FREE_FRAME = f"SELECT frame_id, level, ix, iy, {num(-1.73)} AS z FROM ({_FREE_SQL}) WHERE level > 0 AND ix > 0"
_RAW_TABLE = ", ".join(f"({r}, {c})" for r, c in CLASS_OF_RAW.items())
_SCORED = f"""WITH f AS MATERIALIZED ({_FREE_FRAME}), v AS MATERIALIZED ({_SCENE}), s AS (SELECT DISTINCT frame_id, level, ix, iy, CAST(floor(x / {num(0.2)}) AS INTEGER) AS vx, CAST(floor((y - {num(-25.6)}) / {num(0.2)}) AS INTEGER) AS vy, CAST(floor((z - {num(-2.0)}) / {num(0.2)}) AS INTEGER) AS vz FROM ({_sample_sql()})),
j AS (SELECT s.*, coalesce(v.raw, 0) AS raw, coalesce(v.invalid, false) AS invalid, coalesce(m.cls, 0) AS cls FROM s LEFT JOIN v USING (frame_id, vx, vy, vz) LEFT JOIN (VALUES {_RAW_TABLE}) m(raw, cls) ON m.raw = coalesce(v.raw, 0) WHERE vx BETWEEN 0 AND 255 AND vy BETWEEN 0 AND 255 AND vz BETWEEN 0 AND 31),
g AS (SELECT frame_id, level, ix, iy, bool_or(NOT invalid) AS ok, bool_or(NOT invalid AND raw <> 0 AND cls NOT IN (0, 9, 10, 11, 12, 17) AND raw < 252) AS bad, bool_or(NOT invalid AND raw >= 252 AND cls NOT IN (0, 9, 10, 11, 12, 17)) AS mov FROM j GROUP BY ALL),
r AS (SELECT f.level, g.ok IS NOT NULL AS inside, coalesce(ok, false) AS ok, coalesce(bad, false) AS bad, coalesce(mov, false) AS mov, CASE f.level WHEN 0 THEN 25 WHEN 1 THEN 100 ELSE 2500 END AS area FROM f LEFT JOIN g USING (frame_id, level, ix, iy))
SELECT level, count(*) AS free_cells, count(*) FILTER (WHERE inside) AS inside_volume, count(*) FILTER (WHERE ok) AS verifiable, count(*) FILTER (WHERE ok AND bad) AS false_free, count(*) FILTER (WHERE ok AND mov) AS moving_trace_hits,
 CAST(sum(CASE WHEN ok THEN area ELSE 0 END) AS BIGINT) AS verifiable_area_cm2, CAST(sum(CASE WHEN ok AND bad THEN area ELSE 0 END) AS BIGINT) AS false_free_area_cm2,
 round(count(*) FILTER (WHERE ok AND bad) / CAST(count(*) FILTER (WHERE ok) AS DOUBLE), 9) AS false_free_rate, round(sum(CASE WHEN ok AND bad THEN area ELSE 0 END) / CAST(sum(CASE WHEN ok THEN area ELSE 0 END) AS DOUBLE), 9) AS area_rate FROM r GROUP BY level"""


@query(_SCORED)
def false_free_report(spark, sf_dir):
    """Free cells scored against labelled voxels."""
    raw = F.when(F.col("semantic") == 9, 40).when(F.col("semantic") == 11, 48).when(F.col("semantic") == 0, 1).when(F.col("point_id") % 48 == 3, 252).otherwise(10)
    scene = _voxels(spark, sf_dir).groupBy("frame_id", "vx", "vy", "vz").agg(F.max(raw).alias("raw"), F.bool_or(F.col("point_id") % 10 == 4).alias("invalid"), F.lit(False).alias("occluded"))
    free = freespace.free_cells(scan(spark, sf_dir), GRID, FREE).where("level > 0 and ix > 0").select("frame_id", "level", "ix", "iy", d(-1.73).alias("return_z_m"))
    out = metrics.false_free_rates(metrics.score_free_cells(free, scene, GRID.widths_m), GRID.widths_m, "level")
    return out.withColumns({"false_free_rate": F.round("false_free_rate", 9), "area_rate": F.round("area_rate", 9)})


# ---------------------------------------------------------------- contracts

_CELLS = _snapshot_sql(view_sql("wide_points"), GRID)


def _snapshot(spark, sf_dir):
    return cells.snapshot(cells.keyed(view(spark, sf_dir, "wide_points"), GRID), GRID)


def _spoiled(spark, sf_dir):
    """A snapshot some of whose cells break a rule."""
    s = _snapshot(spark, sf_dir)
    return s.withColumns({"level": F.when(F.col("ix") % 97 == 0, 9).otherwise(F.col("level")), "ground_valid": F.col("ground_valid") & (F.col("iy") % 89 != 0), "center_x_m": F.when(F.col("iy") % 83 == 0, F.col("center_x_m") + 1).otherwise(F.col("center_x_m"))})


_W9 = duck.width(GRID)


@query(f"""WITH s AS MATERIALIZED (SELECT * REPLACE (CASE WHEN ix % 97 = 0 THEN 9 ELSE level END AS level, ground_valid AND iy % 89 <> 0 AS ground_valid, CASE WHEN iy % 83 = 0 THEN center_x_m + 1 ELSE center_x_m END AS center_x_m) FROM ({_CELLS})),
f AS (SELECT frame_id, unnest(['level', 'index', 'geometry', 'ground', 'support']) AS rule, unnest([level NOT BETWEEN 0 AND 2, abs(ix) >= 33554432 OR abs(iy) >= 33554432,
  size_m <> CASE level WHEN 0 THEN {num(0.05)} WHEN 1 THEN {num(0.1)} ELSE {num(0.5)} END OR center_x_m <> (ix + {num(0.5)}) * CASE level WHEN 0 THEN {num(0.05)} WHEN 1 THEN {num(0.1)} ELSE {num(0.5)} END OR center_y_m <> (iy + {num(0.5)}) * CASE level WHEN 0 THEN {num(0.05)} WHEN 1 THEN {num(0.1)} ELSE {num(0.5)} END,
  NOT ground_valid AND ground_height_cm <> 0, point_count < 1]) AS bad FROM s) SELECT frame_id, rule, count(*) FILTER (WHERE bad) AS broken FROM f GROUP BY frame_id, rule""")
def cell_contract(spark, sf_dir):
    return contracts.violations(_spoiled(spark, sf_dir), contracts.cell_rules(GRID), "frame_id")


@query(f"""WITH t AS MATERIALIZED (SELECT *, iy % 13 = 4 AS b, (ix + iy) % 17 = 5 AS c, (ix + 2 * iy) % 19 = 6 AS e, (ix + 4 * iy) % 23 < 3 AS g FROM ({_TERRAIN_ALL}))
SELECT rule, count(*) FILTER (WHERE bad) AS broken FROM (SELECT unnest(['range', 'time', 'valid', 'height', 'stale', 'drivable']) AS rule, unnest([ix % 11 = 3, b, c, c AND ok AND h <> 0,
 (e OR terrain = 4 AND NOT g) <> (stale AND NOT b) OR (occupancy = 3) <> (stale AND NOT b), NOT e AND (g OR terrain = 1) AND (c = ok OR ix % 7 = 2 OR top NOT IN (9, 10) OR ix % 11 <> 3 AND flags & 3 <> 0)]) AS bad FROM t) GROUP BY rule""")
def terrain_contract(spark, sf_dir):
    """Cells of a terrain view that break its contract, by rule; some cells are forged."""
    ix, iy = F.col("ix"), F.col("iy")
    forged = _terrain(spark, sf_dir).withColumns(
        {
            "flags": F.when(ix % 11 == 3, 8).otherwise(F.col("flags")),
            "last_seen": F.when(iy % 13 == 4, 7_000_000_001).otherwise(F.col("last_seen")),
            "ground_valid": ((ix + iy) % 17 == 5) != F.col("ground_valid"),
            "terrain": F.when((ix + 2 * iy) % 19 == 6, 4).when((ix + 4 * iy) % 23 < 3, 1).otherwise(F.col("terrain")),
            "semantic": F.when(ix % 7 == 2, 5).otherwise(F.col("semantic")),
        }
    )
    return contracts.violations(forged, contracts.terrain_rules(FUSION, F.lit(7_000_000_000)))


def _parent(k: int, j: int, c: str) -> str:
    return duck.div(f"a.{c}", GRID.ratios[k] // GRID.ratios[j])


_COVERED = " UNION ALL ".join(f"SELECT a.frame_id FROM m a SEMI JOIN m b ON a.frame_id = b.frame_id AND a.level = {j} AND b.level = {k} AND b.ix = {_parent(k, j, 'ix')} AND b.iy = {_parent(k, j, 'iy')}" for k in (1, 2) for j in range(k))
_NEAR_FORGED = f"""SELECT DISTINCT f.frame_id, f.level, f.ix, f.iy FROM g f JOIN (SELECT frame_id, (ix + {num(0.5)}) * w AS mx, (iy + {num(0.5)}) * w AS my FROM g WHERE (ix * 7 + iy) % 97 = 3) c ON c.frame_id = f.frame_id
 WHERE sqrt(pow(greatest(f.x0 - c.mx, c.mx - f.x0 - f.w, 0), 2) + pow(greatest(f.y0 - c.my, c.my - f.y0 - f.w, 0), 2)) < {num(FREE.margin_m)}"""


@query(f"""WITH f AS MATERIALIZED ({_FREE_SQL}), g AS MATERIALIZED (SELECT *, ix * w AS x0, iy * w AS y0 FROM (SELECT *, {_W9} AS w FROM f)),
e AS MATERIALIZED (SELECT frame_id, level, ix, iy FROM f UNION ALL SELECT DISTINCT frame_id, level, ix, iy FROM ({duck.keyed(view_sql('returns'), GRID)})),
m AS MATERIALIZED (SELECT * FROM e UNION ALL SELECT * FROM e WHERE (ix * 31 + iy) % 101 = 7 UNION ALL SELECT DISTINCT frame_id, 1, {duck.div('ix', 2)}, {duck.div('iy', 2)} FROM e WHERE level = 0 AND (ix + iy) % 59 = 11)
SELECT (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY frame_id, level, ix, iy HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM ({_COVERED})) AS covered,
 (SELECT count(*) FROM f WHERE (ix + 3 * iy) % 41 = 2 OR (2 * ix + iy) % 43 = 1) AS unsupported, (SELECT count(*) FROM ({_NEAR_FORGED})) AS margin""")
def visibility_contract(spark, sf_dir):
    """Published cells that overlap, free cells without a beam across them or nearer than the margin to a conflict; cells, proofs and conflicts are forged."""
    p = scan(spark, sf_dir)
    ix, iy = F.col("ix"), F.col("iy")
    free = freespace.free_cells(p, GRID, FREE).persist()  # read by four checks; what is lost is computed again
    beams = freespace.beams(p, GRID, FREE)
    observed = cells.keyed(p, GRID).select("frame_id", "level", "ix", "iy").distinct()
    every = observed.unionByName(free.select("frame_id", "level", "ix", "iy")).persist()
    parents = every.where((F.col("level") == 0) & ((ix + iy) % 59 == 11)).select("frame_id", F.lit(1).alias("level"), floor_div(ix, 2).alias("ix"), floor_div(iy, 2).alias("iy")).distinct()
    published = every.unionByName(every.where((ix * 31 + iy) % 101 == 7)).unionByName(parents)
    proofs = free.withColumns({"beam_point_id": F.when((ix + 3 * iy) % 41 == 2, -5).otherwise(F.col("beam_point_id")), "ray_support": F.when((2 * ix + iy) % 43 == 1, 0).otherwise(F.col("ray_support"))})
    w = pick(F.col("level"), GRID.widths_m)
    conflicts = p.where("not clean").select("frame_id", "mx", "my").unionByName(free.where((ix * 7 + iy) % 97 == 3).select("frame_id", ((ix + d(0.5)) * w).alias("mx"), ((iy + d(0.5)) * w).alias("my")))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        n(contracts.repeated_cells(published, "frame_id"), "repeated"),
        n(contracts.covered_cells(published, GRID, "frame_id"), "covered"),
        n(contracts.unsupported_free(proofs, beams, GRID), "unsupported"),
        n(contracts.margin_breaches(free, conflicts, GRID, FREE.margin_m), "margin"),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def _frames(spark, sf_dir):
    """A result and a scan for each event: 40 sequences of frames; some results are forged."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 40).alias("sequence"), F.expr("event_id div 40").alias("frame_id"))
    k, sha = F.col("event_id"), F.sha2(F.col("event_id").cast("string"), 256)
    scans = e.where(k % 101 != 7).select("sequence", "frame_id", (F.col("frame_id") * 100_000_000).alias("scan_ns"), sha.alias("digest"), (k % 1000).alias("n_points"))
    stage = F.when(k % 41 == 3, "draft").otherwise(F.element_at(F.array(*map(F.lit, contracts.STAGES)), (k % 6 + 1).cast("int")))
    results = e.select(
        "sequence", "frame_id", F.when(k % 53 == 1, F.col("frame_id") - 2).otherwise(F.col("frame_id")).alias("arrival"),
        (F.col("frame_id") * 100_000_000 + F.when(k % 59 == 2, 1).otherwise(0)).alias("ts_ns"), (k % 6 + F.when(k % 37 == 5, 2).otherwise(1)).cast("int").alias("schema"), stage.alias("stage"),
        F.when(k % 43 == 9, "").otherwise("run").alias("run_id"), sha.alias("revision"), F.when(k % 47 == 4, F.lit("none")).otherwise(sha).alias("config_digest"),
        F.when(k % 31 == 6, F.sha2(F.lit("other"), 256)).otherwise(sha).alias("scan_digest"), F.when((k % 6 == 0) & (k % 29 != 8), F.lit(None)).otherwise(sha).alias("weights_digest"),
        F.when(k % 23 == 2, "unverified").otherwise("verified").alias("pose_quality"), (k % 1000 + F.when(k % 61 == 11, 1).otherwise(0)).alias("n_input"),
    )
    return results, scans


@query("""WITH e AS (SELECT event_id AS k, event_id % 40 AS sequence, event_id // 40 AS frame_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM events),
r AS (SELECT *, frame_id - CASE WHEN k % 53 = 1 THEN 2 ELSE 0 END AS arrival, frame_id * 100000000 + CASE WHEN k % 59 = 2 THEN 1 ELSE 0 END AS ts FROM e),
o AS (SELECT *, max(frame_id) OVER w AS f0, max(ts) OVER w AS t0 FROM r WINDOW w AS (PARTITION BY sequence ORDER BY arrival, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT unnest(['stage', 'schema', 'provenance', 'scan', 'order', 'count', 'pose', 'model']) AS rule, unnest([k % 41 = 3, k % 41 <> 3 AND k % 37 = 5, k % 43 = 9 OR k % 47 = 4,
 k % 101 = 7 OR k % 31 = 6 OR k % 59 = 2, coalesce(frame_id <= f0 OR ts <= t0, false), k % 101 <> 7 AND k % 61 = 11, k % 41 <> 3 AND k % 6 = 5 AND k % 23 = 2, k % 41 <> 3 AND k % 6 = 0 AND k % 29 = 8]) AS bad FROM o)
SELECT rule, count(*) AS broken FROM b WHERE bad GROUP BY rule""")
def identity_contract(spark, sf_dir):
    """Results that are not of their scan, out of order, or without provenance, by rule."""
    results, scans = _frames(spark, sf_dir)
    return contracts.identity_violations(results, scans).groupBy("rule").agg(F.count("*").alias("broken"))


@query("""WITH p AS (SELECT event_id AS k, event_id % 16 AS frame_id, event_id AS at, CASE WHEN event_id % 71 = 3 THEN event_id - 100 ELSE event_id END AS place, CASE WHEN event_id % 67 = 5 THEN -event_id - 1 ELSE event_id END AS point_id,
 CASE WHEN event_id % 61 = 7 THEN 23 ELSE event_id % 20 END AS semantic, CASE WHEN event_id % 59 = 8 THEN 1.5 ELSE 0.5 END AS confidence, CASE WHEN event_id % 20 = 0 THEN 0 WHEN event_id % 53 = 2 THEN 0 ELSE 1 END AS support, CASE WHEN event_id % 20 = 0 AND event_id % 60 <> 0 THEN 1 ELSE 0 END AS reason, CASE WHEN event_id % 47 = 6 THEN 1 ELSE 0 END AS motion FROM events),
j AS (SELECT p.*, s.at AS own FROM p LEFT JOIN (SELECT event_id AS at, event_id % 16 AS f FROM events) s ON s.at = p.point_id AND s.f = p.frame_id),
o AS (SELECT *, max(own) OVER (PARTITION BY frame_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM j),
b AS (SELECT unnest(['alignment', 'class', 'confidence', 'unknown-reason', 'unsupported', 'claims']) AS rule, unnest([own IS NULL OR coalesce(own <= prior, false), semantic > 19, confidence > 1, semantic = 0 AND reason = 0, semantic <> 0 AND support = 0, motion <> 0 OR support <> CASE WHEN semantic <> 0 THEN 1 ELSE 0 END]) AS bad FROM o)
SELECT rule, count(*) AS broken FROM b WHERE bad GROUP BY rule""")
def point_contract(spark, sf_dir):
    """Result points that break their contract, by rule."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("k"), (F.col("event_id") % 16).alias("frame_id"))
    k = F.col("k")
    source = e.select("frame_id", k.alias("point_id"), k.alias("at"))
    points = e.select(
        "frame_id", F.when(k % 67 == 5, -k - 1).otherwise(k).alias("point_id"), F.when(k % 71 == 3, k - 100).otherwise(k).alias("place"), F.when(k % 61 == 7, 23).otherwise(k % 20).cast("int").alias("semantic"), F.when(k % 59 == 8, 1.5).otherwise(0.5).alias("confidence"),
        F.when((k % 20 == 0) | (k % 53 == 2), 0).otherwise(1).alias("support"), F.when((k % 20 == 0) & (k % 60 != 0), 1).otherwise(0).alias("reason"), F.when(k % 47 == 6, 1).otherwise(0).alias("motion"),
    )
    return contracts.point_violations(points, source, "candidate").groupBy("rule").agg(F.count("*").alias("broken"))


@query("""WITH p AS (SELECT event_id AS k, event_id // 60 AS frame_id, (event_id % 60) // 6 AS i, CAST(event_id * 7919 % 1000 AS DOUBLE) / 10 AS x, CAST(event_id * 31 % 1000 AS DOUBLE) / 10 AS y FROM events),
g AS (SELECT frame_id, i, 1 + i % 8 AS c, list_sort(list(k)) AS ids, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, frame_id * 10 + i AS n FROM p GROUP BY frame_id, i),
f AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY i) - 1 AS nth FROM g),
b AS (SELECT unnest(['id', 'support', 'overlap', 'class', 'status', 'ambiguity', 'geometry', 'bounds', 'class-support']) AS rule, unnest([i <> nth, n % 17 = 2, false, n % 19 = 3, n % 23 = 4, n % 23 <> 4 AND len(ids) + CASE WHEN n % 17 = 2 THEN 1 ELSE 0 END < 3, n % 29 = 5, n % 31 = 6, n % 37 = 7]) AS bad FROM f)
SELECT rule, count(*) AS broken FROM b WHERE bad GROUP BY rule""")
def instance_contract(spark, sf_dir):
    """Instances that do not follow from their points, by rule."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("point_id"), F.expr("event_id div 60").alias("frame_id"), F.expr("event_id % 60 div 6").alias("i"))
    k, i = F.col("point_id"), F.col("i")
    p = e.select("*", (k * 7919 % 1000 / d(10)).alias("mx"), (k * 31 % 1000 / d(10)).alias("my"), d(0).alias("mz"), F.when((F.col("frame_id") * 10 + i) % 37 == 7, 19).otherwise(1 + i % 8).alias("semantic"))
    n = F.col("frame_id") * 10 + i
    g = p.groupBy("frame_id", "i").agg(F.sort_array(F.collect_list("point_id")).alias("ids"), *[f(f"m{a}").alias(f"{a}{s}") for a in "xyz" for s, f in ((0, F.min), (1, F.max))])
    g = g.withColumns({f"center_{a}": (F.col(f"{a}0") + F.col(f"{a}1")) / 2 for a in "xyz"})
    forged = g.select(
        "frame_id", i.alias("instance_id"), (1 + i % 8).cast("int").alias("semantic"), F.when(n % 19 == 3, 2.0).otherwise(0.5).alias("score"), F.when(n % 23 == 4, "seen").otherwise("observed").alias("status"),
        F.when(n % 17 == 2, F.array_append("ids", F.lit(1 << 40))).otherwise(F.col("ids")).alias("point_ids"), F.when(n % 31 == 6, F.col("x0") - 1).otherwise(F.col("x0")).alias("x0"), "y0", "z0", "x1", "y1", "z1",
        "center_x", F.when(n % 29 == 5, F.lit(None)).otherwise(F.col("center_y")).alias("center_y"), "center_z",
    )
    return contracts.instance_violations(forged, p).groupBy("rule").agg(F.count("*").alias("broken"))


@query("""WITH r AS (SELECT event_id AS k, event_id % 16 AS sequence FROM events), b AS (SELECT sequence, unnest(['points', 'map', 'tracks', 'queue', 'queue-age', 'memory', 'device', 'swap', 'receipt', 'audit', 'disk', 'timing', 'counter', 'state-size', 'device-sample']) AS rule,
 unnest([k % 11 = 1, k % 13 = 2, false, k % 17 = 3, k % 19 = 4, k % 23 = 5, k % 29 = 6 AND k % 2 = 0, k % 31 = 7, k % 37 = 8, false, k % 41 = 9, k % 43 = 10, k % 47 = 11, k % 53 = 12, k % 29 <> 6 AND k % 59 = 13]) AS bad FROM r)
SELECT sequence, rule, count(*) FILTER (WHERE bad) AS broken FROM b GROUP BY sequence, rule""")
def resource_contract(spark, sf_dir):
    """Frames' diagnostics against the ceilings, by sequence and rule."""
    k = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    over = lambda m, r, bad, good: F.when(k % m == r, F.lit(bad)).otherwise(F.lit(good))
    sampled = k % 29 == 6
    rows = e.select(
        (k % 16).alias("sequence"), over(11, 1, 130_001, 130_000).alias("input_points"), over(13, 2, 262_145, 262_144).alias("map_cells"), (over(13, 2, 262_145, 262_144) + F.when(k % 53 == 12, 1).otherwise(0)).alias("cells"),
        F.lit(512).alias("track_count"), F.lit(512).alias("tracks"), over(17, 3, 3, 2).alias("queue_depth"), over(19, 4, 100.5, 100.0).alias("queue_age_ms"), F.lit(0).alias("dropped"), over(47, 11, -1, 0).alias("invalid"),
        over(43, 10, -1.0, 80.0).alias("process_ms"), over(23, 5, (12 << 30) + 1, 1 << 30).alias("rss"), F.when(sampled, F.when(k % 2 == 0, (5_500 << 20) + 1).otherwise(5)).alias("device"),
        F.when(sampled | (k % 59 == 13), "sampled").otherwise("unavailable").alias("device_status"), over(31, 7, 1, 0).alias("swap"), over(37, 8, (2 << 20) + 1, 10).alias("receipt"), F.lit(10).alias("audit"), over(41, 9, 5 << 30, 20 << 30).alias("disk_free"),
    )
    return contracts.violations(rows, contracts.resource_rules(), "sequence")


_RUN_METRICS = f"""WITH c AS ({_CONF}), i AS (SELECT band, sum(tp / CAST("union" AS DOUBLE)) / 19 AS miou, min(tp / CAST("union" AS DOUBLE)) AS low FROM ({_IOU}) GROUP BY band),
u AS (SELECT band, sum(CASE WHEN pred = 0 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS unknown FROM c GROUP BY band),
v AS (SELECT 'miou_19' AS metric, miou AS value FROM i WHERE band = 'all' UNION ALL SELECT 'class_iou_min', low FROM i WHERE band = 'all' UNION ALL SELECT 'unknown_coverage', unknown FROM u WHERE band = 'all'
 UNION ALL SELECT 'range_miou_near', miou FROM i WHERE band = '0-20m' UNION ALL SELECT 'range_miou_middle', miou FROM i WHERE band = '20-50m' UNION ALL SELECT 'range_miou_far', miou FROM i WHERE band = '50m+'
 UNION ALL SELECT 'range_unknown', max(unknown) FROM u WHERE band <> 'all')"""
_GATE_ROWS = ", ".join(f"('{m}', {'NULL' if x is None else num(x)}, {str(at).lower()})" for m, x, at in contracts.GATES)


def _run_metrics(spark, sf_dir):
    conf = metrics.confusion(view(spark, sf_dir, "predictions"))
    m = metrics.semantic_metrics(conf)
    low = metrics.class_iou(conf).where("band = 'all'").agg(F.min("iou").alias("value")).select(F.lit("class_iou_min").alias("metric"), "value")
    names = {"all": "miou_19", "0-20m": "range_miou_near", "20-50m": "range_miou_middle", "50m+": "range_miou_far"}
    band = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("band"))
    out = m.select(band.alias("metric"), F.col("miou_19").alias("value")).unionByName(low)
    out = out.unionByName(m.where("band = 'all'").select(F.lit("unknown_coverage").alias("metric"), F.col("unknown_coverage").alias("value")))
    out = out.unionByName(m.where("band <> 'all'").agg(F.max("unknown_coverage").alias("value")).select(F.lit("range_unknown").alias("metric"), "value"))
    return out.withColumn("run", F.lit("predictions"))


@query(f"""{_RUN_METRICS} SELECT 'predictions' AS run, g.metric, round(coalesce(v.value, -1), 9) AS value, CASE WHEN bound IS NULL OR v.value IS NULL THEN 'not-verified' WHEN (at_most AND v.value > bound) OR (NOT at_most AND v.value < bound) THEN 'failed' ELSE 'passed' END AS status
 FROM (VALUES {_GATE_ROWS}) g(metric, bound, at_most) LEFT JOIN v ON v.metric = g.metric""")
def gate_checks(spark, sf_dir):
    return contracts.gate_checks(_run_metrics(spark, sf_dir)).withColumn("value", F.round(F.coalesce("value", d(-1)), 9))


@query(f"""{_RUN_METRICS}, k AS (SELECT CASE WHEN bound IS NULL OR v.value IS NULL THEN 'n' WHEN (at_most AND v.value > bound) OR (NOT at_most AND v.value < bound) THEN 'f' ELSE 'p' END AS s FROM (VALUES {_GATE_ROWS}) g(metric, bound, at_most) LEFT JOIN v ON v.metric = g.metric)
SELECT 'predictions' AS run, count(*) FILTER (WHERE s = 'f') AS failures, count(*) FILTER (WHERE s = 'n') AS missing, CASE WHEN count(*) FILTER (WHERE s = 'n') > 0 THEN 'not-verified' WHEN count(*) FILTER (WHERE s = 'f') > 0 THEN 'failed' ELSE 'passed' END AS status FROM k""")
def gate_overall(spark, sf_dir):
    return contracts.overall(contracts.gate_checks(_run_metrics(spark, sf_dir)))


_RECEIPT = ("frame_id", "ground_height_cm", "ground_valid", "ix", "iy", "level", "motion", "point_count", "semantic")
_ROW = " || ',' || ".join(f"'\"{c}\":' || {c}" for c in _RECEIPT)


@query(f"""WITH s AS MATERIALIZED (SELECT * REPLACE (CASE WHEN frame_id < 4 AND ix % 97 = 0 THEN 9 ELSE level END AS level, ground_valid AND NOT (frame_id < 4 AND iy % 89 = 0) AS ground_valid) FROM ({_CELLS}) WHERE frame_id > 0 OR level < 2 OR (ix % 97 <> 0 AND iy % 89 <> 0)),
h AS (SELECT frame_id, sha256('{{' || {_ROW} || '}}') AS h, CASE WHEN level = 9 AND size_m <> 0.5 THEN 'geometry' WHEN NOT ground_valid AND ground_height_cm <> 0 THEN 'ground' WHEN level = 9 THEN 'level' END AS bad FROM s)
SELECT frame_id, count(*) AS rows, CASE WHEN min(bad) IS NULL THEN sha256(string_agg(h, '' ORDER BY h)) ELSE '' END AS digest, coalesce(min(bad), '') AS error, CASE WHEN min(bad) IS NULL THEN 'accepted' ELSE 'rejected' END AS status FROM h GROUP BY frame_id""")
def receipts(spark, sf_dir):
    """A digest of each frame's cells, or its first broken rule."""
    s = _snapshot(spark, sf_dir)
    early = F.col("frame_id") < 4
    whole = (F.col("frame_id") > 0) | (F.col("level") < 2) | ((F.col("ix") % 97 != 0) & (F.col("iy") % 89 != 0))
    s = s.where(whole).withColumns({"level": F.when(early & (F.col("ix") % 97 == 0), 9).otherwise(F.col("level")), "ground_valid": F.col("ground_valid") & ~(early & (F.col("iy") % 89 == 0))})
    out = contracts.receipts(s.select(*_RECEIPT), contracts.violations(s, contracts.cell_rules(GRID), "frame_id"), "frame_id")
    return out.fillna("", ["digest", "error"])


# ---------------------------------------------------------------- tracking


def candidates(spark, sf_dir):
    """Ten sequences of candidates drifting along x, some missing, some ambiguous."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    frame = F.expr("event_id div 100")
    instance = F.expr("event_id div 10 % 10")
    x = instance * d(12) + frame * d(0.3) + (F.col("user_id") % 10) / d(50)
    out = e.where(k % 13 != 5).select((k % 10).alias("sequence"), frame.alias("frame_id"), (frame * 100_000_000 + 1).alias("ts_ns"), instance.alias("instance_id"), (1 + instance % 4).cast("int").alias("semantic"), F.when(k % 17 == 3, "ambiguous").otherwise("observed").alias("status"), x.alias("cx"), ((k % 3) / d(10)).alias("cy"), d(0).alias("cz"))
    return out.select("*", *[(F.col(f"c{a}") + d(s)).alias(f"{a}{n}") for n, s in ((0, -0.5), (1, 0.5)) for a in "xyz"]).select("sequence", "frame_id", "ts_ns", "instance_id", "semantic", "status", *tracks.BOX)


@query()
def tracks_batch(spark, sf_dir):
    """Track rows of every frame (held against golden scenarios and the streaming twin in tests)."""
    return tracks.track(candidates(spark, sf_dir))


# Fixed values of the fixture: the life of a track that is seen in frames 0, 1, 2 and 5.
_LIFE = ("tentative", "confirmed", "confirmed", "occluded", "occluded", "confirmed", "occluded", "occluded", "expired")
_SEEN = (0, 1, 2, 2, 2, 5, 5, 5, 5)


@query(f"""WITH e AS (SELECT event_id, event_id // 9 AS track_id, event_id % 9 AS k FROM events), r AS (SELECT *, list_extract({list(_LIFE)}, k + 1) AS due, list_extract({list(_SEEN)}, k + 1) AS since FROM e),
f AS (SELECT track_id, k, due, since = k AS seen, CASE WHEN event_id % 41 = 3 AND k > 0 THEN 'expired' ELSE due END AS life, CASE WHEN event_id % 43 = 5 THEN 1 ELSE 0 END AS birth, since * 100 + CASE WHEN event_id % 47 = 7 THEN 1 ELSE 0 END AS last FROM r),
l AS (SELECT *, lag(life) OVER w AS was, lag(birth) OVER w AS born, lag(last) OVER w AS before FROM f WINDOW w AS (PARTITION BY track_id ORDER BY k)),
v AS (SELECT CASE WHEN life <> due THEN 'lifecycle' WHEN born <> birth THEN 'birth-changed' WHEN was = 'expired' THEN 'reused-id' WHEN seen AND last <> k * 100 OR NOT seen AND last <> before THEN 'observation-time' END AS rule FROM l)
SELECT rule, count(*) AS violations FROM v WHERE rule IS NOT NULL GROUP BY rule""")
def track_contract(spark, sf_dir):
    """Track rows that do not follow from the frame before, by rule; one event is one frame of a track of nine, some forged."""
    e, k = F.col("event_id"), F.col("k")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("event_id div 9").alias("track_id"), (e % 9).cast("int").alias("k"))
    due, at = (F.element_at(F.array(*map(F.lit, v)), k + 1) for v in (_LIFE, _SEEN))
    rows = rows.select(
        (F.col("track_id") % 16).alias("sequence"), k.cast("long").alias("frame_id"), "track_id", F.when(at == k, 0).alias("instance_id"), F.when((e % 41 == 3) & (k > 0), "expired").otherwise(due).alias("lifecycle"),
        F.when(e % 43 == 5, 1).otherwise(0).alias("birth_ns"), (at * 100 + F.when(e % 47 == 7, 1).otherwise(0)).alias("last_observed_ns"), (k * 100).alias("ts_ns"),
    )
    return contracts.lifecycle_violations(rows).groupBy("rule").agg(F.count("*").alias("violations"))
