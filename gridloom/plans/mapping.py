"""Queries of the stateless per-frame operators: gates, lattice, cells, range view, labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import Grid
from gridloom.functions import labels, lattice
from gridloom.operators import cells, contracts, gates, range_view
from gridloom.plans import duck
from gridloom.plans.duck import num
from gridloom.plans.views import SENSOR, view, view_sql

GRID = Grid()
SQUARE = Grid(sizes_cm=(5, 10, 20, 40), radii_m=(10.0, 25.0, 50.0, 100.0), footprint="square")
#: A turn by 30 degrees about z and a shift to the sensor's place.
POSE = (math.sqrt(3) / 2, -0.5, 0.0, SENSOR[0], 0.5, math.sqrt(3) / 2, 0.0, SENSOR[1], 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_points").withColumn("pose", F.array(*map(lattice.d, POSE)))


_MAPPED = ", ".join(f"x * {num(POSE[4 * r])} + y * {num(POSE[4 * r + 1])} + z * {num(POSE[4 * r + 2])} + {num(POSE[4 * r + 3])} AS {c}" for r, c in enumerate(("mx", "my", "mz")))
_STATUS = f"""CASE
  WHEN NOT ({duck.finite('x')} AND {duck.finite('y')} AND {duck.finite('z')}) THEN 'invalid'
  WHEN greatest(abs(x), abs(y), abs(z)) > 1000000 OR sqrt(x*x + y*y + z*z) < {num(0.05)} THEN 'invalid'
  WHEN NOT (sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) < 100 AND greatest(abs(mx), abs(my)) <= 1000000) THEN 'outside'
  WHEN abs(mz) > 10000 THEN 'high' ELSE 'accepted' END"""
_CLASSIFIED = f"SELECT *, {_STATUS} AS status FROM (SELECT *, {_MAPPED} FROM ({view_sql('raw_points')}))"


@query(
    f"""SELECT frame_id, count(*) AS n_input, count(*) FILTER (WHERE status = 'invalid') AS n_invalid,
    count(*) FILTER (WHERE status = 'outside') AS n_outside, count(*) FILTER (WHERE status = 'high') AS n_high,
    count(*) FILTER (WHERE status = 'accepted') AS n_accepted FROM ({_CLASSIFIED}) GROUP BY frame_id"""
)
def accept_accounting(spark, sf_dir):
    return gates.accounting(_raw(spark, sf_dir), GRID)


@query(f"SELECT frame_id, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz FROM ({_CLASSIFIED}) WHERE status = 'accepted'")
def transform_points(spark, sf_dir):
    return gates.accept(_raw(spark, sf_dir), GRID).select("frame_id", *(F.round(c, 6).alias(c) for c in ("mx", "my", "mz")))


@query(f"SELECT frame_id, count(*) AS n, CAST(sum(CASE WHEN abs(x) < 1e9 THEN 1 ELSE 0 END) AS BIGINT) AS back FROM ({_CLASSIFIED}) WHERE status = 'accepted' GROUP BY frame_id")
def inverse_round_trip(spark, sf_dir):
    """Map and back: every accepted point returns to its sensor coordinates within a nanometre."""
    df = gates.accept(_raw(spark, sf_dir), GRID)
    bx, by, bz = gates.inverse_transform(*(F.col(c) for c in ("mx", "my", "mz")), F.col("pose"))
    same = (F.abs(bx - F.col("x")) < 1e-9) & (F.abs(by - F.col("y")) < 1e-9) & (F.abs(bz - F.col("z")) < 1e-9)
    return df.groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(same).alias("back"))


def _snapshot_sql(source: str, grid: Grid) -> str:
    g, o, k = "ground = 1", "ground = 2", duck.finite("intensity")
    counts = ", ".join(f"count(*) FILTER (WHERE semantic = {i}) AS c{i}" for i in range(20))
    listed = f"[{', '.join(f'c{i}' for i in range(20))}]"
    top = f"list_max({listed})"
    return f"""
WITH p AS (SELECT *, CAST(round_even(mz * 100, 0) AS BIGINT) AS h FROM ({duck.keyed(source, grid)})), a AS (
  SELECT frame_id, level, ix, iy, count(*) AS point_count, count(*) FILTER (WHERE {g}) AS ground_count,
    count(*) FILTER (WHERE ground = 0) AS unknown_ground_count, count(*) FILTER (WHERE {o}) AS n_o,
    coalesce(min(h) FILTER (WHERE {g}), 0) AS g_low, coalesce(max(h) FILTER (WHERE {g}), 0) AS g_high,
    CAST(coalesce(sum(h) FILTER (WHERE {g}), 0) AS BIGINT) AS g_sum, CAST(coalesce(sum(h * h) FILTER (WHERE {g}), 0) AS BIGINT) AS g_sq,
    min(h) AS lo, max(h) AS hi, coalesce(min(h) FILTER (WHERE {o}), 0) AS o_lo, coalesce(max(h) FILTER (WHERE {o}), 0) AS o_hi,
    count(*) FILTER (WHERE motion = 1) AS n_still, count(*) FILTER (WHERE motion = 2) AS n_moving,
    count(*) FILTER (WHERE {k}) AS n_i, coalesce(sum(intensity) FILTER (WHERE {k}), 0) AS s_i, {counts}
  FROM p GROUP BY frame_id, level, ix, iy
), b AS (SELECT *, g_high - g_low AS span, (ground_count > 0 AND g_high - g_low > 50) AS amb,
  CAST(g_sum AS DOUBLE) / greatest(ground_count, 1) AS mean, {top} AS top FROM a)
SELECT frame_id, level, ix, iy, (ix + {num(0.5)}) * {duck.width(grid)} AS center_x_m, (iy + {num(0.5)}) * {duck.width(grid)} AS center_y_m,
  {duck.width(grid)} AS size_m, point_count, ground_count, unknown_ground_count,
  CAST(CASE WHEN ground_count > 0 AND NOT amb THEN round_even(mean, 0) ELSE 0 END AS INTEGER) AS ground_height_cm,
  (ground_count > 0 AND NOT amb) AS ground_valid, CAST(span AS INTEGER) AS ground_span_cm,
  round(greatest(CAST(g_sq AS DOUBLE) / greatest(ground_count, 1) - mean * mean, 0) / 10000 + {num(1e-11)}, 9) AS ground_spread_m2, amb AS ambiguous,
  CAST(lo AS INTEGER) AS observed_min_cm, CAST(hi AS INTEGER) AS observed_max_cm, CAST(o_lo AS INTEGER) AS obstacle_min_cm,
  CAST(o_hi AS INTEGER) AS obstacle_max_cm, n_o > 0 AS obstacle_valid,
  CAST(CASE WHEN len(list_filter({listed}, lambda c: c = top)) > 1 THEN 0 ELSE list_position({listed}, top) - 1 END AS INTEGER) AS semantic,
  array_to_string({listed}, ',') AS semantic_evidence, len(list_filter({listed}[2:20], lambda c: c > 0)) > 1 AS semantic_conflict,
  CAST(CASE WHEN n_moving > 0 THEN 2 WHEN n_still = point_count THEN 1 ELSE 0 END AS INTEGER) AS motion,
  round(s_i / greatest(n_i, 1), 6) AS intensity_mean, n_i > 0 AS intensity_valid
FROM b"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"ground_spread_m2": F.round(F.col("ground_spread_m2") + 1e-11, 9), "intensity_mean": F.round("intensity_mean", 6)})


@query(_snapshot_sql(view_sql("wide_points"), GRID))
def cell_snapshot(spark, sf_dir):
    return _rounded(cells.snapshot(cells.keyed(view(spark, sf_dir, "wide_points"), GRID), GRID))


@query(_snapshot_sql(view_sql("dense_points"), GRID))
def cell_snapshot_dense(spark, sf_dir):
    return _rounded(cells.snapshot(cells.keyed(view(spark, sf_dir, "dense_points"), GRID), GRID))


@query(_snapshot_sql(view_sql("wide_points"), SQUARE))
def cell_snapshot_square(spark, sf_dir):
    return _rounded(cells.snapshot(cells.keyed(view(spark, sf_dir, "wide_points"), SQUARE), SQUARE))


@query(f"SELECT frame_id, level, count(*) AS points, count(DISTINCT (ix, iy)) AS cells FROM ({duck.keyed(view_sql('wide_points'), GRID)}) GROUP BY frame_id, level")
def level_counts(spark, sf_dir):
    per = cells.keyed(view(spark, sf_dir, "wide_points"), GRID).groupBy("frame_id", "level", "ix", "iy").agg(F.count("*").alias("n"))
    return per.groupBy("frame_id", "level").agg(F.sum("n").alias("points"), F.count("*").alias("cells"))


_FINE = " UNION ALL ".join(
    f"SELECT f.frame_id, f.level AS fine, {k} AS coarse FROM c f JOIN c g ON f.frame_id = g.frame_id AND g.level = {k} AND f.level < {k} AND g.ix = "
    + "CASE " + " ".join(f"WHEN f.level = {j} THEN {duck.div('f.ix', GRID.ratios[k] // GRID.ratios[j])}" for j in range(k)) + " END AND g.iy = "
    + "CASE " + " ".join(f"WHEN f.level = {j} THEN {duck.div('f.iy', GRID.ratios[k] // GRID.ratios[j])}" for j in range(k)) + " END"
    for k in range(1, 3)
)


@query(f"WITH c AS (SELECT DISTINCT frame_id, level, ix, iy FROM ({duck.keyed(view_sql('wide_points'), GRID)})) SELECT CAST(count(*) AS BIGINT) AS overlaps FROM ({_FINE})")
def ancestor_overlap(spark, sf_dir):
    """Cells of two levels must not cover each other: a semi-join of each cell's ancestors with the cells (0 expected)."""
    c = cells.keyed(view(spark, sf_dir, "wide_points"), GRID).select("frame_id", "level", "ix", "iy").distinct()
    return contracts.covered_cells(c, GRID, "frame_id").agg(F.count("*").alias("overlaps"))


_KEY = f"(((ix + 33554432) << 26 | (iy + 33554432)) << 3 | level)"


@query(f"SELECT {_KEY} AS key, level, ix, iy, count(*) AS n FROM ({duck.keyed(view_sql('wide_points'), GRID)}) GROUP BY level, ix, iy")
def pack_unpack_keys(spark, sf_dir):
    c = cells.keyed(view(spark, sf_dir, "wide_points"), GRID)
    per = c.groupBy(lattice.pack(F.col("level"), F.col("ix"), F.col("iy")).alias("key")).agg(F.count("*").alias("n"))
    level, ix, iy = lattice.unpack(F.col("key"))
    return per.select("key", level.alias("level"), ix.alias("ix"), iy.alias("iy"), "n")


_LOW, _HIGH = math.radians(-24.8), math.radians(2.0)
_PIXELS = f"""SELECT *, range_m > 0 AND elevation BETWEEN {num(_LOW)} AND {num(_HIGH)} AS eligible,
  CAST(greatest(least(floor(({num(_HIGH)} - elevation) / {num(_HIGH - _LOW)} * 64), 63), 0) AS INTEGER) AS pixel_row,
  CAST(floor((azimuth + {num(math.pi)}) / {num(2 * math.pi)} * 1024) % 1024 AS INTEGER) AS pixel_col
  FROM (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS range_m, atan2(mz, sqrt(mx*mx + my*my)) AS elevation, atan2(my, mx) AS azimuth FROM ({view_sql('returns')}))"""


def _returns_sensor(spark, sf_dir):
    return view(spark, sf_dir, "returns").withColumns({"x": F.col("mx"), "y": F.col("my"), "z": F.col("mz")})


@query(f"""SELECT frame_id, pixel_row, pixel_col, round(range_m, 9) AS range_m, point_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, pixel_row, pixel_col ORDER BY range_m, point_id) AS rn
  FROM ({_PIXELS}) WHERE eligible) WHERE rn = 1""")
def range_image(spark, sf_dir):
    return range_view.range_image(_returns_sensor(spark, sf_dir), GRID).withColumn("range_m", F.round("range_m", 9))


@query(f"""SELECT frame_id, count(DISTINCT CASE WHEN eligible THEN pixel_row * 1024 + pixel_col END) AS filled,
  count(*) FILTER (WHERE eligible) - count(DISTINCT CASE WHEN eligible THEN pixel_row * 1024 + pixel_col END) AS collisions,
  count(*) FILTER (WHERE NOT eligible) AS outside FROM ({_PIXELS}) GROUP BY frame_id""")
def range_summary(spark, sf_dir):
    return range_view.range_summary(_returns_sensor(spark, sf_dir), GRID)


_PACKED = "SELECT l_orderkey, l_linenumber, (l_partkey % 65536) * 65536 + l_suppkey % 260 AS packed FROM lineitem"
_TABLE = ", ".join(f"({r}, {c})" for r, c in labels.CLASS_OF_RAW.items())


@query(f"""SELECT t.packed & 65535 AS raw, CAST(coalesce(m.cls, -1) AS INTEGER) AS semantic,
  CAST(CASE WHEN t.packed & 65535 BETWEEN 252 AND 259 THEN 2 WHEN m.cls = 0 THEN 0 ELSE 1 END AS INTEGER) AS motion,
  count(*) AS n, CAST(sum(t.packed >> 16) AS BIGINT) AS instances FROM ({_PACKED}) t LEFT JOIN (VALUES {_TABLE}) m(raw, cls) ON t.packed & 65535 = m.raw GROUP BY 1, 2, 3""")
def label_decode(spark, sf_dir):
    packed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(((F.col("l_partkey") % 65536) * 65536 + F.col("l_suppkey") % 260).alias("packed"))
    parts = labels.decode(F.col("packed"))
    out = packed.select(F.col("packed").bitwiseAND(F.lit(65535)).alias("raw"), *(F.coalesce(c, F.lit(-1)).alias(n) if n == "semantic" else c.alias(n) for n, c in parts.items()))
    return out.groupBy("raw", "semantic", "motion").agg(F.count("*").alias("n"), F.sum("instance").alias("instances"))


@query(f"""SELECT frame_id, point_id, CAST(list_extract([{', '.join(map(str, labels.RAW_OF_CLASS))}], semantic + 1) AS BIGINT) AS raw FROM ({view_sql('returns')}) WHERE abs(mx) < 30
  UNION ALL SELECT frame_id, point_id, 0 FROM ({view_sql('returns')}) WHERE NOT abs(mx) < 30""")
def prediction_export(spark, sf_dir):
    """Labels of all input points in input order; points that no gate accepted are 0."""
    points = view(spark, sf_dir, "returns")
    kept = points.where(F.abs("mx") < 30).select("frame_id", "point_id", labels.raw_of_class(F.col("semantic")).cast("long").alias("raw"))
    return points.select("frame_id", "point_id").join(kept, ["frame_id", "point_id"], "left").withColumn("raw", F.coalesce("raw", F.lit(0).cast("long")))


@query(f"""SELECT frame_id, CAST(coalesce(semantic, -1) AS INTEGER) AS semantic, count(*) AS points, CAST(sum(CASE WHEN ground = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ground_points
  FROM ({view_sql('dense_points')}) GROUP BY GROUPING SETS ((frame_id, semantic), (frame_id))""")
def semantic_histogram(spark, sf_dir):
    points = view(spark, sf_dir, "dense_points")
    out = points.groupingSets([["frame_id", "semantic"], ["frame_id"]], "frame_id", "semantic").agg(F.count("*").alias("points"), F.count_if(F.col("ground") == 1).alias("ground_points"))
    return out.withColumn("semantic", F.coalesce("semantic", F.lit(-1)))


@query(f"""WITH a AS (SELECT DISTINCT frame_id, level, ix, iy FROM ({duck.keyed(view_sql('wide_points'), GRID)})), u AS (SELECT DISTINCT frame_id, {duck.base('mx')} AS x, {duck.base('my')} AS y FROM ({view_sql('wide_points')}))
  SELECT a.frame_id, a.n AS adaptive_cells, u.n AS uniform_cells, round(1 - a.n / CAST(u.n AS DOUBLE), 6) AS saved
  FROM (SELECT frame_id, count(*) AS n FROM a GROUP BY frame_id) a JOIN (SELECT frame_id, count(*) AS n FROM u GROUP BY frame_id) u ON a.frame_id = u.frame_id""")
def adaptive_vs_uniform(spark, sf_dir):
    k = cells.keyed(view(spark, sf_dir, "wide_points"), GRID)
    a = k.groupBy("frame_id", "level", "ix", "iy").count().groupBy("frame_id").agg(F.count("*").alias("adaptive_cells"))
    u = k.groupBy("frame_id", "bx", "by").count().groupBy("frame_id").agg(F.count("*").alias("uniform_cells"))
    return a.join(u, "frame_id").withColumn("saved", F.round(1 - F.col("adaptive_cells") / F.col("uniform_cells"), 6))
