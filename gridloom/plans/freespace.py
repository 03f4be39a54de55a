"""Queries of free space, occupancy, components and panoptic export."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.config import FreeSpace, Grid
from gridloom.functions.labels import RAW_OF_CLASS
from gridloom.functions.lattice import d
from gridloom.operators import cells, components, freespace
from gridloom.plans import duck
from gridloom.plans.duck import num
from gridloom.plans.views import view, view_sql

GRID, FREE = Grid(), FreeSpace()
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scan(spark, sf_dir):
    """The returns with sensor height 0 and range, parted into obstacle, clean and doubtful."""
    p = view(spark, sf_dir, "returns").withColumn("sz", d(0))
    p = p.withColumn("range_m", F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")))
    return freespace.partition_points(p)


_SCAN = f"SELECT *, ground = 2 AS obstacle, ground = 1 AND semantic IN (9, 10, 11, 12, 17) AS clean, NOT (ground = 2) AND NOT (ground = 1 AND semantic IN (9, 10, 11, 12, 17)) AS doubtful, {num(0.0)} AS sz, sqrt(mx*mx + my*my + mz*mz) AS range_m FROM ({view_sql('returns')})"
_BEAM = f"""SELECT *, greatest(0, 1 - least({num(5.0)}, {num(0.1)} * dist / dropped) / dist) AS fraction FROM (
  SELECT *, mx - sx AS dx, my - sy AS dy, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) AS dist, sz - mz AS dropped FROM ({_SCAN}) WHERE clean AND range_m >= {num(2.7)}) WHERE dist > 0 AND dropped > 0"""
_SAMPLES = f"""SELECT frame_id, point_id, sx, sy, sx + u * dx AS mx, sy + u * dy AS my FROM (
  SELECT *, fraction + k * {num(0.025)} / dist AS u FROM (SELECT *, unnest(range(CAST(ceil(dist * (1 - fraction) / {num(0.025)}) AS BIGINT))) AS k FROM ({_BEAM}))) WHERE u < 1"""
_W = duck.width(GRID)
_CORRIDOR = f"""SELECT frame_id, level, ix, iy, count(DISTINCT point_id) AS ray_support, min(point_id) AS beam_point_id FROM (SELECT *, {_W} AS w FROM ({duck.keyed(_SAMPLES, GRID)}))
  WHERE mx - ix * w > {num(1e-6)} AND ix * w + w - mx > {num(1e-6)} AND my - iy * w > {num(1e-6)} AND iy * w + w - my > {num(1e-6)} GROUP BY frame_id, level, ix, iy"""
_OWN = f"SELECT frame_id, level, ix, iy FROM ({duck.keyed(view_sql('returns'), GRID)})"
_PLAIN = " UNION ALL ".join(f"SELECT frame_id, {k}, CAST(floor(mx / {num(w)}) AS BIGINT), CAST(floor(my / {num(w)}) AS BIGINT) FROM ({view_sql('returns')})" for k, w in enumerate(GRID.widths_m))
_BAD = f"SELECT frame_id, {duck.base('mx')} AS ux, {duck.base('my')} AS uy FROM ({_SCAN}) WHERE NOT clean"
_STEPS = [math.ceil(FREE.margin_m / w) + 1 for w in GRID.widths_m]
_NEAR = " UNION ALL ".join(
    f"SELECT DISTINCT frame_id, {k} AS level, x + i AS ix, y + j AS iy FROM (SELECT DISTINCT frame_id, {duck.div('ux', r)} AS x, {duck.div('uy', r)} AS y FROM ({_BAD})), range(-{s}, {s} + 1) a(i), range(-{s}, {s} + 1) b(j)"
    for k, (r, s) in enumerate(zip(GRID.ratios, _STEPS))
)
_FREE_SQL = f"""WITH c AS MATERIALIZED ({_CORRIDOR}), o AS MATERIALIZED (({_OWN}) UNION ({_PLAIN})), n AS MATERIALIZED ({_NEAR})
SELECT c.frame_id, c.level, c.ix, c.iy, c.ray_support, c.beam_point_id FROM c ANTI JOIN o ON c.frame_id = o.frame_id AND c.level = o.level AND c.ix = o.ix AND c.iy = o.iy
ANTI JOIN n ON c.frame_id = n.frame_id AND c.level = n.level AND c.ix = n.ix AND c.iy = n.iy"""


@query(_CORRIDOR)
def corridor_cells(spark, sf_dir):
    return freespace.corridor_cells(freespace.beams(scan(spark, sf_dir), GRID, FREE), GRID, FREE)


@query(f"WITH c AS MATERIALIZED ({_CORRIDOR}), o AS MATERIALIZED (({_OWN}) UNION ({_PLAIN})) SELECT c.* FROM c ANTI JOIN o ON c.frame_id = o.frame_id AND c.level = o.level AND c.ix = o.ix AND c.iy = o.iy")
def occupied_antijoin(spark, sf_dir):
    p = scan(spark, sf_dir)
    return freespace.corridor_cells(freespace.beams(p, GRID, FREE), GRID, FREE).join(freespace.occupied_keys(p, GRID), list(freespace.CELL), "left_anti")


@query(f"SELECT frame_id, CAST(level AS INTEGER) AS level, count(*) AS cells, CAST(sum(ix) AS BIGINT) AS sx, CAST(sum(iy) AS BIGINT) AS sy FROM ({_NEAR}) GROUP BY frame_id, level")
def margin_band(spark, sf_dir):
    return freespace.near_conflicts(scan(spark, sf_dir), GRID, FREE).groupBy("frame_id", "level").agg(F.count("*").alias("cells"), F.sum("ix").alias("sx"), F.sum("iy").alias("sy"))


@query(_FREE_SQL)
def margin_band_antijoin(spark, sf_dir):
    return freespace.free_cells(scan(spark, sf_dir), GRID, FREE).drop("rejected")


@query(f"SELECT frame_id, level, ix, iy, ray_support, beam_point_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY level, ix, iy) AS rn FROM ({_FREE_SQL})) WHERE rn <= 300")
def free_cells_limited(spark, sf_dir):
    """A frame's free cells up to a cap of 300, in (level, ix, iy) order."""
    return freespace.free_cells(scan(spark, sf_dir), GRID, FreeSpace(max_cells=300)).drop("rejected")


_OCC = f"""SELECT frame_id, level, ix, iy, count(*) FILTER (WHERE obstacle) AS obstacle_support,
  CAST(CASE WHEN count(*) FILTER (WHERE obstacle) = 0 AND count(*) FILTER (WHERE doubtful) > 0 THEN 4 WHEN count(*) FILTER (WHERE obstacle) > 0 THEN 1 ELSE 0 END AS INTEGER) AS occupancy
  FROM ({duck.keyed(_SCAN, GRID)}) GROUP BY frame_id, level, ix, iy"""


def _occupancy(spark, sf_dir):
    p = scan(spark, sf_dir)
    observed = cells.keyed(p, GRID).groupBy(*freespace.CELL).agg(F.lit(False).alias("ambiguous"))
    return freespace.occupancy(p, observed, GRID)


@query(_OCC)
def cell_occupancy(spark, sf_dir):
    return _occupancy(spark, sf_dir)


@query(f"""WITH f AS MATERIALIZED ({_FREE_SQL}), o AS MATERIALIZED ({_OCC}), b AS ({_BEAM})
SELECT fr.frame_id, (SELECT count(*) FROM b WHERE b.frame_id = fr.frame_id) AS qualifying_beams, (SELECT count(*) FROM f WHERE f.frame_id = fr.frame_id) AS free_cells,
 (SELECT count(*) FROM o WHERE o.frame_id = fr.frame_id AND occupancy = 1) AS occupied_cells, (SELECT count(*) FROM o WHERE o.frame_id = fr.frame_id AND occupancy = 4) AS ambiguous_cells,
 (SELECT count(*) FROM o WHERE o.frame_id = fr.frame_id AND occupancy = 0) AS unknown_cells FROM (SELECT DISTINCT frame_id FROM o) fr""")
def visibility_summary(spark, sf_dir):
    p = scan(spark, sf_dir)
    n = freespace.beams(p, GRID, FREE).groupBy("frame_id").agg(F.count("*").alias("qualifying_beams"))
    per = freespace.published(_occupancy(spark, sf_dir), freespace.free_cells(p, GRID, FREE)).groupBy("frame_id")
    state = lambda s: F.count_if(F.col("occupancy") == s)
    out = per.agg(state(freespace.FREE).alias("free_cells"), state(freespace.OCCUPIED).alias("occupied_cells"), state(freespace.AMBIGUOUS).alias("ambiguous_cells"), state(freespace.UNKNOWN).alias("unknown_cells"))
    return out.join(n, "frame_id", "left").fillna(0, ["qualifying_beams"]).select("frame_id", "qualifying_beams", "free_cells", "occupied_cells", "ambiguous_cells", "unknown_cells")


@query(f"""WITH f AS MATERIALIZED ({_FREE_SQL}), o AS MATERIALIZED ({_OCC})
SELECT frame_id, level, ix, iy, occupancy, obstacle_support, 0 AS ray_support, -1 AS beam_point_id FROM o
UNION ALL SELECT frame_id, level, ix, iy, 2, 0, ray_support, beam_point_id FROM f""".replace("0 AS ray_support, -1 AS", "CAST(0 AS BIGINT) AS ray_support, CAST(-1 AS BIGINT) AS"))
def published_cells(spark, sf_dir):
    return freespace.published(_occupancy(spark, sf_dir), freespace.free_cells(scan(spark, sf_dir), GRID, FREE))


@query(f"""WITH f AS MATERIALIZED ({_FREE_SQL}), v AS ({_SCAN})
SELECT f.frame_id, f.level, f.ix, f.iy, f.beam_point_id, round(v.mz, 6) AS return_z_m FROM f JOIN v ON f.frame_id = v.frame_id AND f.beam_point_id = v.point_id WHERE f.frame_id % 2 = 0""")
def free_cell_export(spark, sf_dir):
    """Every second frame's free cells with the height of the beam that proves each."""
    p = scan(spark, sf_dir)
    f = freespace.free_cells(p, GRID, FREE).where("frame_id % 2 = 0").drop("ray_support", "rejected")
    z = p.select("frame_id", F.col("point_id").alias("beam_point_id"), F.round("mz", 6).alias("return_z_m"))
    return f.join(z, ["frame_id", "beam_point_id"])


# ---------------------------------------------------------------- components

_VOX = f"""SELECT *, CAST(CASE WHEN semantic IN (1,2,3,4,5,6,7,8,18,19) THEN semantic ELSE 0 END AS INTEGER) AS grp,
  CAST(floor(mx / {num(0.45)}) AS BIGINT) AS vx, CAST(floor(my / {num(0.45)}) AS BIGINT) AS vy, CAST(floor(mz / {num(0.45)}) AS BIGINT) AS vz
  FROM (SELECT * REPLACE (mx / 8 AS mx, my / 8 AS my) FROM ({view_sql('returns')})) WHERE ground <> 1 OR semantic IN (1,2,3,4,5,6,7,8,18,19)"""
_COMPONENTS = f"""WITH RECURSIVE p AS MATERIALIZED ({_VOX}), c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY frame_id, grp, vx, vy, vz) AS id FROM (SELECT DISTINCT frame_id, grp, vx, vy, vz FROM p)),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.frame_id = b.frame_id AND a.grp = b.grp AND b.vx BETWEEN a.vx - 1 AND a.vx + 1 AND b.vy BETWEEN a.vy - 1 AND a.vy + 1 AND b.vz BETWEEN a.vz - 1 AND a.vz + 1 WHERE a.id <> b.id),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE r.root < e.b),
l AS (SELECT id, min(root) AS component FROM r GROUP BY id),
g AS (SELECT p.frame_id, l.component, min(p.grp) AS semantic, avg(score) AS sc, min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1, min(mz) AS z0, max(mz) AS z1, list_sort(list(point_id)) AS ids
  FROM p JOIN c USING (frame_id, grp, vx, vy, vz) JOIN l USING (id) GROUP BY p.frame_id, l.component)"""


def _near_returns(spark, sf_dir):
    """The returns drawn together eightfold, so that voxels have neighbours."""
    return view(spark, sf_dir, "returns").withColumns({"mx": F.col("mx") / 8, "my": F.col("my") / 8})


def _candidates(spark, sf_dir):
    p = _near_returns(spark, sf_dir)
    return p, components.candidates(p, components.label_by_frame(components.voxels(p)))


@query(_COMPONENTS + """SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY ids[1]) - 1 AS INTEGER) AS instance_id, CAST(semantic AS INTEGER) AS semantic,
  round(CASE WHEN semantic > 0 THEN sc ELSE 0 END, 9) AS score, round((x0 + x1) / 2, 6) AS center_x, round((y0 + y1) / 2, 6) AS center_y, round((z0 + z1) / 2, 6) AS center_z,
  array_to_string(ids, ',') AS point_ids, CASE WHEN semantic = 0 OR len(ids) < 3 THEN 'ambiguous' ELSE 'observed' END AS status FROM g""")
def obstacle_candidates(spark, sf_dir):
    _, c = _candidates(spark, sf_dir)
    return c.select("frame_id", "instance_id", "semantic", F.round("score", 9).alias("score"), *(F.round(f"center_{a}", 6).alias(f"center_{a}") for a in "xyz"), F.array_join(F.col("point_ids").cast("array<string>"), ",").alias("point_ids"), "status")


@query(_COMPONENTS + """SELECT frame_id, semantic, count(*) AS components, CAST(sum(n) AS BIGINT) AS voxels, max(n) AS largest FROM (
  SELECT c.frame_id, c.grp AS semantic, l.component, count(*) AS n FROM c JOIN l USING (id) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def components_distributed(spark, sf_dir):
    """The same components by DataFrame rounds, for frames that fit no task."""
    v = components.voxels(_near_returns(spark, sf_dir)).withColumn("grp", F.col("grp").cast("int"))
    sc = spark.sparkContext
    if not sc.getCheckpointDir():  # the folder the cluster names; one of its own only where Spark runs in one process
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local-cluster") and sc.master.startswith("local"):
            import tempfile

            at = tempfile.mkdtemp(prefix="gridloom-")
        if not at:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(at)
    per = components.label_distributed(v).groupBy("frame_id", F.col("grp").alias("semantic"), "component").agg(F.count("*").alias("n"))
    return per.groupBy("frame_id", "semantic").agg(F.count("*").alias("components"), F.sum("n").alias("voxels"), F.max("n").alias("largest"))


@query(_COMPONENTS + f""", i AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY ids[1]) AS n, semantic, unnest(ids) AS point_id FROM g)
SELECT v.frame_id, v.point_id, CASE WHEN abs(v.mx) < 30 THEN CAST(list_extract([{', '.join(map(str, RAW_OF_CLASS))}], v.semantic + 1) AS BIGINT) ELSE 0 END
  | CASE WHEN i.semantic BETWEEN 1 AND 8 THEN CAST(i.n << 16 AS BIGINT) ELSE 0 END AS raw FROM ({view_sql('returns')}) v LEFT JOIN i ON v.frame_id = i.frame_id AND v.point_id = i.point_id""")
def panoptic_labels(spark, sf_dir):
    _, c = _candidates(spark, sf_dir)
    points = view(spark, sf_dir, "returns")
    return components.panoptic(points, points.where(F.abs("mx") < 30), c)
