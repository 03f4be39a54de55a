"""Authored scenes: free space, obstacle candidates, panoptic labels."""

import pytest
from pyspark.sql import functions as F

from gridloom.config import FreeSpace, Grid
from gridloom.functions.lattice import d
from gridloom.operators import cells, components, contracts, freespace

GRID, FREE = Grid(), FreeSpace()


def scene(spark, pts):
    rows = [(0, i, *map(float, p[:3]), *p[3:], 0.0, 0.0, 0.0) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, mx double, my double, mz double, semantic int, ground int, sx double, sy double, sz double")
    return freespace.partition_points(df.withColumn("range_m", F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))))


def free(spark, pts, **kw):
    return {(r.level, r.ix, r.iy) for r in freespace.free_cells(scene(spark, pts), GRID, FreeSpace(**kw)).collect()}


BEAM = (20.02, 0.03, -1.73, 9, 1)


def test_one_ground_beam(spark):
    p = scene(spark, [BEAM])
    got = freespace.free_cells(p, GRID, FREE).collect()
    assert {(r.level, r.ix, r.iy) for r in got} == {(1, x, 0) for x in range(188, 200)}
    assert {(r.ray_support, r.beam_point_id) for r in got} == {(1, 0)}
    observed = cells.keyed(p, GRID).select("frame_id", "level", "ix", "iy", F.lit(False).alias("ambiguous"))
    assert [(r.level, r.ix, r.iy, r.occupancy) for r in freespace.occupancy(p, observed, GRID).collect()] == [(1, 200, 0, freespace.UNKNOWN)]
    beams = freespace.beams(p, GRID, FREE)
    assert contracts.unsupported_free(freespace.free_cells(p, GRID, FREE), beams, GRID).count() == 0


def test_a_pole_takes_its_margin(spark):
    assert free(spark, [BEAM, (19.5, 0.35, 0.0, 18, 2)]) == {(1, x, 0) for x in (188, 189, 190)}


def test_near_and_far_levels(spark):
    assert free(spark, [(3.02, 0.03, -1.73, 9, 1)]) == {(0, x, 0) for x in range(56, 60)}
    assert free(spark, [(90.2, 0.03, -1.73, 9, 1)]) == {(2, x, 0) for x in range(170, 180)}


def test_cap_keeps_the_first_cells(spark):
    assert free(spark, [BEAM], max_cells=3) == {(1, 188, 0), (1, 189, 0), (1, 190, 0)}


def test_cells_beyond_the_cap_are_counted(spark):
    for cap, rejected in ((3, 9), (12, 0), (20, 0)):
        got = freespace.free_cells(scene(spark, [BEAM]), GRID, FreeSpace(max_cells=cap)).collect()
        assert {r.rejected for r in got} == {rejected} and len(got) == 12 - rejected


@pytest.mark.parametrize("pt", [(20.02, 0.03, -1.73, 13, 1), (20.02, 0.03, -1.73, 9, 2), (20.02, 0.03, -1.73, 0, 1), (2.0, 0.03, -1.0, 9, 1), (20.02, 0.03, 1.0, 9, 1), (20.02, 0.03, -1.73, 9, 0)])
def test_never_free(spark, pt):
    assert free(spark, [pt]) == set()


def test_contract_finds_forged_cells(spark):
    p = scene(spark, [BEAM])
    beams = freespace.beams(p, GRID, FREE)
    forged = spark.createDataFrame([(0, 1, 190, 5, 1, 0), (0, 1, 200, 0, 1, 0), (0, 1, 190, 0, 1, 9), (0, 1, 191, 0, 0, 0), (0, 1, 192, 0, 1, 0)], "frame_id long, level int, ix long, iy long, ray_support long, beam_point_id long")
    bad = {(r.ix, r.iy) for r in contracts.unsupported_free(forged, beams, GRID).collect()}
    assert bad == {(190, 5), (200, 0), (190, 0), (191, 0)}
    near = spark.createDataFrame([(0, 19.35, 0.3)], "frame_id long, mx double, my double")
    assert {r.ix for r in contracts.margin_breaches(forged, near, GRID, 0.3).collect()} == {191, 192}


def observations(spark):
    labels = [1] * 6 + [18] * 2 + [0] * 2 + [13] * 2
    xs = [0, 0.4, 0.8, 10, 10.4, 10.8, 20, 20.4, 30, 30.4, 40, 40.4]
    rows = [(0, 20 + i, float(x), 0.0, 0.0, 2, s, 0.5) for i, (x, s) in enumerate(zip(xs, labels))]
    return spark.createDataFrame(rows, "frame_id long, point_id long, mx double, my double, mz double, ground int, semantic int, score double")


def test_candidates(spark):
    p = observations(spark)
    got = components.candidates(p, components.label_by_frame(components.voxels(p))).orderBy("instance_id").collect()
    assert [(r.semantic, r.point_ids, r.status) for r in got] == [
        (1, [20, 21, 22], "observed"), (1, [23, 24, 25], "observed"), (18, [26, 27], "ambiguous"), (0, [28, 29], "ambiguous"), (0, [30, 31], "ambiguous")
    ]
    assert got[0].score == 0.5 and got[4].score == 0.0
    raw = {r.point_id: r.raw for r in components.panoptic(p, p.where("point_id < 31"), components.candidates(p, components.label_by_frame(components.voxels(p)))).collect()}
    assert raw[20] == 10 | 1 << 16 and raw[23] == 10 | 2 << 16 and raw[26] == 80 and raw[28] == 0 and raw[30] == 50 and raw[31] == 0


def test_both_component_ways_agree(spark):
    df = spark.range(400).select(d(0).cast("long").alias("frame_id"), F.col("id").alias("point_id"), ((F.col("id") * 37 % 100) / 8).alias("mx"), ((F.col("id") * 53 % 90) / 8).alias("my"), d(0.1).alias("mz"), F.lit(2).alias("ground"), (F.col("id") % 2).cast("int").alias("semantic"))
    v = components.voxels(df).withColumn("grp", F.col("grp").cast("int"))
    sets = []
    for labelled in (components.label_by_frame(v), components.label_distributed(v)):
        groups = {}
        for r in labelled.collect():
            groups.setdefault((r.grp, str(r.component)), set()).add((r.grp, r.vx, r.vy, r.vz))
        sets.append({frozenset(g) for g in groups.values()})
    assert sets[0] == sets[1] and len(sets[0]) > 1


def test_receipts(spark):
    rows = [(f, i, float(i) / 3) for f in range(3) for i in range(5)]
    make = lambda r: spark.createDataFrame(r, "frame_id long, point_count long, v double")
    rules = {"support": F.col("point_count") > 10}
    one = {r.frame_id: r for r in contracts.receipts(make(rows), contracts.violations(make(rows), rules, "frame_id"), "frame_id").collect()}
    back = make(rows[::-1]).repartition(3)
    two = {r.frame_id: r for r in contracts.receipts(back, contracts.violations(back, rules, "frame_id"), "frame_id").collect()}
    assert one == two and all(r.status == "accepted" and r.rows == 5 for r in one.values())
    other = make([*rows[:-1], (2, 11, 0.5)])
    three = {r.frame_id: r for r in contracts.receipts(other, contracts.violations(other, rules, "frame_id"), "frame_id").collect()}
    assert three[0] == one[0] and (three[2].status, three[2].error, three[2].digest) == ("rejected", "support", None)


def test_forged_terrain_and_overlaps_are_found(spark):
    from gridloom.config import Fusion

    good = (1, 0, 0, 9, True, 0.05, -1.7, 10_000_000_000)
    forged = {
        "range": (7, 0, 0, 9, True, 0.05, 0.0, good[7]), "time": (*good[:7], 10_000_000_001), "valid": (0, 0, 0, 9, True, 0.5, 0.0, good[7]),
        "height": (0, 0, 0, 9, False, -1.0, 3.0, good[7]), "stale": (*good[:7], 1), "drivable": (1, 0, 1, 9, True, 0.05, 0.0, good[7]),
    }
    schema = "terrain int, occupancy int, flags int, semantic int, ground_valid boolean, ground_sigma_m double, ground_height_m double, last_seen long"
    rules = contracts.terrain_rules(Fusion(), F.lit(10_000_000_000))
    broken = lambda row: {r.rule for r in contracts.violations(spark.createDataFrame([row], schema), rules).collect() if r.broken}
    assert broken(good) == set()
    for rule, row in forged.items():
        assert rule in broken(row), rule
    c = spark.createDataFrame([(0, 0, 3, 3), (0, 1, 1, 1), (0, 1, 5, 5), (0, 1, 5, 5), (0, 2, 9, 9)], "frame_id long, level int, ix long, iy long")
    assert [(r.level, r.ix) for r in contracts.covered_cells(c, GRID, "frame_id").collect()] == [(0, 3)]
    assert [(r.level, r.ix, r.n) for r in contracts.repeated_cells(c, "frame_id").collect()] == [(1, 5, 2)]
