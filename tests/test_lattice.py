import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import Grid, Settings, load, load_run
from gridloom.functions import lattice
from gridloom.functions.lattice import d
from gridloom.operators import cells, contracts, gates

GRID = Grid()
SQUARE = Grid(sizes_cm=(5, 10, 20, 40), radii_m=(10.0, 25.0, 50.0, 100.0), footprint="square")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cell_borders(spark):
    e = [math.nextafter(-0.05, -math.inf), -0.05, math.nextafter(-0.05, math.inf), math.nextafter(0.05, -math.inf), 0.05, math.nextafter(0.05, math.inf)]
    df = frame(spark, [(i, x) for i, x in enumerate(e)], "i int, x double").select("i", lattice.base_index(F.col("x")).alias("b")).orderBy("i")
    assert [r.b for r in df.collect()] == [-2, -1, -1, 0, 1, 1]


def test_division_rounds_down(spark):
    rows = [(int(b),) for b in range(-25, 26)] + [(s * (k + e),) for s in (-1, 1) for k in (1 << 25, 10**9, 10**12) for e in range(-11, 12)]
    df = frame(spark, rows, "b long").select("b", *(lattice.floor_div(F.col("b"), r).alias(f"r{r}") for r in (1, 2, 8, 10)))
    assert all(row[f"r{r}"] == row.b // r for row in df.collect() for r in (1, 2, 8, 10))


def owner(x, y, sx, sy, grid):
    bx, by = math.floor(x / 0.05), math.floor(y / 0.05)
    level = len(grid.ratios) - 1
    while level > 0:
        w, r = grid.widths_m[level], grid.ratios[level]
        lx, ly = bx // r * w, by // r * w
        dx, dy = max(lx - sx, sx - (lx + w), 0), max(ly - sy, sy - (ly + w), 0)
        near = math.sqrt(dx * dx + dy * dy) if grid.footprint == "radial" else max(dx, dy)
        if not near < grid.radii_m[level - 1]:
            break
        level -= 1
    return level, bx // grid.ratios[level], by // grid.ratios[level]


@pytest.mark.parametrize("grid", [GRID, SQUARE])
def test_owners_equal_a_scalar_twin_and_never_overlap(spark, grid):
    rng = np.random.default_rng(0)
    pts = [(float(x), float(y), 0.027, -0.038, 0) for x, y in rng.uniform(-100, 100, (4000, 2))]
    k = cells.keyed(frame(spark, pts, "mx double, my double, sx double, sy double, frame_id long"), grid)
    for r in k.collect():
        assert (r.level, r.ix, r.iy) == owner(r.mx, r.my, r.sx, r.sy, grid)
    c = k.select("frame_id", "level", "ix", "iy").distinct()
    assert contracts.covered_cells(c, grid, "frame_id").count() == 0


def test_keys_round_trip(spark):
    rows = [(k, x, y) for k in (0, 3, 7) for x in (-(1 << 25) + 1, -1, 0, 5, (1 << 25) - 1) for y in (-3, 0, 9)]
    key = lattice.pack(F.col("level"), F.col("ix"), F.col("iy"))
    df = frame(spark, rows, "level int, ix long, iy long").withColumn("key", key)
    level, ix, iy = lattice.unpack(F.col("key"))
    got = df.select("level", "ix", "iy", "key", level.alias("a"), ix.alias("b"), iy.alias("c")).collect()
    assert all((r.level, r.ix, r.iy) == (r.a, r.b, r.c) for r in got)
    assert len({r.key for r in got}) == len(rows)


def test_distance_ahead(spark):
    """Against a dense sampling of the block's part ahead."""
    rng = np.random.default_rng(1)
    for _ in range(12):
        lx, ly = rng.uniform(-3, 3, 2)
        a = rng.uniform(0, 2 * math.pi)
        hx, hy, stretch = math.cos(a), math.sin(a), 1 + rng.uniform(0, 1)
        df = spark.range(1).select(lattice.forward_distance(d(lx), d(ly), 0.5, d(0.1), d(-0.2), d(hx), d(hy), d(stretch)).alias("v"))
        t = np.linspace(0, 0.5, 201)
        x, y = np.meshgrid(lx + t - 0.1, ly + t + 0.2)
        ahead = x * hx + y * hy
        norm = np.sqrt(np.maximum((x * hx + y * hy) ** 2 / stretch**2 + (-x * hy + y * hx) ** 2, 0))
        want = norm[ahead >= 0].min() if (ahead >= 0).any() else math.inf
        got = df.first().v
        assert (math.isinf(want) and (math.isinf(got) or got > 0)) or abs(got - want) < 0.01


IDENTITY = [float(i % 5 == 0) for i in range(16)]


def test_each_point_has_one_fate(spark):
    pts = [(math.nan, 0, 0), (math.inf, 0, 0), (101.0, 0, 0), (1.0, 0, 11.0), (0.0, 0, 0)]
    df = frame(spark, [(0, *map(float, p), IDENTITY, 0.0, 0.0) for p in pts], "frame_id long, x double, y double, z double, pose array<double>, sx double, sy double")
    r = gates.accounting(df, Grid(max_abs_height_m=10.0)).first()
    assert (r.n_input, r.n_invalid, r.n_outside, r.n_high, r.n_accepted) == (5, 3, 1, 1, 0)


def test_pose_checks(spark):
    bad = [2.0, *IDENTITY[1:]]
    mirrored = [-1.0, *IDENTITY[1:]]
    last = [*IDENTITY[:15], 1.1]
    df = frame(spark, [(i, p) for i, p in enumerate([IDENTITY, bad, mirrored, last, IDENTITY[:12]])], "i int, pose array<double>")
    assert [r.ok for r in df.orderBy("i").select(gates.pose_is_valid(F.col("pose")).alias("ok")).collect()] == [True, False, False, False, False]


def test_snapshot_values(spark):
    pts = [(5.01, 0.01, -1.73, 0.2, 1, 9, 1), (5.02, 0.01, -1.73, 0.8, 1, 9, 1), (30.0, 0.0, 0.0, math.nan, 0, 1, 2), (50.0, 1.0, -2.0, 0.0, 1, 9, 1), (50.0, 1.0, -1.1, 0.0, 1, 13, 1)]
    df = frame(spark, [(0, *map(float, p[:4]), *p[4:], 0.0, 0.0) for p in pts], "frame_id long, mx double, my double, mz double, intensity double, ground int, semantic int, motion int, sx double, sy double")
    a, b, c = cells.snapshot(cells.keyed(df, GRID), GRID).orderBy("level", "ix").collect()
    assert (a.point_count, a.size_m, a.ground_valid, a.ground_height_cm, a.semantic, a.motion, a.intensity_mean) == (2, 0.05, True, -173, 9, 1, 0.5)
    assert (b.point_count, b.size_m, b.ground_valid, b.ground_height_cm, b.motion, b.intensity_valid) == (1, 0.5, False, 0, 2, False)
    assert (c.ambiguous, c.ground_span_cm, c.ground_valid, c.semantic, c.semantic_conflict) == (True, 90, False, 0, True)
    assert abs(c.ground_spread_m2 - 0.2025) < 1e-12


def test_settings(tmp_path):
    p = tmp_path / "s.toml"
    p.write_text('[grid]\nsizes_cm = [5, 10, 20, 40]\nradii_m = [10, 25, 50, 100]\nfootprint = "square"\n')
    assert load(p).grid.ratios == (1, 2, 4, 8)
    for text in ("[grid]\nwidth = 3\n", "[other]\n", '[grid]\nfootprint = "round"\n', "[grid]\nsizes_cm = [5, 12, 50]\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            load(p)
    assert Settings().tracking.capacity == 512


def test_defaults_and_flat_files(tmp_path):
    g = Settings().grid
    assert (g.max_abs_coordinate_m, g.max_abs_height_m, g.fov_down_deg, g.fov_up_deg, g.max_points, g.sensor_height_m, g.frame_budget_ms, g.foveated) == (1e6, 1e4, -24.8, 2.0, 150_000, 1.73, 100.0, False)
    p = tmp_path / "flat.toml"
    p.write_text("cell_sizes_cm = [5, 10, 20, 40]\nradii_m = [10.0, 25.0, 50.0, 100.0]\nfootprint = \"square\"\nprojection_rows = 32\nfoveation_enabled = true\n")
    flat = load(p).grid
    assert (flat.sizes_cm, flat.rows, flat.foveated) == ((5, 10, 20, 40), 32, True) and flat.digest != g.digest
    for text in ("max_points = 0\n", "fov_up_deg = 90.0\n", "max_abs_height_m = 2e7\n", "radii_m = [10.0, 25.0, 2e9]\n", "rows = 5000\n", "width = 1\n", "foveation_enabled = 1\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            load(p)


def test_run_files(tmp_path):
    p = tmp_path / "run.toml"
    p.write_text('dataset_root = "data"\nartifact_root = "../out"\nmapping_config = "a.toml"\ncomparison_config = "b.toml"\n')
    run = load_run(p)
    assert run.dataset_root == tmp_path / "data" and run.pose_source == "slam"
    for text in ('dataset_root = "data"\n', p.read_text() + "other = 1\n", p.read_text() + 'pose_source = "both"\n'):
        p.write_text(text)
        with pytest.raises(ValueError):
            load_run(p)


def test_looking_ahead_only_refines_ahead(spark):
    rng = np.random.default_rng(3)
    pts = frame(spark, [(i, float(x), float(y), 0.0, 0.0) for i, (x, y) in enumerate(rng.uniform(-60, 60, (1500, 2)))], "i long, mx double, my double, sx double, sy double")
    levels = lambda ahead: {r.i: (r.level, r.mx) for r in cells.keyed(pts, GRID, ahead).select("i", "level", "mx").collect()}
    plain, same, far = levels(None), levels((d(1.0), d(0.0), d(1.0))), levels((d(1.0), d(0.0), d(2.0)))
    assert plain == same
    moved = [i for i in plain if far[i] != plain[i]]
    assert moved and all(far[i][0] < plain[i][0] and plain[i][1] > -1 for i in moved)
