"""Ordered sequences: tracking, motion, poses, fusion; batch and stream give the same."""

import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import Fusion, Grid, Tracking
from gridloom.operators import contracts, fusion, sequence, tracks
from gridloom.streaming import replay


def box(x, y=0.0):
    return (x, y, 0.0, x - 0.5, y - 0.5, -0.5, x + 0.5, y + 0.5, 0.5)


def play(frames, s=Tracking(), step=100_000_000):
    state, out = tracks.State(), []
    for f, cands in frames:
        state, rows, rejected = tracks.advance(state, 0, f, f * step, [(i, c, st, box(*b)) for i, c, st, *b in cands], s)
        out.append(([(r[3], r[4], r[5]) for r in rows], rejected))
    return out


def test_crossing_objects_keep_their_ids():
    frames = [(f, [(0, 1, "observed", f * 1.0), (1, 1, "observed", 10 - f * 1.0, 1.0)]) for f in range(1, 10)]
    assert {(t, i) for rows, _ in play(frames) for t, i, _ in rows} == {(1, 0), (2, 1)}


def test_lifecycle():
    seen = [(0, 1, "observed", 0.0)]
    got = [rows[0] for rows, _ in play([(1, seen), (2, seen), (3, []), (4, []), (5, seen), (6, []), (7, []), (8, [])])]
    assert [r[2] for r in got] == ["tentative", "confirmed", "occluded", "occluded", "confirmed", "occluded", "occluded", "expired"]
    reborn = play([(1, seen), (2, []), (3, seen)])
    assert [rows for rows, _ in reborn] == [[(1, 0, "tentative")], [(1, None, "expired")], [(2, 0, "tentative")]]


def test_capacity_and_gap_and_class():
    two = [(0, 1, "observed", 0.0), (1, 1, "observed", 20.0)]
    assert play([(1, two)], Tracking(capacity=1))[0][1] == [1]
    seen = [(0, 1, "observed", 0.0)]
    assert [r[2] for r in play([(1, seen), (2, seen), (13, seen)])[2][0]] == ["occluded", "tentative"]
    assert play([(1, seen), (2, [(0, 2, "observed", 0.0)])])[1][0] == [(1, None, "expired"), (2, 0, "tentative")]
    assert play([(1, [(0, 18, "observed", 0.0), (1, 1, "ambiguous", 0.0)])])[0][0] == []
    with pytest.raises(ValueError):
        play([(2, seen), (1, seen)])


def candidates(spark, n=30):
    rng = np.random.default_rng(0)
    rows = []
    for q in range(3):
        for f in range(n):
            for i in range(6):
                if rng.random() < 0.8:
                    rows.append((q, f, f * 100_000_000 + 1, i, 1 + i % 2, "observed", *map(float, box(i * 3 + f * 0.2 + float(rng.normal(0, 0.1))))))
    return spark.createDataFrame(rows, tracks.CANDIDATES)


def test_stream_equals_batch_and_keeps_the_contract(spark, tmp_path):
    c = candidates(spark)
    for part in range(3):  # one file a batch, frames in order
        c.where(F.expr(f"frame_id div 10 = {part}")).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    batch = tracks.track(c)
    stream = spark.readStream.schema(tracks.CANDIDATES).option("maxFilesPerTrigger", 1).parquet(*[f"{tmp_path}/in/part=*"])
    q = replay.track_stream(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM tracked WHERE NOT rejected").drop("rejected")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got.select(*batch.columns)) == key(batch)
    assert contracts.lifecycle_violations(batch).count() == 0
    assert contracts.lifecycle_violations(batch.withColumn("lifecycle", F.when(F.col("frame_id") == 7, "tentative").otherwise(F.col("lifecycle")))).count() > 0


def test_instances_beyond_capacity_are_returned(spark):
    c = candidates(spark, 1)
    per = {r.sequence: r.n for r in c.groupBy("sequence").agg(F.count("*").alias("n")).collect()}
    refused = tracks.rejected(c, Tracking(capacity=2)).collect()
    kept = tracks.track(c, Tracking(capacity=2)).collect()
    assert {q: sum(r.sequence == q for r in refused) for q in per} == {q: n - 2 for q, n in per.items()}
    assert sorted((r.sequence, r.instance_id) for r in [*refused, *kept]) == sorted((r.sequence, r.instance_id) for r in c.collect())
    assert tracks.rejected(c).count() == 0


def test_late_frames_become_rejected_rows(spark, tmp_path):
    c = candidates(spark, 4).where("sequence = 0")
    for n, f in enumerate((2, 1, 3)):
        c.where(f"frame_id = {f}").coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(tracks.CANDIDATES).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/part=*")
    q = replay.track_stream(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r.frame_id for r in spark.sql("SELECT frame_id FROM late WHERE rejected").collect()} == {1}


@pytest.mark.parametrize("speed,state", [(0.0, 1), (0.5, 0), (2.0, 2)])
def test_motion_states(spark, speed, state):
    rows = [(1, f, f * 100_000_000, f * 0.1 * speed, 0.0, 0.0) for f in (0, 1, 2, 3, 5, 6)]
    got = sequence.motion_state(spark.createDataFrame(rows, "track_id long, frame_id long, ts_ns long, px double, py double, pz double")).orderBy("frame_id").collect()
    assert [r.observations for r in got] == [1, 2, 3, 3, 1, 2]
    assert [r.state for r in got] == [0, 0, state, state, 0, 0]


def test_stretch_and_heading(spark):
    rows = [(0, 0, 0, 0.0, 0.0), (0, 1, 100_000_000, 1.0, 0.0), (0, 2, 200_000_000, 1.0, 0.0), (0, 3, 300_000_000, 1.0, -0.5)]
    got = sequence.pose_speed(spark.createDataFrame(rows, "sequence long, frame_id long, ts_ns long, px double, py double")).orderBy("frame_id").collect()
    assert [r.stretch for r in got] == [1.0, 2.0, 1.0, 1.5]
    assert (got[3].hx, got[3].hy) == (0.0, -1.0)


def scans(spark):
    rng = np.random.default_rng(0)
    rows = [(int(c), int(t) * 100_000_000, int(rng.integers(0, 4)), int(rng.integers(0, 2)), bool(rng.integers(0, 3) == 0), float(rng.normal(-1.7, 0.3)), float(rng.uniform(0, 0.01))) for c in range(12) for t in range(25)]
    return spark.createDataFrame(rows, "cell_id long, ts_ns long, n_ground long, n_obstacle long, is_free boolean, mean_z double, spread double")


def test_fold_equals_the_sequential_twin_and_the_stream(spark, tmp_path):
    df = scans(spark)
    whole = df.withColumns({"n": F.col("n_ground") + F.col("n_obstacle"), "low": F.lit(0.0), "high": F.lit(1.0), "classes": F.array(*[F.lit(0).cast("long")] * 20), "restart": F.lit(False)})
    names = [c.split()[0] for c in replay.FUSED_OUT.split(", ")]
    batch = {r.cell_id: tuple(r) for r in fusion.fold(whole, Fusion(), ("cell_id",)).select(names).collect()}
    for cell, rows in df.orderBy("ts_ns").toPandas().groupby("cell_id"):
        state = dict(replay.FRESH)
        for r in rows.itertuples():
            state = replay.merge_scan(state, SimpleNamespace(**r._asdict()), Fusion())
        assert batch[cell] == (cell, *(state[n] for n in names[1:]))
    for part in range(2):
        df.where((F.col("ts_ns") >= 1_200_000_000) == bool(part)).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    q = replay.fuse_stream(stream).writeStream.format("memory").queryName("fused").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM fused").collect():
        if r.cell_id not in last or r.observations >= last[r.cell_id].observations:
            last[r.cell_id] = r
    assert {c: tuple(r) for c, r in last.items()} == batch


def test_cells_that_left_the_window_restart(spark):
    grid = Grid(sizes_cm=(5,), radii_m=(1.0,), ground_min_range_m=0.5)
    half = fusion.half_window(1.0, 0.05)
    s = spark.createDataFrame([("a", 0, 0, 0, f) for f in (0, 1, 4)], "sequence string, level int, ix long, iy long, frame_id long")
    path = spark.createDataFrame([("a", f, x, 0) for f, x in ((0, 0), (1, half), (2, half + 1), (3, 0), (4, 0))], "sequence string, frame_id long, cx long, cy long")
    assert [r.restart for r in fusion.mark_restarts(s, path, grid).orderBy("frame_id").collect()] == [False, False, True]


def test_restarts_equal_a_walk_over_every_frame(spark):
    rng = np.random.default_rng(3)
    grid = Grid(sizes_cm=(5, 10), radii_m=(0.2, 0.4), ground_min_range_m=0.1)
    halves = [fusion.half_window(r, w) for r, w in zip(grid.radii_m, grid.widths_m)]
    path = {(q, f): (int(x), int(y)) for q in "ab" for f, (x, y) in enumerate(rng.integers(-3, 4, (40, 2)).cumsum(0)) if f % 9 != 4}
    cells = {(q, k, int(x), int(y)): sorted({int(f) for f in rng.integers(0, 44, 12)}) for q in "abc" for k in (0, 1) for x, y in rng.integers(-8, 8, (12, 2))}
    want = set()
    for (q, k, x, y), at in cells.items():
        for before, f in zip([None, *at], at):
            between = [] if before is None else [path[q, t] for t in range(before + 1, f) if (q, t) in path]
            ratio = grid.ratios[k]
            want.add((q, k, x, y, f, any(abs(x - cx // ratio) > halves[k] or abs(y - cy // ratio) > halves[k] for cx, cy in between)))
    s = spark.createDataFrame([(*c, f) for c, at in cells.items() for f in at], "sequence string, level int, ix long, iy long, frame_id long")
    centres = spark.createDataFrame([(q, f, x, y) for (q, f), (x, y) in path.items()], "sequence string, frame_id long, cx long, cy long")
    got = {tuple(r) for r in fusion.mark_restarts(s, centres, grid).select("sequence", "level", "ix", "iy", "frame_id", "restart").collect()}
    assert got == want and {r[-1] for r in want} == {True, False}
    assert fusion.mark_restarts(s.limit(0), centres, grid).count() == 0


def test_scan_cells_feed_the_fold(spark):
    grid, rows = Grid(sizes_cm=(5, 10), radii_m=(2.0, 4.0)), []
    for f in range(6):
        rows += [("a", f, f * 100_000_000, 1.01, 0.01, -1.7, 1, 9, 0.0, 0.0), ("a", f, f * 100_000_000, 3.01, 0.01, 0.2, 2, 1, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "sequence string, frame_id long, ts_ns long, mx double, my double, mz double, ground int, semantic int, sx double, sy double")
    s = fusion.scan_cells(pts, grid).withColumn("restart", F.lit(False))
    state = fusion.fold(s, Fusion()).withColumns({"sx": F.lit(0.0), "sy": F.lit(0.0)})
    view = fusion.terrain(fusion.steps(fusion.owned(state, grid), Fusion()), F.lit(500_000_000), Fusion())
    got = {(r.level, r.ix): (r.terrain, r.occupancy, r.semantic, r.observations) for r in view.collect()}
    assert got == {(0, 20): (fusion.T_DRIVABLE, 0, 9, 6), (1, 30): (fusion.T_OBSTACLE, 1, 1, 6)}
    old = fusion.terrain(fusion.steps(fusion.owned(state, grid), Fusion()), F.lit(2_500_000_001), Fusion())
    assert {r.terrain for r in old.collect()} == {fusion.T_STALE}


def test_windows_and_sessions(spark):
    e = spark.createDataFrame([(1, "a", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 10, 50)], "user_id long, event_type string, t string, value double").withColumn("ts", F.to_timestamp("t"))
    assert replay.event_windows(e, "30 minutes").orderBy("start").select("n").collect() == [(2,), (1,)]
    assert replay.event_windows(e, "30 minutes", "10 minutes").count() > 3
    assert sorted(r.n for r in replay.event_sessions(e).collect()) == [1, 2]


def test_audit_schedule(spark):
    f = spark.createDataFrame([("a", i, "accepted" if i != 2 else "rejected") for i in range(6)], "sequence string, frame_id long, status string")
    assert [r.deep for r in contracts.audited(f, 2).orderBy("frame_id").collect()] == [True, False, True, False, True]
    assert math.isfinite(1.0)
