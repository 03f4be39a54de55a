import json
import struct

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.operators import metrics, sequence
from gridloom.sources import sequences


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "data" / "sequences" / "08"
    (at / "velodyne").mkdir(parents=True)
    (at / "labels").mkdir()
    (tmp_path / "data" / "poses").mkdir()
    for i in range(3):
        (at / "velodyne" / f"{i:06d}.bin").write_bytes(struct.pack("<8f", 5.01, 0.01, -1.73, 0.2, 5.02, 0.02, 0.27, 0.8))
        (at / "labels" / f"{i:06d}.label").write_bytes(struct.pack("<2I", 40, 42 << 16 | 252))
    (at / "times.txt").write_text("0.0\n0.1\n0.21\n")
    pose = "\n".join(f"1 0 0 0 0 1 0 0 0 0 1 {z}" for z in (0, 0.5, 1)) + "\n"
    (at / "poses.txt").write_text(pose)
    (tmp_path / "data" / "poses" / "08.txt").write_text(pose)
    # Sensor x, y, z = camera z, -x, -y.
    (at / "calib.txt").write_text("P0: 1\nTr: 0 -1 0 0 0 0 -1 0 1 0 0 0\n")
    return str(tmp_path / "data")


def test_decoding(spark, root):
    a = sequences.annotations(spark, root, "08").where("frame_id = 1").orderBy("point_id").collect()
    assert [(r.semantic, r.motion, r.instance) for r in a] == [(9, 1, 0), (1, 2, 42)]
    p = sequences.points(spark, root, "08", 1, 1).collect()
    assert {r.frame_id for r in p} == {1} and len(p) == 2
    assert [r.ts_ns for r in sequences.timestamps(spark, root, "08").orderBy("frame_id").collect()] == [0, 100_000_000, 210_000_000]
    cal = sequences.calibration(spark, root, "08")
    m = sequence.camera_to_map(sequences.poses(spark, root, "08", "truth").withColumn("sequence", F.lit("08")), cal).orderBy("frame_id").collect()
    assert [(r.pose[3], r.pose[7], r.pose[11]) for r in m] == [(0, 0, 0), (0.5, 0, 0), (1, 0, 0)]
    assert sequences.metadata_hashes(spark, root, "08").count() == 3
    assert all(r.broken == 0 for r in sequences.verify(spark, root, "08").collect())


def fails(f):
    with pytest.raises(Exception):  # noqa: B017
        f()


def test_faults_are_errors(spark, root):
    at = f"{root}/sequences/08"
    fails(lambda: sequences.points(spark, root, "8").count())
    fails(lambda: sequences.poses(spark, root, "08", "other").count())
    open(f"{at}/velodyne/000003.bin", "wb").write(b"x" * 17)
    fails(lambda: sequences.points(spark, root, "08").count())
    assert {r.rule: r.broken for r in sequences.verify(spark, root, "08").collect()} == {"names": 0, "scan_size": 1, "label_size": 0, "times": 1, "poses": 1}
    open(f"{at}/labels/000000.label", "wb").write(struct.pack("<I", 7))
    fails(lambda: sequences.annotations(spark, root, "08").collect())
    open(f"{at}/times.txt", "w").write("0.0\n0.0\n")
    fails(lambda: sequences.timestamps(spark, root, "08").collect())
    open(f"{at}/calib.txt", "w").write("P0: 1\n")
    fails(lambda: sequences.calibration(spark, root, "08"))


def test_export_round_trip(spark, root, tmp_path):
    raw = sequences.annotations(spark, root, "08").select("frame_id", "point_id", F.col("packed").alias("raw"))
    folder = f"{root}/sequences/08/predictions"
    assert sequences.export_labels(raw, folder) == 3
    fails(lambda: sequences.export_labels(raw, folder))
    back = sequences.annotations(spark, root, "08", "predictions")
    assert raw.exceptAll(back.select("frame_id", "point_id", F.col("packed").alias("raw"))).count() == 0
    both = sequences.paired(sequences.annotations(spark, root, "08"), back)
    m = metrics.semantic_metrics(metrics.confusion(both.withColumn("range_m", F.lit(5.0)))).where("band = 'all'").first()
    assert abs(m.miou_19 - 2 / 19) < 1e-12 and m.accuracy == 1.0
    with pytest.raises(ValueError):
        sequences.paired(sequences.annotations(spark, root, "08"), back.where("frame_id > 0"))


def test_command_line(spark, root, tmp_path, capsys):
    assert cli.main(["verify", "--root", root, "--sequence", "08"]) == 0
    assert cli.main(["map", "--root", root, "--sequence", "08", "--out", str(tmp_path / "cells")]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["cells"] == 3 and told["rejected_frames"] == 0  # both points of a frame share a cell
    assert cli.main(["map", "--root", root, "--sequence", "08", "--out", f"{root}/cells"]) == 1
    sequences.export_labels(sequences.annotations(spark, root, "08").select("frame_id", "point_id", F.col("packed").alias("raw")), f"{root}/sequences/08/predictions")
    assert cli.main(["score", "--root", root, "--sequence", "08", "--out", str(tmp_path / "score")]) == 0
    assert spark.read.json(str(tmp_path / "score")).where("band = 'all'").first().accuracy == 1.0


def test_synthetic_and_ground_and_model(spark):
    p = sequences.synthetic(spark, 2)
    assert p.groupBy("frame_id").count().collect() == [(0, 21000), (1, 21000)] or p.count() == 42000
    q = p.withColumns({"mx": F.col("x").cast("double"), "my": F.col("y").cast("double"), "mz": F.col("z").cast("double")})
    by_height = sequences.ground_by_height(q).groupBy("ground").count().collect()
    assert dict(by_height)[1] >= 40000
    assert dict(sequences.ground_by_cell(q).groupBy("ground").count().collect())[1] >= 40000

    def load():
        return lambda pdf: pdf.assign(semantic=9, score=1.0, reason=0)

    def broken():
        return lambda pdf: pdf.assign(semantic=0, score=1.0, reason=0)

    schema = "frame_id long, point_id long, semantic int, score double, reason int"
    some = p.select("frame_id", "point_id").limit(10)
    assert sequences.with_predictions(some, load, schema).where("semantic = 9").count() == 10
    fails(lambda: sequences.with_predictions(some, broken, schema).count())
    assert [r.c for r in spark.createDataFrame([(0,), (4,), (18,), (19,)], "x int").select(sequences.remap_channels(F.col("x")).alias("c")).collect()] == [1, 5, 19, 0]


def test_bit_packed_voxels(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(bytes([0b10000001, 0b01000000]))
    assert sorted(r["index"] for r in sequences.unpack_voxels(spark, str(tmp_path / "v.bin")).collect()) == [0, 7, 9]
