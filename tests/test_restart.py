"""A stream that stops goes on where its checkpoint stands; a rejected batch stops it before."""

import struct

import pytest

from gridloom.streaming import replay


def add(folder, i):
    (folder / f"{i:06d}.bin").write_bytes(struct.pack("<4f", i, 0, 0, 0))


def test_restart_reads_each_scan_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(3):
        add(folder, i)
    rows = lambda: replay.scans(spark, str(folder), 1).selectExpr("regexp_extract(path, '([0-9]{6})', 1) AS frame", "length")
    replay.write_frames(rows(), out, cp, lambda batch: None).awaitTermination()
    for i in range(3, 5):
        add(folder, i)

    def reject(batch):
        if batch.where("frame = '000004'").count():
            raise ValueError("rejected")

    q = replay.write_frames(rows(), out, cp, reject)
    with pytest.raises(Exception):  # noqa: B017
        q.awaitTermination()
    done = sorted(r.frame for r in spark.read.parquet(out).collect())
    assert "000004" not in done and len(done) == len(set(done))
    replay.write_frames(rows(), out, cp, lambda batch: None).awaitTermination()
    assert sorted(r.frame for r in spark.read.parquet(out).collect()) == [f"{i:06d}" for i in range(5)]
