"""Scan-sequence folders: binary points and labels, times, poses, calibration; checks and exports.

root/sequences/SS/velodyne/NNNNNN.bin   float32 x, y, z, intensity
root/sequences/SS/labels/NNNNNN.label   uint32, class low, instance high
root/sequences/SS/times.txt, poses.txt (estimated), calib.txt; root/poses/SS.txt (ground truth)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import labels
from gridloom.functions.lattice import d

_NAME = r"([0-9]{6})\.(?:bin|label)$"


def _check(sequence: str) -> None:
    if len(sequence) != 2 or not sequence.isdigit() or not 0 <= int(sequence) <= 21:
        raise ValueError("a sequence is a two-digit id from 00 to 21")


def files(spark: SparkSession, root: str, sequence: str, kind: str, start: int = 0, count: int | None = None) -> DataFrame:
    """frame_id, path, length, content of a sequence's binary files; a frame range is chosen before any is read."""
    _check(sequence)
    folder, ending = {"points": ("velodyne", "bin"), "labels": ("labels", "label"), "predictions": ("predictions", "label")}[kind]
    at = f"{root}/sequences/{sequence}/{folder}"
    paths = at if count is None and not start else [f"{at}/{i:06d}.{ending}" for i in range(start, start + count)] if count is not None else at
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(paths)
    df = df.withColumn("frame_id", F.regexp_extract("path", _NAME, 1).cast("long"))
    return df.where(F.col("frame_id") >= start).select("frame_id", "path", "length", "content")


def _decoded(df: DataFrame, kind: np.dtype, width: int, names: list[str], types: list[pa.DataType], most: int, schema: str) -> DataFrame:
    size = kind.itemsize * width

    def run(batches):
        for b in batches:
            for frame, path, content in zip(*(b.column(c).to_pylist() for c in ("frame_id", "path", "content"))):
                if not content or len(content) % size:
                    raise ValueError(f"{path}: its size is no positive multiple of {size} bytes")
                if len(content) // size > most:
                    raise ValueError(f"{path}: more than {most} points")
                values = np.frombuffer(content, kind).reshape(-1, width)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame)), pa.array(np.arange(n)), *(pa.array(values[:, i]).cast(t) for i, t in enumerate(types))], ["frame_id", "point_id", *names])

    return df.mapInArrow(run, schema)


def points(spark: SparkSession, root: str, sequence: str, start: int = 0, count: int | None = None, max_points: int = 150_000) -> DataFrame:
    """sequence, frame_id, point_id, x, y, z, intensity."""
    f = files(spark, root, sequence, "points", start, count)
    out = _decoded(f, np.dtype("<f4"), 4, ["x", "y", "z", "intensity"], [pa.float32()] * 4, max_points, "frame_id long, point_id long, x float, y float, z float, intensity float")
    return out.withColumn("sequence", F.lit(sequence))


def annotations(spark: SparkSession, root: str, sequence: str, kind: str = "labels", start: int = 0, count: int | None = None) -> DataFrame:
    """sequence, frame_id, point_id, packed, semantic, motion, instance; an unsupported class is an error."""
    f = files(spark, root, sequence, kind, start, count)
    out = _decoded(f, np.dtype("<u4"), 1, ["packed"], [pa.int64()], 1 << 31, "frame_id long, point_id long, packed long")
    parts = labels.decode(F.col("packed"))
    known = F.when(parts["semantic"].isNull(), F.raise_error(F.concat(F.lit("unsupported class "), F.col("packed").bitwiseAND(F.lit(65535)).cast("string"))).cast("int")).otherwise(parts["semantic"])
    return out.withColumns({"sequence": F.lit(sequence), "semantic": known, "motion": parts["motion"], "instance": parts["instance"]})


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a small text file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.regexp_replace("value", r"\s+$", "")), "\r?\n")).alias("line", "value"))
    return rows


def timestamps(spark: SparkSession, root: str, sequence: str) -> DataFrame:
    """frame_id, timestamp_s, ts_ns; times must be finite, not negative and strictly growing."""
    _check(sequence)
    t = _lines(spark, f"{root}/sequences/{sequence}/times.txt").select(F.col("line").cast("long").alias("frame_id"), F.trim("value").cast("double").alias("timestamp_s"))
    before = F.lag("timestamp_s").over(Window.orderBy("frame_id"))  # one small file
    bad = F.col("timestamp_s").isNull() | F.isnan("timestamp_s") | (F.col("timestamp_s") < 0) | (F.col("timestamp_s") <= before)
    t = t.withColumn("timestamp_s", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("times must be finite and strictly growing")).cast("double")).otherwise(F.col("timestamp_s")))
    return t.withColumn("ts_ns", F.rint(F.col("timestamp_s") * d(1e9)).cast("long"))


def poses(spark: SparkSession, root: str, sequence: str, source: str = "slam") -> DataFrame:
    """frame_id, pose (12 numbers) of the named source; there is no fallback to the other."""
    _check(sequence)
    path = {"slam": f"{root}/sequences/{sequence}/poses.txt", "truth": f"{root}/poses/{sequence}.txt"}[source]
    p = _lines(spark, path).select(F.col("line").cast("long").alias("frame_id"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("pose"))
    return p.withColumn("pose", F.when(F.size("pose") != 12, F.raise_error(F.lit("a pose has 12 numbers")).cast("array<double>")).otherwise(F.col("pose")))


def calibration(spark: SparkSession, root: str, sequence: str) -> list[float]:
    """The 12 numbers of the one Tr: line."""
    rows = _lines(spark, f"{root}/sequences/{sequence}/calib.txt").where(F.col("value").startswith("Tr:")).collect()
    if len(rows) != 1 or len(values := rows[0].value.split()[1:]) != 12:
        raise ValueError("calibration needs exactly one Tr: line of 12 numbers")
    return [float(v) for v in values]


def metadata_hashes(spark: SparkSession, root: str, sequence: str) -> DataFrame:
    """name, sha256 of the sequence's text files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{root}/sequences/{sequence}")
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, root: str, sequence: str) -> DataFrame:
    """rule, broken: contiguous names, whole files, one label per point, times and poses for every scan."""
    p, q = (files(spark, root, sequence, k).select("frame_id", "length") for k in ("points", "labels"))
    t = timestamps(spark, root, sequence).agg(F.count("*").alias("n"))
    o = poses(spark, root, sequence).agg(F.count("*").alias("n"))
    both = p.join(q.withColumnRenamed("length", "label_length"), "frame_id", "full")
    agg = both.agg(
        (F.count("length") - F.max("frame_id") - 1).alias("names"),
        F.count_if(F.coalesce(F.col("length") % 16 != 0, F.lit(False)) | F.coalesce(F.col("length") <= 0, F.lit(False))).alias("scan_size"),
        F.count_if(F.col("label_length").isNotNull() & (F.coalesce("length", F.lit(0)) != F.col("label_length") * 4)).alias("label_size"),
        F.count("length").alias("scans"),
    )
    one = agg.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.abs(r).cast("long").alias("broken")) for r in ("names", "scan_size", "label_size")])).alias("r"), "scans")
    rows = one.select("r.rule", "r.broken")
    for name, df in (("times", t), ("poses", o)):
        rows = rows.unionByName(agg.crossJoin(df).select(F.lit(name).alias("rule"), F.when(F.col("n") < F.col("scans"), F.col("scans") - F.col("n")).otherwise(0).cast("long").alias("broken")))  # one row each
    return rows


def synthetic(spark: SparkSession, frames: int) -> DataFrame:
    """sequence, frame_id, ts_ns, point_id, x, y, z, intensity, packed: flat ground and a wall, 0.1 s apart, by arithmetic alone."""
    n_ground, n = 20_000, 21_000
    p = spark.range(frames * n).select((F.col("id") / n).cast("long").alias("frame_id"), (F.col("id") % n).alias("point_id"))
    ground = F.col("point_id") < n_ground
    mix = lambda k: F.pmod((F.col("point_id") * k + F.col("frame_id") * 7919) % 70_001, F.lit(70_001))
    x = F.when(ground, mix(7_907) / d(1000) - d(35)).otherwise(d(8) + (F.col("point_id") % 3) / d(100))
    y = F.when(ground, mix(104_729) / d(1000) - d(35)).otherwise((F.col("point_id") % 100) / d(50) - d(1))
    z = F.when(ground, d(-1.73)).otherwise((F.col("point_id") % 37) / d(20) - d(1.6))
    return p.select(F.lit("00").alias("sequence"), "frame_id", (F.col("frame_id") * 100_000_000).alias("ts_ns"), "point_id", x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z"), d(0.5).cast("float").alias("intensity"), F.when(ground, 40).otherwise(50).cast("long").alias("packed"))


def ground_by_height(points: DataFrame, height: float = -1.0) -> DataFrame:
    """Adds ground: 1 below the height, 2 above, 0 where the intensity is not finite (an analytic stand-in for a learned segmenter)."""
    known = F.col("intensity").isNotNull() & ~F.isnan("intensity") & (F.abs("intensity") < float("inf"))
    return points.withColumn("ground", F.when(~known, labels.UNKNOWN).when(F.col("mz") < height, labels.GROUND).otherwise(labels.NONGROUND))


def ground_by_cell(points: DataFrame, width: float = 2.0, tolerance: float = 0.25) -> DataFrame:
    """Adds ground: 1 within the tolerance of the 10th height percentile of the point's coarse cell, else 2."""
    cell = [F.floor(F.col(c) / d(width)).alias(n) for c, n in (("mx", "_gx"), ("my", "_gy"))]
    low = points.groupBy("frame_id", *cell).agg(F.percentile_approx("mz", 0.1).alias("_low"))
    p = points.select("*", *cell).join(low, ["frame_id", "_gx", "_gy"])
    return p.withColumn("ground", F.when(F.col("mz") <= F.col("_low") + tolerance, labels.GROUND).otherwise(labels.NONGROUND)).drop("_gx", "_gy", "_low")


def with_predictions(points: DataFrame, load, schema: str) -> DataFrame:
    """Points with a user's model applied: load() gives a function of pandas batches, called once per worker task.

    The result must have semantic 0..19, score 0..1 and reason (0 exactly where semantic is not 0); other values are errors.
    """

    def run(batches):
        predict = load()
        for pdf in batches:
            out = predict(pdf)
            ok = out.semantic.between(0, 19) & out.score.between(0, 1) & ((out.semantic == 0) == (out.reason != 0))
            if not ok.all():
                raise ValueError("predictions break their contract")
            yield out

    return points.mapInPandas(run, schema)


def remap_channels(channel):
    """Class of a 20-channel output: 0..18 are classes 1..19, 19 is unknown."""
    return F.when(channel == 19, 0).otherwise(channel + 1)


def export_labels(raw: DataFrame, folder: str) -> int:
    """Write one .label file per frame of raw (frame_id, point_id, raw), points in input order, to a folder every machine sees.

    Existing files are errors. Returns the number of files.
    """

    def run(t: pa.Table) -> pa.Table:
        import os

        order = np.argsort(np.asarray(t.column("point_id")), kind="stable")
        frame = t.column("frame_id")[0].as_py()
        path, part = f"{folder}/{frame:06d}.label", f"{folder}/.{frame:06d}.{os.getpid()}"
        if os.path.exists(path):
            raise FileExistsError(path)
        with open(part, "wb") as f:
            f.write(np.asarray(t.column("raw"))[order].astype("<u4").tobytes())
        os.replace(part, path)  # a retried task leaves a whole file or none
        return pa.table([pa.array([frame], pa.int64())], ["frame_id"])

    import os

    os.makedirs(folder, exist_ok=False)
    return raw.groupBy("frame_id").applyInArrow(run, "frame_id long").count()


def paired(truth: DataFrame, predicted: DataFrame, partial: bool = False) -> DataFrame:
    """Truth and prediction by frame and point; frames of one side alone are an error (of the truth alone: unless partial)."""
    t, p = truth.select("frame_id").distinct(), predicted.select("frame_id").distinct()
    lone = p.join(t, "frame_id", "left_anti")
    if not partial:
        lone = lone.union(t.join(p, "frame_id", "left_anti"))
    if not lone.isEmpty():
        raise ValueError("predictions and labels are of different frames")
    return truth.select("frame_id", "point_id", F.col("semantic").alias("truth")).join(predicted.select("frame_id", "point_id", F.col("semantic").alias("pred")), ["frame_id", "point_id"])


def unpack_voxels(spark: SparkSession, path: str) -> DataFrame:
    """path, index of the set voxels of bit-packed files (most significant bit first)."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(content, np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64())], ["path", "index"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, index long")
