"""Command line: verify a sequence folder, map it, or score predictions."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions.lattice import d
from gridloom.operators import cells, contracts, gates, metrics
from gridloom.operators.sequence import camera_to_map
from gridloom.sources import sequences


def scans_in_map(spark: SparkSession, root: str, sequence: str, grid: config.Grid, start: int = 0, count: int | None = None, pose_source: str = "slam"):
    """Accepted points of a sequence in map coordinates with sensor place, semantic, motion and ground."""
    cal = sequences.calibration(spark, root, sequence)
    pose = camera_to_map(sequences.poses(spark, root, sequence, pose_source).withColumn("sequence", F.lit(sequence)), cal)
    pose = pose.withColumns({"sx": F.element_at("pose", 4), "sy": F.element_at("pose", 8)}).drop("sequence")
    p = sequences.points(spark, root, sequence, start, count).join(F.broadcast(pose), "frame_id")  # a pose per scan of one sequence
    p = gates.accept(p, grid).join(sequences.annotations(spark, root, sequence, start=start, count=count).drop("sequence"), ["frame_id", "point_id"])
    return sequences.ground_by_height(p)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("verify", "map", "score"):
        p = sub.add_parser(name)
        p.add_argument("--root", required=True)
        p.add_argument("--sequence", required=True)
        p.add_argument("--config")
        if name != "verify":
            p.add_argument("--out", required=True)
            p.add_argument("--start", type=int, default=0)
            p.add_argument("--count", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    grid = config.load(args.config).grid if args.config else config.Grid()
    began = time.time()
    try:
        if args.command == "verify":
            rows = sequences.verify(spark, args.root, args.sequence).collect()
            print(json.dumps({r.rule: r.broken for r in rows}, sort_keys=True))
            return int(any(r.broken for r in rows))
        if args.out.startswith(args.root.rstrip("/") + "/"):
            raise ValueError("results do not go into the dataset")
        if args.command == "map":
            s = cells.snapshot(cells.keyed(scans_in_map(spark, args.root, args.sequence, grid, args.start, args.count), grid), grid)
            s.write.mode("errorifexists").partitionBy("frame_id").parquet(args.out)
            done = spark.read.parquet(args.out)
            bad = contracts.violations(done, contracts.cell_rules(grid), "frame_id")
            r = contracts.receipts(done, bad, "frame_id")
            r.write.mode("errorifexists").json(f"{args.out}-receipts")
            rejected = spark.read.json(f"{args.out}-receipts").where("status <> 'accepted'").count()
            print(json.dumps({"cells": done.count(), "rejected_frames": rejected, "seconds": round(time.time() - began, 3)}))
            return 2 * int(rejected > 0)
        t = sequences.annotations(spark, args.root, args.sequence, start=args.start, count=args.count)
        p = sequences.annotations(spark, args.root, args.sequence, "predictions", args.start, args.count)
        pts = sequences.points(spark, args.root, args.sequence, args.start, args.count)
        x, y, z = (F.col(c).cast("double") for c in "xyz")
        both = sequences.paired(t, p, partial=args.count is not None).join(pts.select("frame_id", "point_id", F.sqrt(x * x + y * y + z * z + d(0)).alias("range_m")), ["frame_id", "point_id"])
        metrics.semantic_metrics(metrics.confusion(both)).coalesce(1).write.mode("errorifexists").json(args.out)
        return 0
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
