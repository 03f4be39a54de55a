"""Streaming twins: ordered replay, tracking and cell fusion with state, windowed event counts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.config import Fusion, Tracking
from gridloom.operators import tracks

TRACK_OUT = f"{tracks.OUT}, rejected boolean"


def scans(spark: SparkSession, folder: str, per_batch: int = 2) -> DataFrame:
    """A folder's scan files as a stream of at most per_batch files a batch (a bounded queue)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.bin").option("maxFilesPerTrigger", per_batch).load(folder)


def _pack(state: tracks.State) -> str:
    return json.dumps(asdict(state))


def _unpack(text: str) -> tracks.State:
    raw = json.loads(text)
    whole = lambda t: tracks.Track(**{**t, "box": tuple(t["box"]), "before": None if t["before"] is None else tuple(t["before"])})
    return tracks.State(raw["frame_id"], raw["ts_ns"], raw["next_id"], tuple(whole(t) for t in raw["tracks"]))


def track_stream(candidates: DataFrame, s: Tracking = Tracking()) -> DataFrame:
    """Track rows of a stream of candidates; a frame that does not come after the last one is a rejected row, not dropped.

    Frames of a sequence must arrive in order between batches; within one they are sorted.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = _unpack(state.get[0]) if state.exists else tracks.State()
        out, late = [], []
        for frame, ts, cands in tracks.frames_of(pd.concat(list(batches))):
            if frame <= own.frame_id or ts <= own.ts_ns:
                late.append((int(key[0]), frame, ts, None, None, "rejected", None, None, None))
                continue
            own, rows, _ = tracks.advance(own, int(key[0]), frame, ts, cands, s)
            out += rows
        state.update((_pack(own),))
        good, bad = tracks.as_frame(out), tracks.as_frame(late)
        yield pd.concat([good.assign(rejected=False), bad.assign(rejected=True)]).astype({c: "Int64" for c in ("track_id", "birth_ns", "last_observed_ns")})

    return candidates.groupBy("sequence").applyInPandasWithState(run, TRACK_OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def merge_scan(state: dict, scan, s: Fusion) -> dict:
    """One scan merged into a cell's state, 32-bit storage as in the batch fold (log-odds, height, variance, times, count)."""
    f = np.float32
    a = dict(state)
    hit, ground, n = scan.n_obstacle > 0, scan.n_ground > 0, scan.n_ground + scan.n_obstacle
    lo = f(a["log_odds"])
    lo = f(lo + f(s.hit)) if hit else f(lo - f(s.ground_clear)) if ground else lo
    lo = f(lo - f(s.miss)) if scan.is_free else lo
    a["log_odds"] = float(max(min(lo, f(s.high)), f(s.low)))
    if ground:
        noise = max(scan.spread, s.height_noise_m**2) / scan.n_ground
        elapsed = (scan.ts_ns - a["height_ns"]) / 1e9 if a["height_ns"] >= 0 else 0.0
        prior, height = a["variance"] + s.process_noise * elapsed, a["height"]
        if np.isinf(prior) or abs(scan.mean_z - height) > s.reset_jump_m:
            a["height"], a["variance"] = float(f(scan.mean_z)), float(f(noise))
        else:
            gain = prior / (prior + noise)
            a["height"], a["variance"] = float(f(height + gain * (scan.mean_z - height))), float(f((1 - gain) * prior))
        a["height_ns"] = int(scan.ts_ns)
    if hit:
        a["last_hit"] = int(scan.ts_ns)
    if scan.is_free:
        a["last_free"] = int(scan.ts_ns)
    if n or scan.is_free:
        a["last_seen"] = int(scan.ts_ns)
    a["observations"] += int(n > 0)
    return a


FRESH = {"log_odds": 0.0, "height": 0.0, "variance": float("inf"), "height_ns": -1, "last_hit": -1, "last_free": -1, "last_seen": -1, "observations": 0}
FUSED_OUT = "cell_id long, log_odds double, height double, variance double, height_ns long, last_hit long, last_free long, last_seen long, observations int"


def fuse_stream(scans: DataFrame, s: Fusion = Fusion()) -> DataFrame:
    """The state of each cell after every batch that scanned it (cell_id, ts_ns, n_ground, n_obstacle, is_free, mean_z, spread)."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else dict(FRESH)
        for scan in pd.concat(list(batches)).sort_values("ts_ns").itertuples():
            own = merge_scan(own, scan, s)
        state.update((json.dumps(own),))
        yield pd.DataFrame([{"cell_id": key[0], **own}])[[c.split()[0] for c in FUSED_OUT.split(", ")]]

    return scans.groupBy("cell_id").applyInPandasWithState(run, FUSED_OUT, "state string", "update", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows; streams drop what is later than `late`."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def write_frames(results: DataFrame, folder: str, checkpoint: str, accept) -> "object":
    """Start a stream into Parquet by frame; accept(batch) raises to reject a batch, which stops the query before its checkpoint moves."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()  # checked and written from one computation
        try:
            accept(batch)
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            batch.unpersist()

    return results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
