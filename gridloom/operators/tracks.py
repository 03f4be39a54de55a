"""Candidate tracking: greedy gated association in birth order, one state per sequence.

The transition is one pure function of (state, frame); the batch operator folds a
sequence's frames with it, the streaming operator keeps its state between batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from gridloom.config import Tracking
from gridloom.functions.labels import THINGS

OUT = "sequence long, frame_id long, ts_ns long, track_id long, instance_id long, lifecycle string, birth_ns long, last_observed_ns long, confidence double"
REJECTED = "sequence long, frame_id long, ts_ns long, instance_id long"
CANDIDATES = "sequence long, frame_id long, ts_ns long, instance_id long, semantic int, status string, cx double, cy double, cz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
BOX = ("cx", "cy", "cz", "x0", "y0", "z0", "x1", "y1", "z1")


@dataclass(frozen=True)
class Track:
    track_id: int
    birth_ns: int
    seen_ns: int
    semantic: int
    box: tuple[float, ...]
    lifecycle: str = "tentative"
    misses: int = 0
    before: tuple[float, ...] | None = None
    before_ns: int | None = None


@dataclass(frozen=True)
class State:
    frame_id: int = -1
    ts_ns: int = -1
    next_id: int = 1
    tracks: tuple[Track, ...] = field(default_factory=tuple)


def match(track: Track, free: dict[int, tuple], ts_ns: int, s: Tracking) -> tuple[int, float] | None:
    """(instance, confidence) of the nearest free candidate of the class within radius and box, by (distance, id)."""
    dt = (ts_ns - track.seen_ns) / 1e9
    if dt > s.max_gap_s:
        return None
    move = (0.0, 0.0, 0.0)
    if track.before is not None:
        span = (track.seen_ns - track.before_ns) / 1e9
        v = [(a - b) / span for a, b in zip(track.box[:3], track.before)]
        speed = math.sqrt(sum(x * x for x in v))
        if speed:
            move = tuple(x * min(1.0, s.max_speed / speed) * dt for x in v)
    centre = [c + m for c, m in zip(track.box[:3], move)]
    low = [c + m - s.box_margin_m for c, m in zip(track.box[3:6], move)]
    high = [c + m + s.box_margin_m for c, m in zip(track.box[6:9], move)]
    radius = min(s.max_radius_m, s.base_radius_m + s.max_speed * dt)
    best = None
    for instance, (semantic, box) in free.items():
        if semantic != track.semantic:
            continue
        distance = math.dist(centre, box[:3])
        if distance <= radius and all(h >= a for h, a in zip(box[6:9], low)) and all(b <= h for b, h in zip(box[3:6], high)):
            best = min(best or (math.inf, 0), (distance, instance))
    return None if best is None else (best[1], max(0.0, 1.0 - best[0] / radius))


def advance(state: State, sequence: int, frame_id: int, ts_ns: int, candidates: list[tuple], s: Tracking = Tracking()) -> tuple[State, list[tuple], list[int]]:
    """(new state, rows of OUT, rejected instances) after one frame; candidates: (instance, semantic, status, box)."""
    if frame_id <= state.frame_id or ts_ns <= state.ts_ns:
        raise ValueError("frames must have growing ids and times")
    free = {i: (c, box) for i, c, status, box in candidates if c in THINGS and status == "observed"}
    tracks, rows = [], []
    for t in state.tracks:
        found = match(t, free, ts_ns, s)
        if found:
            instance, confidence = found
            _, box = free.pop(instance)
            new = replace(t, seen_ns=ts_ns, box=box, lifecycle="confirmed", misses=0, before=t.box[:3], before_ns=t.seen_ns)
            tracks.append(new)
        else:
            instance, confidence = None, 0.0
            gone = t.lifecycle == "tentative" or t.misses + 1 >= s.max_misses
            new = replace(t, lifecycle="expired" if gone else "occluded", misses=t.misses + 1)
            if not gone:
                tracks.append(new)
        rows.append((sequence, frame_id, ts_ns, t.track_id, instance, new.lifecycle, t.birth_ns, new.seen_ns, confidence))
    next_id, rejected = state.next_id, []
    for instance in sorted(free):
        if len(tracks) >= s.capacity:
            rejected.append(instance)
            continue
        c, box = free[instance]
        tracks.append(Track(next_id, ts_ns, ts_ns, c, box))
        rows.append((sequence, frame_id, ts_ns, next_id, instance, "tentative", ts_ns, ts_ns, 0.0))
        next_id += 1
    return State(frame_id, ts_ns, next_id, tuple(tracks)), rows, rejected


def frames_of(pdf: pd.DataFrame) -> Iterator[tuple[int, int, list[tuple]]]:
    """(frame_id, ts_ns, candidates) in order; a row with a null instance marks a frame without candidates."""
    pdf = pdf.sort_values(["frame_id", "ts_ns", "instance_id"])
    boxes = pdf[list(BOX)].to_numpy(dtype=float).tolist()
    rows = zip(pdf.frame_id.tolist(), pdf.ts_ns.tolist(), pdf.instance_id.tolist(), pdf.semantic.tolist(), pdf.status.tolist(), boxes)
    for (frame, ts), part in groupby(rows, key=lambda r: r[:2]):
        yield int(frame), int(ts), [(int(i), int(c), status, tuple(b)) for _, _, i, c, status, b in part if i == i and i is not None]


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"instance_id": "Int64"})


def track(candidates: DataFrame, s: Tracking = Tracking()) -> DataFrame:
    """OUT for each sequence of candidates (CANDIDATES); a sequence is one task's work, as its frames depend on each other."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        for frame, ts, cands in frames_of(pdf):
            state, rows, _ = advance(state, int(key[0]), frame, ts, cands, s)
            out += rows
        return as_frame(out)

    return candidates.groupBy("sequence").applyInPandas(run, OUT)


def rejected(candidates: DataFrame, s: Tracking = Tracking()) -> DataFrame:
    """REJECTED: the instances that track() refuses, as a sequence has no room for more tracks."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        for frame, ts, cands in frames_of(pdf):
            state, _, refused = advance(state, int(key[0]), frame, ts, cands, s)
            out += [(int(key[0]), frame, ts, i) for i in refused]
        return pd.DataFrame(out, columns=[c.split()[0] for c in REJECTED.split(", ")])

    return candidates.groupBy("sequence").applyInPandas(run, REJECTED)
