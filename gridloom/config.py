"""Validated settings; TOML files may set any field and nothing else."""

from __future__ import annotations

import hashlib
import json
import math
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Grid:
    """A nested lattice: cell sizes (cm), the radius (m) within which each level is used, and gates."""

    sizes_cm: tuple[int, ...] = (5, 10, 50)
    radii_m: tuple[float, ...] = (10.0, 25.0, 100.0)
    footprint: str = "radial"
    # The default gates and field of view.
    min_range_m: float = 0.05
    max_abs_coordinate_m: float = 1_000_000.0
    max_abs_height_m: float = 10_000.0
    max_points: int = 150_000
    sensor_height_m: float = 1.73
    ground_min_range_m: float = 2.7
    ambiguous_span_m: float = 0.5
    rows: int = 64
    columns: int = 1024
    fov_up_deg: float = 2.0
    fov_down_deg: float = -24.8
    frame_budget_ms: float = 100.0
    foveated: bool = False

    def __post_init__(self) -> None:
        if len(self.sizes_cm) > 8:
            raise ValueError("at most 8 levels")
        positive = ("min_range_m", "max_abs_coordinate_m", "max_abs_height_m", "max_points", "sensor_height_m", "ground_min_range_m", "ambiguous_span_m", "rows", "columns", "frame_budget_ms")
        if bad := [n for n in positive if not 0 < getattr(self, n) < math.inf]:
            raise ValueError(f"these must be finite and positive: {bad}")
        if type(self.foveated) is not bool:
            raise ValueError("foveated is true or false")
        if len(self.sizes_cm) != len(self.radii_m) or not self.sizes_cm or self.sizes_cm[0] != 5:
            raise ValueError("levels need one size and one radius each, the finest 5 cm")
        if any(b % a or b <= a for a, b in zip(self.sizes_cm, self.sizes_cm[1:])):
            raise ValueError("each size must be a multiple of the finer one")
        if any(b <= a for a, b in zip(self.radii_m, self.radii_m[1:])) or self.radii_m[0] <= 0:
            raise ValueError("radii must grow")
        if self.footprint not in ("radial", "square"):
            raise ValueError("footprint must be radial or square")
        if not -90 < self.fov_down_deg < self.fov_up_deg < 90:
            raise ValueError("field of view is empty")
        if not self.ground_min_range_m < self.radii_m[-1] <= self.max_abs_coordinate_m <= 1e9:
            raise ValueError("ground range, outer radius and coordinate limit must grow, up to 1e9 m")
        if self.max_points * math.ceil(self.max_abs_height_m * 100) ** 2 >= 1 << 63:
            raise ValueError("sums of squared heights would not fit 64 bits")
        if self.rows * self.columns > 1 << 22:
            raise ValueError("a range image has at most 2**22 pixels")

    @property
    def ratios(self) -> tuple[int, ...]:
        return tuple(s // 5 for s in self.sizes_cm)

    @property
    def widths_m(self) -> tuple[float, ...]:
        return tuple(s / 100 for s in self.sizes_cm)


    @property
    def digest(self) -> str:
        """Names these settings in receipts."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class FreeSpace:
    tau_m: float = 0.10
    corridor_m: float = 5.0
    margin_m: float = 0.30
    step_m: float = 0.025
    epsilon_m: float = 1e-6
    max_cells: int = 262_144


@dataclass(frozen=True)
class Fusion:
    stale_s: float = 2.0
    hit: float = 0.85
    miss: float = 0.4
    ground_clear: float = 0.2
    low: float = -2.0
    high: float = 3.5
    occupied_at: float = 0.85
    free_at: float = -0.8
    height_noise_m: float = 0.03
    process_noise: float = 0.0025
    reset_jump_m: float = 0.5
    valid_sigma_m: float = 0.10
    decay: float = 0.8
    drivable: tuple[int, ...] = (9, 10)
    step_limit_m: float = 0.10
    clearance_m: float = 2.0

    def __post_init__(self) -> None:
        if not self.low < self.free_at < 0 < self.occupied_at <= self.high:
            raise ValueError("log-odds bounds and thresholds must be ordered")
        if not 0 < self.decay <= 0.8:
            raise ValueError("decay must lie in (0, 0.8]")


@dataclass(frozen=True)
class Motion:
    min_span_s: float = 0.2
    stationary_max: float = 0.2
    moving_min: float = 0.8


@dataclass(frozen=True)
class Tracking:
    capacity: int = 512
    max_gap_s: float = 1.0
    max_speed: float = 30.0
    base_radius_m: float = 1.5
    max_radius_m: float = 5.0
    box_margin_m: float = 0.75
    max_misses: int = 3


@dataclass(frozen=True)
class Limits:
    """Most resources a frame may use; disk: the least that must stay free."""

    # The ceilings of the release sheet.
    max_points: int = 130_000
    max_map_cells: int = 262_144
    max_tracks: int = 512
    max_queue_depth: int = 2
    max_queue_age_ms: float = 100.0
    max_process_rss_bytes: int = 12 << 30
    max_device_memory_bytes: int = 5_500 << 20
    max_swap_delta_bytes: int = 0
    max_receipt_bytes: int = 2 << 20
    max_audit_bytes: int = 8 << 20
    min_disk_free_bytes: int = 10 << 30


@dataclass(frozen=True)
class Settings:
    grid: Grid = field(default_factory=Grid)
    free_space: FreeSpace = field(default_factory=FreeSpace)
    fusion: Fusion = field(default_factory=Fusion)
    motion: Motion = field(default_factory=Motion)
    tracking: Tracking = field(default_factory=Tracking)


#: Names of grid settings in a flat file, where they differ.
_FLAT = {"cell_sizes_cm": "sizes_cm", "projection_rows": "rows", "projection_columns": "columns", "ambiguous_ground_span_m": "ambiguous_span_m", "foveation_enabled": "foveated"}


def _made(make, given: dict, what: str):
    if extra := set(given) - {f.name for f in fields(make)}:
        raise ValueError(f"unknown {what} settings: {sorted(extra)}")
    return make(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load(path: str | Path) -> Settings:
    """Settings of a TOML file with one table per group, or of grid settings alone at its top; unknown names are errors."""
    data = tomllib.loads(Path(path).read_text())
    groups = {f.name: f.default_factory for f in fields(Settings)}
    if data and not any(isinstance(v, dict) for v in data.values()):
        return Settings(grid=_made(Grid, {_FLAT.get(k, k): v for k, v in data.items()}, "grid"))
    if extra := set(data) - set(groups):
        raise ValueError(f"unknown groups: {sorted(extra)}")
    return Settings(**{name: _made(make, data.get(name, {}), name) for name, make in groups.items()})


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes, and by which settings."""

    dataset_root: Path
    artifact_root: Path
    mapping_config: Path
    comparison_config: Path
    pose_source: str = "slam"


def load_run(path: str | Path) -> Run:
    """A run's TOML file; its paths are relative to the file."""
    at = Path(path).expanduser()
    data = tomllib.loads(at.read_text())
    paths = [f.name for f in fields(Run) if f.name != "pose_source"]
    if missing := [n for n in paths if not isinstance(data.get(n), str)]:
        raise ValueError(f"these must be paths: {missing}")
    if data.get("pose_source", "slam") not in ("slam", "truth"):
        raise ValueError("pose_source is slam or truth")
    return _made(Run, {k: at.parent / v if k in paths else v for k, v in data.items()}, "run")
