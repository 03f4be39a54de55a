"""DuckDB text of the lattice expressions, written independently of the Spark columns."""

from __future__ import annotations

from gridloom.config import Grid


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def base(x: str) -> str:
    return f"CAST(floor({x} / {num(0.05)}) AS BIGINT)"


def div(b: str, r: int) -> str:
    """Rounds down, unlike //."""
    return f"CAST(floor(({b}) / {num(float(r))}) AS BIGINT)"


def gap(lower: str, width: float, s: str) -> str:
    return f"greatest(greatest({lower} - {s}, {s} - ({lower} + {num(width)})), {num(0.0)})"


def near(bx: str, by: str, k: int, grid: Grid, sx: str = "sx", sy: str = "sy") -> str:
    """Whether the level-k block of a base cell is refined."""
    w = grid.widths_m[k]
    dx, dy = (gap(f"({div(b, grid.ratios[k])} * {num(w)})", w, s) for b, s in ((bx, sx), (by, sy)))
    dist = f"sqrt({dx} * {dx} + {dy} * {dy})" if grid.footprint == "radial" else f"greatest({dx}, {dy})"
    return f"({dist} < {num(grid.radii_m[k - 1])})"


def level(bx: str, by: str, grid: Grid) -> str:
    out = "0"
    for k in range(1, len(grid.sizes_cm)):
        out = f"CASE WHEN NOT {near(bx, by, k, grid)} THEN {k} ELSE {out} END"
    return f"CAST({out} AS INTEGER)"


def cell(b: str, grid: Grid, lv: str = "level") -> str:
    return "CASE " + " ".join(f"WHEN {lv} = {k} THEN {div(b, r)}" for k, r in enumerate(grid.ratios)) + " END"


def width(grid: Grid, lv: str = "level") -> str:
    return "CASE " + " ".join(f"WHEN {lv} = {k} THEN {num(w)}" for k, w in enumerate(grid.widths_m)) + " END"


def keyed(source: str, grid: Grid) -> str:
    """SELECT of source (mx, my, sx, sy, ...) with base indices ux, uy and level, ix, iy."""
    return (
        f"SELECT *, {cell('ux', grid)} AS ix, {cell('uy', grid)} AS iy FROM "
        f"(SELECT *, {level('ux', 'uy', grid)} AS level FROM (SELECT *, {base('mx')} AS ux, {base('my')} AS uy FROM ({source})))"
    )


def finite(x: str) -> str:
    return f"({x} IS NOT NULL AND isfinite({x}))"
