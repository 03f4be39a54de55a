"""Deterministic scan, frame and track views over the star-schema tables.

Each view is a list of SQL expressions that mean the same in Spark and DuckDB, over whole
tables, in whole-number arithmetic, so that both engines see equal coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENSOR = (0.027, -0.038)

_WIDE_X = "CAST((l_partkey*37 + l_linenumber*1013 + l_orderkey*7919) % 20000 - 10000 AS DOUBLE) / 100"
_WIDE_Y = "CAST((l_suppkey*53 + l_orderkey*7907 + l_linenumber*31) % 20000 - 10000 AS DOUBLE) / 100"
_NAN = "CAST('NaN' AS DOUBLE)"
_SENSOR = {"sx": f"CAST({SENSOR[0]} AS DOUBLE)", "sy": f"CAST({SENSOR[1]} AS DOUBLE)"}
_TIME = "CAST(l_orderkey % 8 AS BIGINT)"
_GROUND = "CASE WHEN l_linenumber = 7 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END"
_MOTION = "CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'N' THEN 1 ELSE 0 END"

VIEWS = {
    # Points with every kind of fault, in sensor coordinates.
    "raw_points": (
        "lineitem",
        {
            "frame_id": _TIME,
            "x": f"CASE WHEN l_orderkey % 97 = 0 THEN {_NAN} WHEN l_partkey % 89 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_suppkey % 83 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 61 = 0 THEN CAST(500000 AS DOUBLE) WHEN l_partkey % 67 = 0 THEN CAST(2000000 AS DOUBLE) ELSE {_WIDE_X} END",
            "y": f"CASE WHEN l_suppkey % 83 = 0 THEN CAST(0.01 AS DOUBLE) ELSE {_WIDE_Y} END",
            "z": "CASE WHEN l_suppkey % 83 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 71 = 0 THEN CAST(150 AS DOUBLE) WHEN l_partkey % 73 = 0 THEN CAST(15000 AS DOUBLE) ELSE -2.5 + l_quantity/20 END",
            **_SENSOR,
        },
    ),
    # Accepted points over the whole region, in map coordinates.
    "wide_points": (
        "lineitem",
        {
            "frame_id": _TIME,
            "mx": _WIDE_X,
            "my": _WIDE_Y,
            "mz": "-2.5 + l_quantity/20",
            "ground": f"CAST({_GROUND} AS INT)",
            "semantic": "CAST(l_linenumber*3 % 20 AS INT)",
            "motion": f"CAST({_MOTION} AS INT)",
            "intensity": f"CASE WHEN l_linenumber = 5 THEN {_NAN} ELSE l_discount END",
            **_SENSOR,
        },
    ),
    # Many points per cell, all at the coarsest level.
    "dense_points": (
        "lineitem",
        {
            "frame_id": _TIME,
            "mx": "30 + CAST((l_partkey*37 + l_linenumber*1013 + l_orderkey*7919) % 1000 AS DOUBLE) / 100",
            "my": "CAST((l_suppkey*53 + l_orderkey*7907 + l_linenumber*31) % 1000 AS DOUBLE) / 100",
            "mz": "CASE WHEN l_orderkey % 3 = 0 THEN -2.5 + l_quantity/20 ELSE -1.8 + l_quantity/200 END",
            "ground": f"CAST({_GROUND} AS INT)",
            "semantic": "CAST((l_partkey + l_linenumber) % 20 AS INT)",
            "motion": f"CAST({_MOTION} AS INT)",
            "intensity": f"CASE WHEN l_linenumber = 5 THEN {_NAN} ELSE l_discount END",
            **_SENSOR,
        },
    ),
    # Returns with an id: one per event, four frames, sensor 1.73 m above the ground.
    "returns": (
        "events",
        {
            "frame_id": "CAST(event_id % 4 AS BIGINT)",
            "point_id": "event_id",
            "mx": "CAST((event_id*7919 + user_id*37) % 8000 - 4000 AS DOUBLE) / 100 + CAST(0.003 AS DOUBLE)",
            "my": "CAST((event_id*104729 + user_id*53) % 8000 - 4000 AS DOUBLE) / 100 + CAST(0.003 AS DOUBLE)",
            "mz": "CASE WHEN event_id % 16 = 3 THEN CAST(0.4 AS DOUBLE) ELSE CAST(-1.73 AS DOUBLE) - CAST(event_id % 5 AS DOUBLE) / 1000 END",
            "ground": "CAST(CASE WHEN event_id % 16 = 3 THEN 2 WHEN event_id % 64 = 5 THEN 0 ELSE 1 END AS INT)",
            "semantic": "CAST(CASE WHEN event_id % 16 = 3 THEN 1 + event_id % 8 WHEN event_id % 32 = 7 THEN 0 WHEN event_id % 2 = 0 THEN 9 ELSE 11 END AS INT)",
            "score": "CAST((event_id*31) % 1000 AS DOUBLE) / 1000",
            **_SENSOR,
        },
    ),
    # Predicted and true classes of points with a range.
    "predictions": (
        "lineitem",
        {
            "frame_id": _TIME,
            "truth": "CAST((l_partkey + l_linenumber) % 20 AS INT)",
            "pred": "CAST(CASE WHEN l_orderkey % 5 = 0 THEN l_suppkey % 20 ELSE (l_partkey + l_linenumber) % 20 END AS INT)",
            "range_m": "CAST(l_orderkey % 800 AS DOUBLE) / 10",
        },
    ),
    # Sensor poses: one sequence per customer group, one frame per order.
    "poses": (
        "orders",
        {
            "sequence": "CAST(o_orderkey % 16 AS BIGINT)",
            "frame_id": "CAST((o_orderkey - o_orderkey % 16) / 16 AS BIGINT)",
            "ts_ns": "CAST((o_orderkey - o_orderkey % 16) / 16 * 100000000 AS BIGINT)",
            "px": "CAST(((o_orderkey - o_orderkey % 16) / 16) * 7 % 1000 + o_custkey % 3 AS DOUBLE) / 10",
            "py": "CAST(o_custkey % 11 AS DOUBLE) / 40",
        },
    ),
    # Observations of tracked objects: one object per user, one frame per event.
    "observations": (
        "events",
        {
            "track_id": "user_id",
            "event_id": "event_id",
            "frame_id": "CAST((event_id - event_id % 7) / 7 AS BIGINT)",
            "px": "CAST((event_id*13) % 400 AS DOUBLE) / 100",
            "py": "CAST((event_id*29) % 300 AS DOUBLE) / 100",
            "pz": "CAST(0 AS DOUBLE)",
        },
    ),
    # Scans of single cells over time: one cell per user.
    "cell_scans": (
        "events",
        {
            "cell_id": "user_id % 200",
            "event_id": "event_id",
            "ts_ns": "event_id * 50000000",
            "n_ground": "CAST(event_id % 3 AS BIGINT)",
            "n_obstacle": "CAST(CASE WHEN event_id % 5 = 1 THEN 1 ELSE 0 END AS BIGINT)",
            "is_free": "event_id % 4 = 2",
            "mean_z": "CAST(event_id*17 % 40 AS DOUBLE) / 100 - 1.75 + CAST(CASE WHEN event_id % 50 = 9 THEN 1 ELSE 0 END AS DOUBLE)",
            "spread": "CAST(event_id*7 % 10 AS DOUBLE) / 1000",
        },
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def view_sql(name: str) -> str:
    table, columns = VIEWS[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"
