"""Verification that stretches of texts which hashes call equal are equal.

An operator that finds equal windows by hash names for each window one it equals. Windows
in sequence whose counterparts are in sequence too form a segment. The texts of both sides
of every segment are digested with 128-bit BLAKE2b under the run's secret key; a segment
with different digests shows a false match, and the operator starts again with another
secret. A segment's id is that of its counterpart's stretch, so all texts that hold one
stretch share an id, and ids are compared after partial aggregation: no group grows with the
number of copies.

A segment is also cut wherever its counterpart's place is a multiple of CUT, so that the
stretches asked of one place stay few.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import U64, mix

CUT = 1 << 12
#: Own stretches packed (start, n, id); those of the counterparts, of any block.
SEGMENTS = "own binary, others array<struct<block:long,start:long,n:long,id:long>>"
_OTHER = ("block", "start", "n", "id")


def segments(place: np.ndarray, length: np.ndarray, other: np.ndarray, there: np.ndarray, extra: int, seed: int) -> list[pa.Array]:
    """One row of SEGMENTS for the windows of a block.

    place ascends; entry i covers the windows place[i] .. place[i] + length[i] - 1, each of 1 + extra
    symbols, and equals that of block other[i] at there[i].
    """
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + length[:-1]) | (other[1:] != other[:-1]) | (there[1:] != there[:-1] + length[:-1]) | (there[1:] // CUT != there[:-1] // CUT)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    n = place[last] + length[last] + extra - place[first]
    to, at = other[first], there[first]
    with np.errstate(over="ignore"):
        ids = mix(mix(mix(to.astype(U64) + U64(seed)) + at.astype(U64)) + n.astype(U64)).view(np.int64)
    own = np.stack([place[first], n, ids], 1).astype("<i8")
    sides = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (to, at, n, ids)], list(_OTHER))
    return [pa.array([own.tobytes()]), pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), sides)]


def by_block(asked: DataFrame) -> DataFrame:
    """block, asks: the counterparts' stretches of each block once, from rows with SEGMENTS."""
    ask = asked.select(F.explode("others").alias("a")).select("a.*").distinct()
    return ask.groupBy("block").agg(F.collect_list(F.struct("start", "n", "id")).alias("asks"))


def of_rows(first: np.ndarray, own: bytes | None, asks: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """(row, [start in the row, n, id]) of the stretches of a block, by row; first: each row's first place."""
    a = np.frombuffer(own or b"", "<i8").reshape(-1, 3)
    if asks.is_valid and len(asks.values):
        a = np.concatenate([a, np.stack([np.asarray(asks.values.field(c)) for c in _OTHER[1:]], 1)])
    row = np.searchsorted(first, a[:, 0], side="right") - 1
    order = np.argsort(row, kind="stable")
    a, row = a[order], row[order]
    a[:, 0] -= first[row]
    return row, a.astype("<i8")


def by_document(found: DataFrame, *key: str) -> DataFrame:
    """key, asks: the packed stretches (start, n, id) of each document, from rows with a binary `asks`."""
    return found.where(F.length("asks") > 0).groupBy(*key).agg(F.collect_set("asks").alias("asks"))


def stretches(asks: list[bytes]) -> list[list[int]]:
    """[start, n, id] of a document's asks."""
    return np.frombuffer(b"".join(asks), "<i8").reshape(-1, 3).tolist()


def digest(part: bytes, salt: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(part, digest_size=16, key=salt).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


DIGESTS = "id long, one long, two long"


def batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = zip(*set(rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["id", "one", "two"])


def all_equal(found: DataFrame) -> bool:
    """Whether every id has one digest (found: DIGESTS)."""
    per = found.groupBy("id").agg(*(f(c).alias(f"{n}_{c}") for c in ("one", "two") for f, n in ((F.min, "low"), (F.max, "high"))))
    return per.where("low_one <> high_one or low_two <> high_two").isEmpty()
