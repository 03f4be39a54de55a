"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token ids plus an end id; only those longer than a sequence are cut.
What must be packed depends on lengths alone, so the instance is the histogram of piece
lengths: at most `capacity` counts, whatever the number of documents. On it, sets of
one, two or three pieces that provably dominate every other set holding their largest
piece are fixed for as many copies as there are; when nothing more can be fixed, the
remainder is packed best-fit decreasing. Every piece then finds its place from its rank
among the pieces of its length; ranks are counted in hashed parts of each length, so a
length that many documents share is not one task's work.

Edge cases: null and empty texts hold the end id alone; repeated rows are packed each;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, lean, stash
from gridloom.llm.tokens import Tokens

_TOKENS: dict[str, Tokens] = {}


def _two_smallest(sizes: np.ndarray, count: np.ndarray, k: int = 2) -> list[int]:
    out: list[int] = []
    for s in sizes[:k]:
        out += [int(s)] * int(min(count[s], k - len(out)))
        if len(out) >= k:
            break
    return out


def dominant(size: int, count: np.ndarray, capacity: int) -> list[int] | None:
    """The partners of a piece that dominate all its other partners, or None.

    count is without the piece itself. A set dominates another if its members can each
    take the place of a group of the other's members.
    """
    room = capacity - size
    fits = np.flatnonzero(count[: room + 1])
    if not len(fits):
        return []
    large = int(fits[-1])
    small = _two_smallest(fits, count, 3)
    if large == room or len(small) < 2 or small[0] + small[1] > room:
        return [large]
    if len(small) == 3 and sum(small) <= room:
        return None
    count[large] -= 1
    second = np.flatnonzero(count[: room - large + 1])
    over = [x for x in fits if count[x]]
    count[large] += 1
    if not len(second):
        # Pairs exist, but none with the largest: it dominates only pairs no larger than itself.
        best = max((int(a) + int(fits[fits <= room - a][-1]) for a in fits if a <= room - small[0]), default=0)
        return [large] if best <= large else None
    b = int(second[-1])
    above = np.array([x for x in over if x > b], np.int64)
    pair = _two_smallest(above, count, 2)
    return [large, b] if len(pair) < 2 or sum(pair) > room else None


def reduce(count: np.ndarray, capacity: int) -> list[tuple[int, Counter]]:
    """Fixed (copies, set) groups; their pieces leave count."""
    groups, changed = [], True
    while changed:
        changed = False
        for size in np.flatnonzero(count)[::-1]:
            while count[size]:
                count[size] -= 1
                partners = dominant(int(size), count, capacity)
                count[size] += 1
                if partners is None:
                    break
                one = Counter([int(size), *partners])
                copies = int(min(count[s] // c for s, c in one.items()))
                if not copies:
                    break
                for s, c in one.items():
                    count[s] -= copies * c
                groups.append((copies, one))
                changed = True
    return groups


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, Counter]]:
    """Best-fit decreasing over a histogram, in groups of equal bins."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, bool)

    def put(room: int, copies: int, held: Counter) -> None:
        if copies:
            by_room[room].append([copies, held])
            has[room] = True

    for size in np.flatnonzero(count)[::-1]:
        size, left = int(size), int(count[size])
        while left:
            room = size + int(np.argmax(has[size:])) if has[size:].any() else 0
            if room:
                copies, held = by_room[room].pop()
                has[room] = bool(by_room[room])
            else:
                room, copies, held = capacity, left, Counter()
            each = room // size
            full = min(copies, left // each)
            if full:
                put(room - each * size, full, held + Counter({size: each}))
                left -= full * each
                rest = copies - full
            else:
                put(room - left * size, 1, held + Counter({size: left}))
                left, rest = 0, copies - 1
            if held:
                put(room, rest, held)
    return [(c, h) for groups in by_room for c, h in groups]


def plan(count: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), by length and rank."""
    count = count.copy()
    groups = reduce(count, capacity) + best_fit(count, capacity)
    used, rows, sequence = Counter(), [], 0
    for copies, held in groups:
        offset = 0
        for size, each in sorted(held.items(), reverse=True):
            rows.append((size, used[size], each, sequence, offset))
            used[size] += copies * each
            offset += size * each
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches):
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(path)
        end = np.array([end_id], np.uint32)
        try:
            yield from cut(batches, end)
        finally:  # the worker stays; what it knows would add to the next task's memory
            _TOKENS[path].clear()

    def cut(batches, end):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(ids), 256):
                rows = []
                for d, t in zip(ids[lo : lo + 256].to_pylist(), _TOKENS[path].ids([t or "" for t in texts[lo : lo + 256].to_pylist()])):
                    t = np.concatenate([t, end]).astype("<u4")
                    rows += [(d, i, a, min(capacity, len(t) - a), zlib.crc32(t[a : a + capacity].tobytes())) for i, a in enumerate(range(0, len(t), capacity))]
                cols = zip(*rows)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = 4096, parts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces; cut must be stored, as it is read three times."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    cut = cut.withColumn("part", part)
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    count = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        count[row.length] = row.n
    table = plan(count, capacity)
    key = (table[:, 0] << 44) + table[:, 1]
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("own", own).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own"))

    def run(batches):
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            _, first, each, sequence, offset = table[at].T
            rank = rank - first
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence + rank // each), pa.array(offset + rank % each * length)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    bounded_batches(docs.sparkSession)
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pack(stash(pieces(docs, path, capacity, end_id)), capacity, parts)
