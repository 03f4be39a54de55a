"""Exact top-k search by vector-approximation files.

Each component x becomes floor(256 * x); the score of a pair is the integer inner product.

1. Equal vectors are one class, with its k + 1 smallest ids and at most k copies of each:
   no query can be answered with more of them.
2. The approximation of a class is a cell number of `bits` bits for each component, on a grid
   from the vector's own smallest to its largest component (of step 1, so without error,
   where these are close enough). Cell numbers and queries, not vectors, are dealt into
   a grid of groups; each group bounds all scores from below and above and keeps what can
   reach its k-th lower bound. A query's k-th lower bound over all groups then drops the rest.
3. Exact vectors are read for what is left, and ranked. All in reach are read at once and not one
   by one in the order of bounds: a further read would scan the table again.

Where more than `most` classes of a group are in a query's reach, such as near copies, that group's
vectors are read in the place of their bounds, for the queries concerned only, and give its k best.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part,
nor do rows without a vec_id; only vectors of one length are compared; repeated rows are
candidates each, and a repeated query id is asked once (its smallest vector). Ties go to
the smaller vec_id. Scores beyond 64 bits are held at the limits of a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stash

SCALE = 256
#: Scores bounded at once.
_BLOCK = 1 << 21
#: Answers of one class that are scored in one task.
_HOT = 1 << 12
_BOUNDS = "query_id long, key long, lower double, upper double, g int, h int"


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors: of one with all rows of v, or row by row."""
    q = np.broadcast_to(q, v.shape)
    top = (np.abs(q).max(initial=0) + 1) * (np.abs(v).max(initial=0) + 1) * max(q.shape[-1], 1)
    if top < 2**52:
        return np.einsum("ij,ij->i", v, q).astype(np.int64)
    if top < 2**62:
        return np.einsum("ij,ij->i", v.astype(np.int64), q.astype(np.int64))
    exact = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, v)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], np.int64)


def approximate(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell numbers, low, step) of whole-number vectors; a component is low + step * number, off by step / 2 at most, or by 0 if step is 1."""
    if not x.shape[1]:
        return np.zeros(x.shape, np.uint8), np.zeros(len(x)), np.ones(len(x))
    low = x.min(1)
    step = np.maximum((x.max(1) - low) / ((1 << bits) - 1), 1)
    return np.clip(np.rint((x - low[:, None]) / step[:, None]), 0, (1 << bits) - 1).astype(np.uint8), low, step


def in_reach(q, qid, code, low, step, a, several, k: int):
    """For each query its eligible vectors that may be among its k best: (query's place, their places, lower and upper bounds)."""
    code = code.astype(np.float64)
    # Half a step where there is an error, and what double precision may add.
    off = np.where(step > 1, step / 2 * (1 + 1e-6), 0) + (np.abs(low) + step * code.max(1, initial=0)) * 1e-9
    rows = max(1, _BLOCK // max(len(code), 1))
    limit = float(2**63)
    for lo in range(0, len(q), rows):
        part = q[lo : lo + rows]
        middle = (part @ code.T) * step + part.sum(1)[:, None] * low
        err = np.abs(part).sum(1)[:, None] * off
        lower, upper = np.clip(middle - err, -limit, limit), np.clip(middle + err, -limit, limit)
        for i in range(len(part)):
            mine = np.flatnonzero(several | (a != qid[lo + i]))
            if len(mine) > k:
                floor = np.partition(lower[i, mine], len(mine) - k)[len(mine) - k]
                mine = mine[upper[i, mine] >= floor]
            yield lo + i, mine, lower[i, mine], upper[i, mine]


def _matrices(t, name: str):
    """(length, rows, whole-number matrix) for each vector length in the table."""
    vectors = t.column(name)
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    off, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
    lengths = np.diff(off)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield d, rows, np.floor(SCALE * flat[off[:-1][rows][:, None] + np.arange(d)].astype(np.float64))


def _column(t, name: str) -> np.ndarray:
    return np.asarray(t.column(name).fill_null(0))


def _encoder(bits: int):
    def run(batches):
        for batch in batches:
            for d, rows, x in _matrices(batch, "v"):
                code, low, step = approximate(x, bits)
                offsets = pa.py_buffer((np.arange(len(rows) + 1) * d).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(code))])
                kept = batch.select(["key", "a", "b"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(low), pa.array(step), packed], ["key", "a", "b", "low", "step", "code"])

    return run


def _bounds(parts: list[tuple], g: int, h: int) -> pa.Table:
    """A table of (query id, keys or None, lower, upper)."""
    keys = [pa.nulls(len(lower), pa.int64()) if key is None else pa.array(key, pa.int64()) for _, key, lower, _ in parts]
    size = [len(lower) for _, _, lower, _ in parts]
    join = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0)
    cols = [
        pa.array(np.repeat([p[0] for p in parts], size).astype(np.int64)),
        pa.chunked_array(keys, pa.int64()),
        pa.array(join(2), pa.float64()),
        pa.array(join(3), pa.float64()),
        pa.array(np.full(sum(size), g, np.int32)),
        pa.array(np.full(sum(size), h, np.int32)),
    ]
    return pa.table(cols, ["query_id", "key", "lower", "upper", "g", "h"])


def _scanner(k: int, most: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return _bounds([], 0, 0)
        codes = held.column("code").combine_chunks()
        off = np.frombuffer(codes.buffers()[1], np.int32, len(codes) + 1, codes.offset * 4)
        flat = np.frombuffer(codes.buffers()[2], np.uint8) if codes.buffers()[2] is not None and codes.buffers()[2].size else np.zeros(0, np.uint8)
        key, a, low, step = (_column(held, c) for c in ("key", "a", "low", "step"))
        several, ids, out = np.asarray(held.column("b").is_valid()), _column(asked, "id"), []
        for d, at, q in _matrices(asked, "v"):
            rows = np.flatnonzero(np.diff(off) == d)
            code = flat[off[:-1][rows].astype(np.int64)[:, None] + np.arange(d)]
            for i, mine, lower, upper in in_reach(q, ids[at], code, low[rows], step[rows], a[rows], several[rows], k):
                if len(mine) > max(most, k):  # to be read exactly
                    out.append((ids[at[i]], None, np.zeros(1), np.zeros(1)))
                else:
                    out.append((ids[at[i]], key[rows[mine]], lower, upper))
        return _bounds(out, asked.column("g")[0].as_py(), asked.column("h")[0].as_py())

    return run


def _reader(k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return _bounds([], 0, 0)
        key, a, b = (_column(held, c) for c in ("key", "a", "b"))
        several, ids, out = np.asarray(held.column("b").is_valid()), _column(asked, "id"), []
        have = {d: (rows, x) for d, rows, x in _matrices(held, "v")}
        for d, at, q in _matrices(asked, "v"):
            rows, x = have.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
            for i in range(len(at)):
                other = a[rows] != ids[at[i]]
                mine = np.flatnonzero(other | several[rows])
                score = _scores(q[i], x[mine])
                first = np.where(other, a[rows], b[rows])[mine]
                best = np.lexsort((first, -score.astype(object) if len(score) and score.min() == -(2**63) else -score))[:k]
                near = score[best].astype(np.float64)
                out.append((ids[at[i]], key[rows[mine[best]]], np.nextafter(near, -np.inf), np.nextafter(near, np.inf)))
        return _bounds(out, asked.column("g")[0].as_py(), asked.column("h")[0].as_py())

    return run


def _score(batches):
    for batch in batches:
        out = np.zeros(len(batch), np.int64)
        exact = {d: (rows, x) for d, rows, x in _matrices(batch, "v")}
        for d, rows, q in _matrices(batch, "q"):
            out[rows] = _scores(q, exact[d][1])
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(out)], ["query_id", "ids", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, bits: int = 8, group_rows: int = 8192, query_rows: int = 4096, most: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of every row whose vec_id divides by `every`, against all rows; bits is 8 at most."""
    e = F.col("embedding")
    bad = F.exists(e.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("id"), e.alias("v"))
    asked = stash(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))

    ids = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = ids.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = ids.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("ids"))
    classes = stash(classes.withColumn("key", F.xxhash64("v")))
    classes = classes.withColumn("a", F.get("ids", 0)["id"]).withColumn("b", F.get("ids", 1)["id"])

    g, h = max(1, -(-classes.count() // group_rows)), max(1, -(-asked.count() // query_rows))
    deal = lambda c, parts: F.pmod(F.xxhash64(F.lit(7), c), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = asked.withColumn("h", deal("id", h))
    codes = classes.select("key", "a", "b", "v").mapInArrow(_encoder(bits), "key long, a long, b long, low double, step double, code binary")
    left, right = dealt.withColumn("g", each(g)), codes.withColumn("g", deal("key", g)).withColumn("h", each(h))
    bounds = stash(left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_scanner(k, most), _BOUNDS))

    crowded = bounds.where("key is null").select(F.col("query_id").alias("id"), "g")
    if not crowded.isEmpty():
        left = dealt.join(crowded, "id")
        right = classes.withColumn("g", deal("key", g)).join(left.select("g", F.col("h").alias("h")).distinct(), "g")
        read = left.groupBy("g", "h").cogroup(right.select("key", "a", "b", "v", "g", "h").groupBy("g", "h")).applyInArrow(_reader(k), _BOUNDS)
        bounds = bounds.unionByName(read)
    query = Window.partitionBy("query_id")
    bounds = bounds.where("key is not null").withColumn("nth", F.row_number().over(query.orderBy(F.desc("lower"))))
    floor = F.coalesce(F.max(F.when(F.col("nth") == k, F.col("lower"))).over(query), F.lit(float("-inf")))
    pairs = stash(bounds.withColumn("floor", floor).where("upper >= floor").select("query_id", "key"))

    # A vector that answers very many queries is read in parts.
    wanted = pairs.groupBy("key").agg(F.ceil(F.count("*") / _HOT).cast("int").alias("parts"))
    hot = wanted.where("parts > 1")
    pairs = pairs.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    exact = classes.select("key", "v", "ids").join(wanted, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    scored = pairs.join(exact, ["key", "part"]).join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").where(F.size("v") == F.size("q"))
    scored = scored.select("query_id", "ids", "q", "v").mapInArrow(_score, "query_id long, ids array<struct<id:long,n:int>>, score long")
    rows = scored.select("query_id", "score", F.explode("ids").alias("one")).where("one.id <> query_id")
    rows = rows.select("query_id", "score", F.col("one.id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("one.n"))).alias("copy"))
    rank = F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
