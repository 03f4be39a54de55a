"""Substring dedup by level-wise doubling of word windows.

Windows of one length that occur once are dropped; windows that repeat are extended to
twice the length by naming the pair of their halves, and so on to the full length (the
last two halves overlap if it is no power of the first). Only the first level reads the
texts; later levels read the names of the windows that are left.

Windows travel as packed arrays: a block of texts sends each bucket of the hash space one
row with the names and places of its windows, and a bucket sends back those that repeat.
A name that a block holds more than twice is sent twice, the rest of its places pass
through elsewhere, so a window that a third of all documents share is as many entries as
there are blocks, not documents. Names are keyed hashes: 40 bits beside the bucket's number,
96 bits at the last level. Buckets are sized by the texts' bytes.

The last level names for each window the one it equals, and the words of both are verified
(see digests.py); should names of different words have met, all levels run again with
another key. So no word is removed on the word of a hash of its window.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. All windows are judged on the input.

Edge cases: null and empty texts have no words; rows that repeat a doc_id are documents
of their own, and rows that repeat doc_id and text repeat each other; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import digests
from gridloom.llm.common import U64, Key, Rolling, blocks, buckets_for, drop_stash, free_shuffles, mix, stash, window_starts, words

_ROWS = "bucket int, block long, names binary, places binary, reps binary, through boolean"
_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
_COLUMNS = ("bucket", "block", "names", "places", "reps", "through")
_COVERED = f"block long, starts binary, ends binary, {digests.SEGMENTS}"
#: Keys that are tried; each fails only if two different windows have one name.
_TRIES = 8


def levels(size: int, least: int = 9) -> list[int]:
    """Window lengths, the last of them size; two at least."""
    out = [size]
    while out[0] > least or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


# ---------------------------------------------------------------- packed arrays


def _pack_names(name: np.ndarray, more: np.ndarray | None) -> bytes:
    """The upper 40 bits of names, or (last level) whole names and 32 bits more."""
    if more is None:
        return (name >> U64(24) & U64(0xFFFFFFFF)).astype("<u4").tobytes() + (name >> U64(56)).astype(np.uint8).tobytes()
    return name.astype("<u8").tobytes() + more.astype("<u4").tobytes()


def _unpack_names(raw: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    if wide:
        n = len(raw) // 12
        return np.frombuffer(raw, "<u8", n).astype(U64), np.frombuffer(raw, "<u4", n, 8 * n)
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(U64) << U64(24) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(U64) << U64(56), np.zeros(n, np.uint32)


def _pack_places(places: np.ndarray) -> bytes:
    """Ascending places as their first and 16-bit steps, or whole if a step is longer."""
    steps = np.diff(places)
    if len(places) < 2 or steps.max() >= 1 << 16:
        return b"\0" + places.astype("<u4").tobytes()
    return b"\1" + places[:1].astype("<u4").tobytes() + steps.astype("<u2").tobytes()


def _unpack_places(raw: bytes) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, "<u4", offset=1).astype(np.int64)
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u2", offset=5), dtype=np.int64)]) + np.frombuffer(raw, "<u4", 1, 1)[0].astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], list(_COLUMNS))


def _changes(order: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Whether an entry differs in name from that before it in order."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in names:
        new[1:] |= x[order][1:] != x[order][:-1]
    return new


def _pack_reps(blocks: np.ndarray, places: np.ndarray) -> bytes:
    return blocks.astype("<i8").tobytes() + places.astype("<u4").tobytes()


def _send(block: int, name: np.ndarray, more: np.ndarray | None, places: np.ndarray, buckets: int) -> list[tuple]:
    """Rows for the buckets; at the last level (more) windows that pass through have the block's first of the name as reps."""
    if not len(name):
        return []
    bucket = ((name & U64(0xFFFFFF)) % U64(buckets)).astype(np.int64)
    keys = (name,) if more is None else (more, name)
    order = np.lexsort(keys)
    first = _changes(order, *keys)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    extra = np.zeros(len(order), bool)
    extra[order] = np.arange(len(order)) - lead >= 2
    rep = np.empty(len(order), np.int64)
    rep[order] = places[order[lead]]
    out = []
    for through in (False, True):
        use = np.flatnonzero(extra == through)
        use = use[np.lexsort((places[use], bucket[use]))]
        cut = np.flatnonzero(np.diff(bucket[use], prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(use)]):
            some = use[a:b]
            if through and more is not None:
                names, reps = b"", _pack_reps(np.full(len(some), block), rep[some])
            else:
                names, reps = _pack_names(name[some], None if more is None else more[some]), b""
            out.append((int(bucket[some[0]]), block, names, _pack_places(places[some]), reps, through))
    return out


# ---------------------------------------------------------------- levels


def _cuts(batches, size: int):
    """(block id, batch, block, words' starts, ends, bounds) of each block of texts.

    The id tells partition, number and content, so both passes over the same rows agree.
    """
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for block in blocks(batch.column("text"), 1 << 22):
            key = batch.slice(block.lo, block.n).select(["doc_id", "key"])
            digest = zlib.crc32(repr(key.to_pydict()).encode()) & 0xFFFF
            yield part << 40 | n << 16 | digest, batch, block, *words(block)
            n += 1


def _first_level(docs: DataFrame, size: int, first: int, buckets: int, key: Key) -> DataFrame:
    def run(batches):
        for uid, _, block, start, end, bounds in _cuts(batches, size):
            word = key.word_hashes(block.bytes, start, end)
            at, row = window_starts(bounds, first)
            # Texts stand `size` apart, so no window of two texts meets.
            yield _batch(_send(uid, Rolling(word, key.base).slices(at, at + first), None, at + row * size, buckets))

    return docs.mapInArrow(run, _ROWS)


def _where(docs: DataFrame, size: int) -> DataFrame:
    """block, rows (doc_id, key, first place, words) of each block."""

    def run(batches):
        for uid, batch, block, _, _, bounds in _cuts(batches, size):
            part = batch.slice(block.lo, block.n)
            first = bounds[:-1] + np.arange(block.n) * size
            rows = pa.StructArray.from_arrays([part.column("doc_id"), part.column("key"), pa.array(first), pa.array(np.diff(bounds))], ["doc_id", "key", "first", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.ListArray.from_arrays(pa.array([0, block.n], pa.int32()), rows)], ["block", "rows"])

    return docs.mapInArrow(run, "block long, rows array<struct<doc_id:long,key:long,first:long,n:long>>")


def _repeated(rows: DataFrame, last: bool) -> DataFrame:
    """Of each bucket's windows those whose name occurs more than once: names, or at the last level the first window of the name (reps)."""

    def run(t: pa.Table) -> pa.Table:
        buckets, uids, names, places, reps, through = (t.column(c).to_pylist() for c in _COLUMNS)
        mine = [i for i, p in enumerate(through) if not p]
        parts = [_unpack_names(names[i], last) for i in mine]
        name, more = (np.concatenate([p[j] for p in parts] or [np.zeros(0, kind)]) for j, kind in ((0, U64), (1, np.uint32)))
        uid = np.repeat(np.array([uids[i] for i in mine], np.int64), [len(p[0]) for p in parts])
        place = np.concatenate([_unpack_places(places[i]) for i in mine] or [np.zeros(0, np.int64)])
        keys = (more, name) if last else (name,)
        order = np.lexsort((place, uid, *keys) if last else keys)
        new = np.append(_changes(order, *keys), True)
        many = np.zeros(len(name), bool)
        many[order] = ~(new[1:] & new[:-1])
        if last:
            rep = np.empty(len(name), np.int64)
            rep[order] = order[np.flatnonzero(new[:-1])[np.cumsum(new[:-1]) - 1]]
        out = [(buckets[i], uids[i], names[i], places[i], reps[i], False) for i, p in enumerate(through) if p]
        at = 0
        for i, (hi, _) in zip(mine, parts):
            use = at + np.flatnonzero(many[at : at + len(hi)])
            at += len(hi)
            if len(use):
                kept = (b"", _pack_places(place[use]), _pack_reps(uid[rep[use]], place[rep[use]])) if last else (_pack_names(name[use], None), _pack_places(place[use]), b"")
                out.append((buckets[i], uids[i], *kept, False))
        return pa.Table.from_batches([_batch(out)])

    return rows.groupBy("bucket").applyInArrow(run, _ROWS)


def _doubled(rows: DataFrame, shift: int, buckets: int, last: bool, key: Key) -> DataFrame:
    """The next level's windows: places whose own window and that shift words on both repeat."""

    def run(t: pa.Table) -> pa.Table:
        # The bucket's number is part of a name.
        name = np.concatenate([_unpack_names(x, False)[0] + U64(b) for x, b in zip(t.column("names").to_pylist(), t.column("bucket").to_pylist())])
        places = np.concatenate([_unpack_places(x) for x in t.column("places").to_pylist()])
        order = np.argsort(places, kind="stable")
        name, places = name[order], places[order]
        to = np.minimum(np.searchsorted(places, places + shift), len(places) - 1)
        ok = places[to] == places + shift
        with np.errstate(over="ignore"):
            left, right = (mix(name[x] * U64(key.base)) for x in (ok, to[ok]))
            pair = mix(left * U64(3) + right)
            other = (mix(mix(left + U64(key.base)) + right * U64(5)) >> U64(32)).astype(np.uint32) if last else None
        return pa.Table.from_batches([_batch(_send(t.column("block")[0].as_py(), pair, other, places[ok], buckets))])

    return rows.groupBy("block").applyInArrow(run, _ROWS)


def _covered(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """block, starts, ends: its ranges of repeated windows; SEGMENTS: the stretches to verify."""

    def run(t: pa.Table) -> pa.Table:
        block, raw = t.column("block")[0].as_py(), t.column("reps").to_pylist()
        n = [len(r) // 12 for r in raw]
        places = np.concatenate([_unpack_places(x) for x in t.column("places").to_pylist()])
        order = np.argsort(places, kind="stable")
        places = places[order]
        to = np.concatenate([np.frombuffer(r, "<i8", k) for r, k in zip(raw, n)])[order]
        there = np.concatenate([np.frombuffer(r, "<u4", k, 8 * k).astype(np.int64) for r, k in zip(raw, n)])[order]
        new = np.diff(places, prepend=-size - 1) > size
        start, end = places[new], np.append(places[np.flatnonzero(new)[1:] - 1], places[-1]) + size
        other = (to != block) | (there != places)
        own, others = digests.segments(places[other], np.ones(other.sum(), np.int64), to[other], there[other], size - 1, seed)
        return pa.table([pa.array([block], pa.int64()), pa.array([start.astype("<i8").tobytes()]), pa.array([end.astype("<i8").tobytes()]), own, others], ["block", "starts", "ends", "own", "others"])

    return rows.groupBy("block").applyInArrow(run, _COVERED)


def _spread(batches):
    """_id, _key, spans, asks of each document of a block."""
    for b in batches:
        out = [[], [], [], []]
        for docs_of, raw_start, raw_end, own, asks in zip(b.column("rows"), *(b.column(c).to_pylist() for c in ("starts", "ends", "own")), b.column("asks")):
            if docs_of.as_py() is None:
                raise ValueError("the documents changed between two readings")
            part = docs_of.values
            first = np.asarray(part.field("first"))
            start, end = np.frombuffer(raw_start, "<i8"), np.frombuffer(raw_end, "<i8")
            row = np.searchsorted(first, start, side="right") - 1
            cut = np.searchsorted(row, np.arange(len(first) + 1))
            asked_of, ask = digests.of_rows(first, own, asks)
            cut_asks = np.searchsorted(asked_of, np.arange(len(first) + 1))
            for r in np.unique(row):
                a, z = cut[r], cut[r + 1]
                out[0].append(part.field("doc_id")[r].as_py())
                out[1].append(part.field("key")[r].as_py())
                out[2].append(np.stack([start[a:z], end[a:z]], 1).ravel() - first[r])
                out[3].append(ask[cut_asks[r] : cut_asks[r + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["_id", "_key", "spans", "asks"])


def repeated_spans(docs: DataFrame, size: int, buckets: int, seed: int = 1) -> DataFrame:
    """_id, _key, spans, asks: word ranges [start, end) of each document covered by windows whose names repeat; stretches to verify.

    docs has doc_id, key and text, and must give the same rows in the same order when
    read twice (a table does).
    """
    sizes, key = levels(size), Key(seed)
    rows = stash(_repeated(_first_level(docs, size, sizes[0], buckets, key), False))
    free_shuffles(docs.sparkSession)
    for n, more in zip(sizes, sizes[1:]):
        new = stash(_repeated(_doubled(rows, more - n, buckets, more == size, key), more == size))
        drop_stash(rows)
        free_shuffles(docs.sparkSession)
        rows = new
    covered = stash(_covered(rows, size, seed))
    drop_stash(rows)
    joined = covered.drop("others").join(digests.by_block(covered), "block", "left").join(_where(docs, size), "block", "left").select("rows", "starts", "ends", "own", "asks")
    return joined.mapInArrow(_spread, "_id long, _key long, spans array<long>, asks binary")


def _digests(texts: DataFrame, salt: bytes) -> DataFrame:
    """Digests of the word ranges in asks."""

    def run(batches):
        for b in batches:
            out = []
            for text, asks in zip(b.column("text").to_pylist(), b.column("asks").to_pylist()):
                found = (text or "").encode().split()
                out += [(i, *digests.digest(b" ".join(found[a : a + n]), salt)) for a, n, i in digests.stretches(asks)]
            yield digests.batch(out)

    return texts.mapInArrow(run, digests.DIGESTS)


def verified_spans(docs: DataFrame, size: int, buckets: int, seeds=range(1, _TRIES + 1)) -> DataFrame:
    """_id, _key, spans of documents' words covered by windows that repeat, as verified on the words."""
    for seed in seeds:
        found = stash(repeated_spans(docs, size, buckets, seed))
        free_shuffles(docs.sparkSession)
        asks = digests.by_document(found, "_id", "_key")
        texts = docs.join(asks.hint("merge"), docs.doc_id.eqNullSafe(F.col("_id")) & (docs.key == F.col("_key"))).select("text", "asks")
        if digests.all_equal(_digests(texts, Key(seed).salt)):
            free_shuffles(docs.sparkSession)
            return found.select("_id", "_key", "spans").dropDuplicates(["_id", "_key"])
        drop_stash(found)
    raise RuntimeError("names of different windows met under every key")


def dedup(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that is left) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    spans = verified_spans(docs, size, buckets_for(docs))
    # By sorting at every size: texts are no table to broadcast spans to, and one plan at all sizes grows as the input does.
    joined = docs.join(spans.hint("merge"), docs.doc_id.eqNullSafe(F.col("_id")) & (docs.key == F.col("_key")), "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                found = (text or "").encode().split()
                kept = found
                if spans:
                    keep = np.ones(len(found), bool)
                    for a, z in zip(spans[::2], spans[1::2]):
                        keep[a:z] = False
                    kept = [found[i] for i in np.flatnonzero(keep)]
                joined = b" ".join(kept)
                out.append((len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


ORACLE = """
WITH w AS MATERIALIZED (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), s AS (
  SELECT doc_id, i, n, word, CASE WHEN i + 34 <= n THEN sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM w
), c AS (SELECT *, CASE WHEN h IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS many FROM s),
k AS (SELECT *, max(many) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
