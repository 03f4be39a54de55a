"""Exact substring dedup of bytes by a hash-compared suffix sort.

A document loses each byte covered by a string of `size` bytes that also starts in a
document with a smaller doc_id.

1. Anchors. Of the KEY-byte strings within each window of `size` bytes the one with the
   smallest hash (the first, if several) is the window's anchor. Equal windows have equal
   anchors at equal offsets, so only windows with an equal anchor need comparing, and
   there is one anchor for about fifteen windows. The windows of one anchor form a span;
   spans equal in anchor and content hash with a smaller document's are removed whole, after
   verification: byte by byte within a block of texts, elsewhere by digests of whole stretches
   of such spans (see digests.py). Should spans of different bytes have met, all begins again
   with another key of the hashes.
2. Suffix sort. Spans whose anchor, but not whose content, occurs in a smaller document, and
   with the same bytes on one of the anchor's sides (every window of `size` bytes holds one
   of the two sides whole: an exact condition), go with their bytes to the anchor's task.
   There the suffixes at their windows are dealt by their first eight bytes, and those alike in
   these merge-sorted. Two suffixes are compared by the hash of all `size` bytes, then by binary search for their common
   extension on prefix polynomial hashes, then by one byte: logarithmic in the compared length.
   Neighbours that agree in `size` bytes are verified byte by byte; each run of equal
   windows is removed from all but its smallest document. An anchor with over HOT open
   spans sends each window to a task of the window's own hash instead, so that a
   passage in very many contexts is not one task's work.

Data travel as packed arrays per block of texts and bucket of the hash space. What a
block holds of the same span in larger documents is settled within the block, so a string
that a third of all documents share is as many entries as there are blocks. What is on disk
at a time is bounded by the input: texts are dealt out in parts, spans to sort in as many
rounds of buckets as keep a round's bytes below half of the texts', and what a step has
used up is deleted before the next one writes.

Edge cases: null texts are empty; rows with a null doc_id, and rows of the same doc_id,
are not smaller than any other: the former neither lose nor remove bytes, the latter do
not remove each other's; an empty table gives no rows; other columns are not read.
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
from gridloom.llm.common import U64, Key, Rolling, blocks, buckets_for, drop_stash, free_shuffles, mix, sliding_min, stash, text_bytes

KEY, GAP, HOT = 20, 64, 1024
#: Positions hashed at once.
CHUNK = 1 << 15
#: Texts are dealt out in PARTS parts, one after the other (fewer, if they would be below PART_BYTES).
PARTS, PART_BYTES = 4, 1 << 26
#: What _judged says of a span: to remove, to sort, to sort window by window, and that two different ones met.
GONE, OPEN, BUSY, CLASH = range(4)
#: Keys that are tried; each fails only if two different spans have one hash.
_TRIES = 8
_ROWS = "bucket int, block long, names binary, docs binary, places binary, counts binary, through boolean"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_OUT = "block long, places binary, counts binary, want int, reps binary"
_LOW = U64((1 << 28) - 1)


def rolling_of(data: np.ndarray, key: Key) -> Rolling:
    return Rolling(key.values[data], key.base)


def _anchors(rolling: Rolling, n: int, size: int) -> np.ndarray:
    """The anchor of the window at each of n bytes, chunk by chunk: a chunk's arrays stay in a core's cache."""
    out = np.empty(n - size + 1, np.int32)
    for lo in range(0, len(out), CHUNK):
        hi = min(lo + CHUNK, len(out))
        key = rolling.each(lo, hi + size - KEY, KEY)
        key &= ~_LOW
        key |= np.arange(len(key), dtype=U64)
        least = sliding_min(key, size - KEY + 1)
        least &= _LOW
        np.add(least.view(np.int64), lo, out=out[lo:hi], casting="unsafe")
    return out


def spans(data: np.ndarray, offsets: np.ndarray, size: int, secret: Key):
    """(anchor hash, content hash, text, first window, windows, anchor, side hashes) of each span of a block.

    A window that begins at least `half` bytes before its anchor holds these, any other one a string of about as
    many bytes behind the anchor. Windows of two spans are equal only if the hash of one side is; 0: no such window.
    """
    if len(data) < size:
        return (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 4 + ((np.zeros(0, U64),) * 2,)
    rolling = rolling_of(data, secret)
    best = _anchors(rolling, len(data), size)
    new = np.ones(len(best) + 1, bool)
    np.not_equal(best[1:], best[:-1], out=new[1:-1])
    long = np.flatnonzero(np.diff(offsets) >= size)
    new[offsets[long]] = new[offsets[long + 1] - size + 1] = True  # a text's first window, and where its windows end
    start = np.flatnonzero(new)
    start, count = start[:-1], np.diff(start)
    row = np.searchsorted(offsets, start, side="right") - 1
    real = start + size <= offsets[row + 1]
    start, count, row = start[real], count[real], row[real]
    anchor = best[start].astype(np.int64)
    with np.errstate(over="ignore"):
        content = mix(rolling.slices(start, start + count - 1 + size) + (anchor - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    half = (size - KEY + 1) // 2
    sides = []
    for use, a, z in ((anchor - start >= half, anchor - half, anchor + KEY), (anchor - start - count + 1 < half, anchor, anchor + size - half + 1)):
        side = np.zeros(len(start), U64)
        side[use] = np.maximum(rolling.slices(a[use], z[use]) >> U64(48), U64(1))
        sides.append(side)
    return rolling.slices(anchor, anchor + KEY), content, row, start, count, anchor, tuple(sides)


def _cuts(batches, size: int):
    """(block id, batch part, block); the id tells partition, number and content."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for block in blocks(batch.column("text"), 1 << 21):
            own = batch.slice(block.lo, block.n)
            yield part << 40 | n << 16 | zlib.crc32(repr(own.select(["doc_id", "key"]).to_pydict()).encode()) & 0xFFFF, own, block
            n += 1


def _by(names: list[str], rows: list[tuple], types) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


#: Where anchor, content and the two sides begin in a name, and its end. Contents differ where sides agree, so they
#: need bits of their own: with 32, spans met on 0.5 GB.
_NAME = (0, 4, 11, 13, 15)
_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
_OUT_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Whether data[a:a+n] equals data[b:b+n] for every pair."""
    for lo in range(0, len(a), 1 << 14):
        x, y, m = (v[lo : lo + (1 << 14)] for v in (a, b, n))
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        if (data[np.repeat(x, m) + step] != data[np.repeat(y, m) + step]).any():
            return False
    return True


def _anchored(docs: DataFrame, size: int, buckets: int, secret: Key) -> DataFrame:
    """Packed spans; names are 4 and 7 bytes of anchor and content hash and 2 of each side's, places are block positions."""

    def run(batches):
        for uid, own, block in _cuts(batches, size):
            key, content, row, start, count, anchor, sides = spans(block.bytes, block.offsets, size, secret)
            doc = np.asarray(own.column("doc_id"))[row]
            place = start + row * GAP
            bucket = ((key & U64(0xFFFFFF)) % U64(buckets)).astype(np.int64)
            with np.errstate(over="ignore"):
                same = mix(key * U64(3) + content)
            order = np.lexsort((doc, same))
            new = np.ones(len(order), bool)
            new[1:] = same[order][1:] != same[order][:-1]
            lowest = np.empty(len(order), np.int64)
            lowest[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            extra = doc > doc[lowest]
            out = []
            if extra.any():
                a, b = np.flatnonzero(extra), lowest[extra]
                ok = (count[a] == count[b]).all() and (anchor[a] - start[a] == anchor[b] - start[b]).all() and same_bytes(block.bytes, start[a], start[b], count[a] + size - 1)
                out.append((uid % buckets, uid, b"" if ok else b"clash", b"", _planes(place[extra], "<u4"), count[extra].astype(np.uint8).tobytes(), True))
            use = np.flatnonzero(~extra)
            use = use[np.argsort(bucket[use], kind="stable")]
            cut = np.flatnonzero(np.diff(bucket[use], prepend=-1))
            name = np.empty((len(use), _NAME[-1]), np.uint8)
            for x, a, z in zip((key >> U64(24), content, *sides), _NAME, _NAME[1:]):
                name[:, a:z] = x[use].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, : z - a]
            doc, place, count, bucket = doc[use], place[use].astype("<u4"), count[use].astype(np.uint8), bucket[use[cut]].tolist()
            for b, a, z in zip(bucket, cut, [*cut[1:], len(use)]):
                out.append((b, uid, name[a:z].tobytes(), _pack_ids(doc[a:z]), _planes(place[a:z], "<u4"), count[a:z].tobytes(), False))
            yield _by(_NAMES, out, _TYPES)

    return docs.mapInArrow(run, _ROWS)


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as their first bytes, then their second bytes and so on: ascending or small ones compress."""
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    wide = int(ids.max()) - low >= 1 << 32
    return bytes([wide]) + np.array([low], "<i8").tobytes() + _planes(ids - low, "<i8" if wide else "<u4")


def _unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8", 1, 1)[0] + _numbers(raw[9:], "<i8" if raw[0] else "<u4").astype(np.int64)


def _part(raw: np.ndarray, a: int, z: int) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : z - a] = raw[:, a:z]
    return out.view("<u8").ravel().astype(U64)


def _shared(group: np.ndarray, doc: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """Which spans have a side in common with one of their group in another document."""
    out = np.zeros(len(group), bool)
    for side in sides:
        use = np.flatnonzero(side)
        use = use[np.lexsort((side[use], group[use]))]
        if len(use):
            new = np.ones(len(use), bool)
            new[1:] = (group[use][1:] != group[use][:-1]) | (side[use][1:] != side[use][:-1])
            first = np.flatnonzero(new)
            low, high = np.minimum.reduceat(doc[use], first), np.maximum.reduceat(doc[use], first)
            out[use] |= (low < high)[np.cumsum(new) - 1]
    return out


def _judged(rows: DataFrame) -> DataFrame:
    """block, places, counts, want of spans; reps: block and place of the equal span for which another one goes."""

    def run(t: pa.Table) -> pa.Table:
        out, held = [], []
        for block, names, docs, places, counts, through in zip(*(t.column(c).to_pylist() for c in _NAMES[1:])):
            if through:
                out.append((block, _numbers(places, "<u4").tobytes(), counts, CLASH if names else GONE, b""))
            else:
                held.append((block, np.frombuffer(names, np.uint8).reshape(-1, _NAME[-1]), _unpack_ids(docs), _numbers(places, "<u4"), np.frombuffer(counts, np.uint8)))
        if held:
            raw, doc, place = (np.concatenate([h[j] for h in held]) for j in (1, 2, 3))
            uid = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[2]) for h in held])
            key, content = (_part(raw, *_NAME[j : j + 2]) for j in (0, 1))
            order = np.lexsort((doc, content, key))
            k, c, d = key[order], content[order], doc[order]
            new_key = np.ones(len(k), bool)
            new_key[1:] = k[1:] != k[:-1]
            new = new_key.copy()
            new[1:] |= c[1:] != c[:-1]
            best = np.flatnonzero(new)[np.cumsum(new) - 1]
            low = d[best]
            rep = np.empty(len(k), np.int64)
            rep[order] = order[best]
            of_key = np.cumsum(new_key) - 1
            low_key = np.minimum.reduceat(d, np.flatnonzero(new_key))
            gone = d > low
            open_key = np.zeros(len(low_key), bool)
            open_key[of_key[~gone & (d > low_key[of_key])]] = True
            fine = ~gone & open_key[of_key]
            at = np.flatnonzero(fine)
            fine[at] = _shared(of_key[at], d[at], [_part(raw[order[at]], *_NAME[j : j + 2]) for j in (2, 3)])
            many = np.bincount(of_key[fine], minlength=len(low_key)) > HOT
            want = np.full(len(k), -1)
            want[order] = np.where(gone, GONE, np.where(fine, np.where(many[of_key], BUSY, OPEN), -1))
            at = 0
            for block, _, ids, places, counts in held:
                own, r = want[at : at + len(ids)], rep[at : at + len(ids)]
                at += len(ids)
                for w in (GONE, OPEN, BUSY):
                    if (use := own == w).any():
                        reps = uid[r[use]].astype("<i8").tobytes() + place[r[use]].astype("<u4").tobytes() if w == GONE else b""
                        out.append((block, places[use].tobytes(), counts[use].tobytes(), w, reps))
        return pa.Table.from_batches([_by(["block", "places", "counts", "want", "reps"], out, _OUT_TYPES)])

    return rows.groupBy("bucket").applyInArrow(run, _OUT)


def _asked(judged: DataFrame, size: int, seed: int) -> DataFrame:
    """block and SEGMENTS: the stretches to digest for the spans that go for one of another block."""

    def run(t: pa.Table) -> pa.Table:
        place, count = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]).astype(np.int64) for c, kind in (("places", "<u4"), ("counts", np.uint8)))
        n, raw = [len(x) for x in t.column("counts").to_pylist()], t.column("reps").to_pylist()
        to = np.concatenate([np.frombuffer(r, "<i8", k) for r, k in zip(raw, n)])
        there = np.concatenate([np.frombuffer(r, "<u4", k, 8 * k) for r, k in zip(raw, n)]).astype(np.int64)
        order = np.argsort(place, kind="stable")
        own, others = digests.segments(place[order], count[order], to[order], there[order], size - 1, seed)
        return pa.table([t.column("block").slice(0, 1).combine_chunks(), own, others], ["block", "own", "others"])

    return judged.where(F.length("reps") > 0).groupBy("block").applyInArrow(run, f"block long, {digests.SEGMENTS}")


def _where(docs: DataFrame, size: int) -> DataFrame:
    """block, rows (doc_id, key, first place) of each block."""

    def run(batches):
        for uid, own, block in _cuts(batches, size):
            first = block.offsets[:-1] + np.arange(block.n) * GAP
            rows = pa.StructArray.from_arrays([own.column("doc_id"), own.column("key"), pa.array(first)], ["doc_id", "key", "first"])
            yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.ListArray.from_arrays(pa.array([0, block.n], pa.int32()), rows)], ["block", "rows"])

    return docs.mapInArrow(run, "block long, rows array<struct<doc_id:long,key:long,first:long>>")


def _by_document(docs: DataFrame, judged: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """_id, _key, want, starts, counts (windows) of each document; asks: stretches of it to digest."""
    # One row per block and kind; a block's rows are bounded by its bytes.
    packed = judged.groupBy("block").agg(F.collect_list(F.struct("places", "counts", "want")).alias("found"))
    packed = packed.join(asked.select("block", "own"), "block", "left").join(digests.by_block(asked), "block", "full")
    joined = packed.join(_where(docs, size), "block", "left").select("rows", "found", "own", "asks")

    def run(batches):
        for b in batches:
            out = []
            for rows, found, own, asks in zip(b.column("rows"), b.column("found").to_pylist(), b.column("own").to_pylist(), b.column("asks")):
                if rows.as_py() is None:
                    raise ValueError("the documents changed between two readings")
                first = np.asarray(rows.values.field("first"))
                row, asks = digests.of_rows(first, own, asks)
                cut = np.searchsorted(row, np.arange(len(first) + 1))
                for r in np.unique(row):
                    s = rows.values[int(r)].as_py()
                    out.append((s["doc_id"], s["key"], -1, b"", b"", asks[cut[r] : cut[r + 1]].tobytes()))
                for want in (GONE, OPEN, BUSY):
                    mine = [f for f in found or () if f["want"] == want]
                    place = np.concatenate([np.frombuffer(f["places"], "<u4").astype(np.int64) for f in mine] or [np.zeros(0, np.int64)])
                    count = np.concatenate([np.frombuffer(f["counts"], np.uint8) for f in mine] or [np.zeros(0, np.uint8)])
                    order = np.argsort(place, kind="stable")
                    place, count = place[order], count[order]
                    row = np.searchsorted(first, place, side="right") - 1
                    cut = np.searchsorted(row, np.arange(len(first) + 1))
                    for r in np.unique(row):
                        a, z = cut[r], cut[r + 1]
                        s = rows.values[int(r)].as_py()
                        out.append((s["doc_id"], s["key"], want, (place[a:z] - first[r]).astype("<u4").tobytes(), count[a:z].tobytes(), b""))
            yield _by(["_id", "_key", "want", "starts", "counts", "asks"], out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))

    return joined.mapInArrow(run, "_id long, _key long, want int, starts binary, counts binary, asks binary")


def _digests(texts: DataFrame, salt: bytes) -> DataFrame:
    """Digests of the byte ranges in asks."""

    def run(batches):
        for b in batches:
            out = []
            for text, asks in zip(b.column("text").to_pylist(), b.column("asks").to_pylist()):
                raw = (text or "").encode()
                out += [(i, *digests.digest(raw[a : a + n], salt)) for a, n, i in digests.stretches(asks)]
            yield digests.batch(out)

    return texts.where("asks is not null").select("text", "asks").mapInArrow(run, digests.DIGESTS)


# ---------------------------------------------------------------- suffix sort


class Suffixes:
    """Suffixes of one byte array, compared over at most `depth` bytes."""

    def __init__(self, data: np.ndarray, depth: int, secret: Key = Key(1)):
        self.data = np.concatenate([data, np.zeros(max(depth, 8), np.uint8)])
        self.rolling, self.depth = rolling_of(self.data, secret), depth
        # Eight bytes from each position on, in byte order, as a number; and how many of a suffix's bytes they are.
        self.words, self.head = np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,)), min(depth, 8)

    def heads(self, at: np.ndarray) -> np.ndarray:
        return self.words[at].astype(U64) >> U64(8 * (8 - self.head))

    def common(self, a: np.ndarray, b: np.ndarray, least: int = 0) -> np.ndarray:
        """Length of the common extension of suffixes a and b, known to be `least` or more: binary search on prefix hashes."""
        prefix, out = self.rolling.prefix, np.full(len(a), self.depth)
        at = np.flatnonzero(self.rolling.raw(a, a + self.depth) != self.rolling.raw(b, b + self.depth))
        a, b = a[at], b[at]
        pa_, pb, da, db = prefix[a], prefix[b], self.rolling.down[a], self.rolling.down[b]
        low, high = np.full(len(at), least), np.full(len(at), self.depth - 1)
        for _ in range(max(self.depth - 1 - least, 0).bit_length()):
            middle = (low + high + 1) // 2
            same = (prefix[a + middle] - pa_) * da == (prefix[b + middle] - pb) * db
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        out[at] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray, least: int = 0) -> np.ndarray:
        n = self.common(a, b, least)
        return np.where(n == self.depth, or_equal, self.data[a + n] < self.data[b + n])

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes agree, by hash and then byte by byte."""
        same = self.rolling.raw(a, a + self.depth) == self.rolling.raw(b, b + self.depth)
        hit = np.flatnonzero(same)
        a, b, ok = a[hit], b[hit], np.ones(len(hit), bool)
        for j in (*range(0, self.depth - 8, 8), self.depth - self.head):
            ok &= self.heads(a + j) == self.heads(b + j)
        same[hit] = ok
        return same


def merge_sort(suffixes: Suffixes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes at[...] by group (ascending already), then by content.

    Suffixes are dealt by their first bytes; those alike in these are merged, all groups in step.
    """
    head = suffixes.heads(at)
    dealt = np.lexsort((head, group))
    if not len(at):
        return dealt
    new = np.ones(len(at), bool)
    new[1:] = (head[dealt][1:] != head[dealt][:-1]) | (group[dealt][1:] != group[dealt][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    # The larger a group, the earlier it is placed: at each width those that still merge come first.
    big = np.argsort(-size, kind="stable")[: int((size > 1).sum())]
    size = size[big]
    base = np.repeat(np.cumsum(size) - size, size)
    where = np.repeat(first[big], size) + np.arange(len(base)) - base
    p, order = at[dealt[where]], np.arange(len(base))
    width, members = 1, np.cumsum(size)
    while len(size) and width < size[0]:
        live = int(np.searchsorted(-size, -width, side="left"))
        n = int(members[live - 1])
        own, base_, size_ = np.arange(n), base[:n], np.repeat(size[:live], size[:live])
        index = own - base_
        pair = base_ + index // (2 * width) * (2 * width)
        end = np.minimum(pair + 2 * width, base_ + size_)
        split = np.minimum(pair + width, end)
        right = own >= split
        low, high = np.where(right, pair, split), np.where(right, split, end)
        other, mine = low.copy(), p[order[:n]]
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            # A left suffix comes before equal right ones: it passes only those smaller than itself.
            before = suffixes.less(mine[middle], mine[todo], right[todo], suffixes.head)
            low[todo] = np.where(before, middle + 1, low[todo])
            high[todo] = np.where(before, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        to = np.where(right, own - split + low, own + low - other)
        merged = np.empty(n, np.int64)
        merged[to] = order[:n]
        order[:n], width = merged, width * 2
    out = dealt.copy()
    out[where] = dealt[where[order]]
    return out


def windows_to_remove(data: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, size: int, secret: Key = Key(1)) -> np.ndarray:
    """Which windows (groups ascending) equal a window of their group in a smaller document."""
    suffixes = Suffixes(data, size, secret)
    order = merge_sort(suffixes, at, group)
    g, p = group[order], at[order]
    new = np.ones(len(order), bool)
    same = np.flatnonzero(g[1:] == g[:-1]) + 1
    new[same] = ~suffixes.equal(p[same], p[same - 1])
    first = np.flatnonzero(new)
    gone = np.zeros(len(order), bool)
    if len(order):
        low = np.minimum.reduceat(doc[order], first)
        gone[order] = doc[order] > low[np.cumsum(new) - 1]
    return gone


_SEGMENTS = "bucket int, docs binary, keys binary, names binary, places binary, offsets binary, counts binary, data binary"
_SEGMENT_NAMES = [c.split()[0] for c in _SEGMENTS.split(", ")]


def _segments(texts: DataFrame, size: int, buckets: int, secret: Key, part: int = 0, parts: int = 1) -> DataFrame:
    """Spans to sort, with their bytes, for every parts-th bucket of their anchors (hot: of their windows)."""

    def of_block(block, own):
        per = [(np.frombuffer(s, "<u4").astype(np.int64), np.frombuffer(c, np.uint8).astype(np.int64)) for s, c in zip(own.column("starts").to_pylist(), own.column("counts").to_pylist())]
        n = [len(s) for s, _ in per]
        row = np.repeat(np.arange(block.n), n)
        start = np.concatenate([s for s, _ in per]) + block.offsets[row]
        count = np.concatenate([c for _, c in per])
        rolling = rolling_of(block.bytes, secret)
        # The anchor again: the first smallest hash that all the span's windows hold.
        few = np.argsort(count, kind="stable")
        upto, at = np.searchsorted(count[few], np.arange(1, size - KEY + 2), side="right"), start[few]
        best, anchor = np.full(len(start), np.iinfo(np.uint64).max, U64), at.copy()
        for j, n in enumerate(upto):
            h = rolling.slices(at[:n] + j, at[:n] + j + KEY) >> U64(28)
            less = h < best[:n]
            anchor[:n][less] = at[:n][less] + j
            best[:n] = np.minimum(best[:n], h)
        anchor[few] = anchor.copy()
        name = rolling.slices(anchor, anchor + KEY)
        offset = anchor - start
        hot = (np.asarray(own.column("want")) == BUSY)[row]
        route = name.copy()
        if hot.any():  # each window on its own
            rep = np.where(hot, count, 1)
            nth = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
            i = np.repeat(np.arange(len(start)), rep)
            start, offset, count = start[i] + nth, offset[i] - nth, np.where(hot[i], 1, count[i])
            row, name, route, hot = row[i], name[i], name[i], hot[i]
            route[hot] = rolling.slices(start[hot], start[hot] + size)
        return row, start, count, offset, name, route

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                own = batch.slice(block.lo, block.n)
                row, start, count, offset, name, route = of_block(block, own)
                doc, key = np.asarray(own.column("doc_id"))[row], np.asarray(own.column("key"))[row]
                place = start - block.offsets[row]
                bucket = (mix(route) % U64(buckets)).astype(np.int64)
                order = np.flatnonzero(bucket % parts == part)
                order = order[np.argsort(bucket[order], kind="stable")]
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out = []
                for a, z in zip(cut, [*cut[1:], len(order)]):
                    s = order[a:z]
                    length = count[s] + size - 1
                    take = np.repeat(start[s] - np.cumsum(length) + length, length) + np.arange(length.sum())
                    out.append((int(bucket[s[0]]), _planes(doc[s], "<i8"), key[s].astype("<i8").tobytes(), name[s].astype("<u8").tobytes(), _planes(place[s], "<u4"), offset[s].astype(np.int8).tobytes(), count[s].astype(np.uint8).tobytes(), block.bytes[take].tobytes()))
                yield _by(_SEGMENT_NAMES, out, (pa.int32(), *[pa.binary()] * 7))

    return texts.mapInArrow(run, _SEGMENTS)


def _sorted(segments: DataFrame, size: int, secret: Key) -> DataFrame:
    """_id, _key, starts, counts of the windows to remove."""

    def run(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        key, name, offset, count = (read(c, k) for c, k in (("keys", "<i8"), ("names", "<u8"), ("offsets", np.int8), ("counts", np.uint8)))
        doc, place = (np.concatenate([_numbers(x, k) for x in t.column(c).to_pylist()]) for c, k in (("docs", "<i8"), ("places", "<u4")))
        data, count = read("data", np.uint8), count.astype(np.int64)
        length = count + size - 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        seg = np.repeat(np.arange(len(count)), count)
        at = np.repeat(np.cumsum(length) - length, count) + nth
        away = offset[seg].astype(np.int64) - nth
        order = np.lexsort((away, name[seg]))
        seg, at, nth, away = seg[order], at[order], nth[order], away[order]
        new = np.ones(len(seg), bool)
        new[1:] = (name[seg][1:] != name[seg][:-1]) | (away[1:] != away[:-1])
        gone = windows_to_remove(data, at, np.cumsum(new), doc[seg], size, secret)
        seg, nth = seg[gone], nth[gone]
        start = place[seg].astype(np.int64) + nth
        order = np.lexsort((start, key[seg], doc[seg]))
        seg, start = seg[order], start[order]
        d, k = doc[seg], key[seg]
        new = np.ones(len(seg), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        cut = np.flatnonzero(new)
        ends = [*cut[1:], len(seg)] if len(cut) else []
        rows = [(int(d[a]), int(k[a]), start[a:z].astype("<u4").tobytes(), np.ones(z - a, np.uint8).tobytes()) for a, z in zip(cut, ends)]
        return pa.Table.from_batches([_by(["_id", "_key", "starts", "counts"], rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))])

    return segments.groupBy("bucket").applyInArrow(run, "_id long, _key long, starts binary, counts binary")


def _in_parts(make, parts: int, spark) -> DataFrame:
    """make(part) of all parts, stashed one after the other: only one part's shuffle files are there at a time."""
    out = None
    for part in range(parts):
        one = stash(make(part))
        free_shuffles(spark)
        out = one if out is None else out.unionByName(one)
    return out


def _removed(docs: DataFrame, size: int, buckets: int, total: int, seed: int) -> DataFrame | None:
    """_id, _key, starts, counts of the windows to remove; None if two different spans met under the seed's key."""
    spark, secret = docs.sparkSession, Key(seed)
    real = docs.where("doc_id is not null")
    judged = stash(_judged(_anchored(real, size, buckets, secret)))
    free_shuffles(spark)
    if not judged.where(F.col("want") == CLASH).isEmpty():
        drop_stash(judged)
        return None
    asked = stash(_asked(judged, size, seed))
    free_shuffles(spark)
    found = stash(_by_document(real, judged, asked, size))
    for x in (judged, asked):
        drop_stash(x)
    free_shuffles(spark)
    pick = lambda w: F.first(F.when(F.col("want") == w, F.struct(F.col("want"), F.col("starts"), F.col("counts"))), ignorenulls=True)
    parts = min(PARTS, 1 + total // PART_BYTES)

    def with_text(part: int) -> DataFrame:
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == part
        own = found.where(mine("_id"))
        wanted = own.where(F.col("want") > GONE).groupBy("_id", "_key").agg(pick(OPEN).alias("open"), pick(BUSY).alias("busy"))
        wanted = wanted.join(digests.by_document(own, "_id", "_key"), ["_id", "_key"], "full")
        return docs.where(mine("doc_id")).join(wanted.hint("merge"), (docs.doc_id == F.col("_id")) & (docs.key == F.col("_key"))).select("doc_id", "key", "text", "open", "busy", "asks")

    texts = _in_parts(with_text, parts, spark)
    if not digests.all_equal(_digests(texts, secret.salt)):
        for x in (found, texts):
            drop_stash(x)
        return None
    to_sort = texts.select("doc_id", "key", "text", F.explode(F.filter(F.array("open", "busy"), lambda w: w.isNotNull())).alias("w")).select("doc_id", "key", "text", "w.*")
    # A span to sort brings its windows' bytes and its name: twice the window's size at most, about.
    spans_ = found.where(F.col("want") > GONE).agg(F.sum(F.length("counts"))).first()[0] or 0
    rounds = min(buckets, 1 + 2 * size * spans_ // max(total // 2, PART_BYTES))
    fine = _in_parts(lambda part: _sorted(_segments(to_sort, size, buckets, secret, part, rounds), size, secret), rounds, spark)
    drop_stash(texts)
    return found.where(F.col("want") == GONE).select("_id", "_key", "starts", "counts").unionByName(fine)


def dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left) of every document.

    docs must give the same rows in the same order when read twice (a table does).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    total = text_bytes(docs)
    buckets, gone = buckets_for(docs, total=total), None
    for seed in range(1, _TRIES + 1):
        if gone is None:
            gone = _removed(docs, size, buckets, total, seed)
    if gone is None:
        raise RuntimeError("hashes of different spans met under every key")
    same = (docs.doc_id == F.col("_id")) & (docs.key == F.col("_key"))
    gone = gone.groupBy("_id", "_key").agg(F.collect_list(F.struct("starts", "counts")).alias("found"))
    joined = docs.join(gone.hint("merge"), same, "left").select("doc_id", "text", "found")

    def run(batches):
        for b in batches:
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                for f in found or ():
                    start = np.frombuffer(f["starts"], "<u4").astype(np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + np.frombuffer(f["counts"], np.uint8).astype(np.int64) + size - 1, -1)
                off = np.cumsum(edge[:-1]) > 0
                kept = raw[~off].tobytes()
                out.append((len(raw), int(off.sum()), int((off[1:] & ~off[:-1]).sum() + off[:1].sum()), hashlib.sha256(kept).hexdigest(), kept))
            cols = zip(*out) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


# Bytes are pairs of hexadecimal digits.
ORACLE = """
WITH t AS MATERIALIZED (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(range(1, CAST(length(x) // 2 - 48 AS BIGINT))) AS p FROM t WHERE length(x) >= 100),
h AS MATERIALIZED (SELECT doc_id, p, md5(substring(x, 2 * p - 1, 100)) AS h FROM w),
m AS (SELECT h, min(doc_id) AS low FROM h GROUP BY h HAVING count(*) > 1),
b AS (SELECT h.doc_id, h.p FROM h JOIN m ON h.h = m.h WHERE h.doc_id > m.low),
o AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM b),
r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS after, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM s),
k AS (SELECT t.doc_id, string_agg(substring(x, 2 * after - 1, 2 * (a - after)), '' ORDER BY a) || coalesce(max(CASE WHEN back = 1 THEN substring(x, 2 * z - 1) END), '') AS kept,
  count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed FROM e JOIN t ON e.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT t.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
