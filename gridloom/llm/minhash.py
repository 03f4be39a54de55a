"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, exact verification.

A document is the multiset of its five-word shingles (words lower-cased; a text of
fewer words is one shingle). Each unit of a shingle's weight is the source of a Poisson
process of points, each with a time and one of m signature slots; weights are
discretised into dyadic levels, whose processes are split downwards (a point of a level
only counts if it falls below the weight), so two documents share a shingle's points up
to the smaller weight. A slot holds its earliest point: slots of two documents agree with
probability equal to their weighted Jaccard similarity.

Documents of equal words are one text: their lower-cased words have one 128-bit BLAKE2b digest.
Texts that agree in a band of `rows` slots are
candidates. Each text is first verified against the smallest id of its bands. Within bands
that still hold several classes, each text is then verified, in a few rounds, against the
texts of other classes whose signatures are most like its own; what is joined in a round
need not be compared in the next. In the end all remaining pairs of different classes are
compared whose signatures and sizes allow the threshold (by four standard deviations), so
no link is lost for want of a comparison: bands take their texts' multisets along (as
32-bit hashes) and compare within, each pair in the first band it shares, and only pairs
that reach the threshold, or lie too near it for such hashes, leave the band. Every link
is verified on whole multisets. Classes are the connected components of verified links.

Edge cases: null and empty texts have no shingles and are in no one else's class; rows
with a null doc_id keep a null class; rows that repeat a doc_id share its class; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import U64, Key, Rolling, blocks, bounded_batches, free_shuffles, lean, mix, stash, window_starts, words
from gridloom.llm.graph import components

SHINGLE = 5
_KEY = Key(0)
#: Texts of a band that are compared with each other in one group.
CHUNK = 512
#: What groups are told apart by, and pairs of signatures that are compared at once.
_GROUP, _PAIRS = ("band", "kind", "x", "y"), 1 << 14
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP, _LEVEL = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def shingles(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight) of a block's distinct shingles."""
    start, end, bounds = words(block)
    seq = Rolling(_KEY.word_hashes(_LOWER[block.bytes], start, end), _KEY.base)
    at, row = window_starts(bounds, SHINGLE)
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE))
    value = np.concatenate([seq.slices(at, at + SHINGLE), seq.slices(bounds[short], bounds[short + 1])])
    row = np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def text_keys(block) -> np.ndarray:
    """[text, 2]: halves of a digest of each text's words."""
    raw, off = block.bytes.tobytes().lower(), block.offsets.tolist()
    keys = [hashlib.blake2b(b" ".join(raw[a:z].split()), digest_size=16).digest() for a, z in zip(off, off[1:])]
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def _level(i: int) -> np.uint64:
    return U64(i * int(_LEVEL) % 2**64)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """[text, slot] identities of earliest points, 0 for texts without shingles."""
    sums = np.bincount(row, weight, n)
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    todo, stretch = np.flatnonzero(sums > 0), 1.0
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = stretch * m * (np.log(m) + 4) / sums[todo]
        low, level = 0, 0
        live = np.flatnonzero(limit[row] > 0)
        while len(live):  # one dyadic level of weights after the other: [0,1), [1,2), [2,4), ...
            size = max(low, 1)
            r, w, seed = row[live], weight[live], mix(value[live] + _level(level))
            time, i = np.zeros(len(live)), 0
            while len(r):
                with np.errstate(over="ignore"):
                    a = mix(seed + U64(2 * i + 1) * _STEP)
                    b = mix(seed + U64(2 * i + 2) * _STEP)
                time = time - np.log(_uniform(a)) / size
                alive = time <= limit[r]
                r, w, seed, time, b = r[alive], w[alive], seed[alive], time[alive], b[alive]
                counts = low + (b >> U64(40)) % U64(size) < w
                slot = r[counts] * m + ((b[counts] & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)
                packed = (time[counts].astype(np.float32).view(np.uint32).astype(np.uint64) << U64(32)) | (mix(b[counts]) >> U64(32))
                np.minimum.at(best, slot, packed)
                i += 1
            low, level = low + size, level + 1
            live = live[weight[live] > low]
        empty = (best.reshape(n, m)[todo] == np.iinfo(np.uint64).max).any(1)
        todo, stretch = todo[empty], stretch * 2
    out = (best & U64(0xFFFFFFFF)).astype(np.uint32).reshape(n, m)
    out[sums == 0] = 0
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[text, band] keys of signatures, different for different bands."""
    sig = sig[:, : bands * rows].reshape(-1, bands, rows).astype(U64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=U64) * _LEVEL, sig.shape[:2])
        for j in range(rows):
            key = mix(key * U64(3) + sig[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, m: int, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2 (a digest of the words), n (shingles), sig (m values of 4 bytes), keys (of its bands)."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 20):
                row, value, weight = shingles(block)
                key = text_keys(block)
                sig = bag_minhash(row, value, weight, block.n, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[block.lo : block.hi],
                        *(pa.array(key[:, j]) for j in (0, 1)),
                        pa.array(np.bincount(row, weight, block.n).astype(np.int64)),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * bands), pa.array(band_keys(sig, bands, rows).ravel())),
                    ],
                    ["doc_id", "k1", "k2", "n", "sig", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, k1 long, k2 long, n long, sig binary, keys array<long>")


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for block in blocks(texts, 1 << 20):
        row, value, weight = shingles(block)
        cut = np.searchsorted(row, np.arange(block.n + 1))
        out += [(value[a:b], weight[a:b]) for a, b in zip(cut, cut[1:])]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    both = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum() if len(a[0]) else 0
    return both / max(a[1].sum() + b[1].sum() - both, 1)


def verify(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose whole multisets reach the threshold.

    Pairs are stars around a. A star's rows go to parts of about 64 members, each with the
    centre's text in front, so one text of many copies is not one task's work and a task
    holds one centre at a time.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts"))
    members = pairs.join(sizes, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("star"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("nth"))
    centres = sizes.select(F.col("a").alias("doc_id"), F.col("a").alias("star"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("nth"))
    wanted = members.unionByName(centres)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "star", "part", "nth", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "star", "part").sortWithinPartitions("star", "part", "nth")

    def run(batches):
        centre, bag = None, None
        for b in batches:
            a_out, b_out = [], []
            keys = zip(*(b.column(c).to_pylist() for c in ("star", "part", "nth", "doc_id")))
            for (star, part, nth, doc), own in zip(keys, _bags(b.column("text"))):
                if nth == 0:
                    if centre != (star, part):
                        centre, bag = (star, part), own
                elif similarity(bag, own) >= threshold:
                    a_out.append(star)
                    b_out.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def _chunked(classed: DataFrame) -> DataFrame:
    """Texts (nth, doc_id, class, own) of each band of several classes by pairs of chunks (x, y): a group (_GROUP) holds at most about 2 * CHUNK texts whatever the band's size.

    Texts of one class need no comparing, so those of a band's largest class meet only the
    others (kind 0; x: a chunk of the largest class, y: of the others; own is -1 in the largest class); the others also
    meet among themselves (kind 1, x <= y). A band that a class fills but for a few texts is copied once for each chunk
    of these few, not for each of its own.
    """
    chunks = lambda n: F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int")
    sizes = classed.groupBy("band", "class").agg(F.count("*").alias("_n")).groupBy("band").agg(F.max(F.struct("_n", "class")).alias("_top"), F.sum("_n").alias("_all"))
    sizes = sizes.where("_all > _top._n").select("band", F.col("_top.class").alias("_class"), chunks(F.col("_top._n")).alias("_main"), chunks(F.col("_all") - F.col("_top._n")).alias("_rest"))
    rows = classed.join(sizes, "band").withColumn("main", F.col("class") == F.col("_class"))
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    own_main, own_rest = deal(F.col("_main")), deal(F.col("_rest"))
    across = F.when(F.col("main"), F.transform(upto(F.col("_rest")), lambda y: group(0, own_main, y))).otherwise(F.transform(upto(F.col("_main")), lambda x: group(0, x, own_rest)))
    among = F.transform(upto(F.col("_rest")), lambda o: group(1, F.least(own_rest, o), F.greatest(own_rest, o)))
    rows = rows.withColumn("own", F.when(F.col("main"), -1).otherwise(own_rest)).withColumn("g", F.explode(F.when(F.col("main"), across).otherwise(F.concat(across, among))))
    return rows.select("band", "g.kind", "g.x", "g.y", "own", "nth", "doc_id", "class")


def _by_group(texts: DataFrame, run, schema: str) -> DataFrame:
    """run(table) on tables of whole groups. They are dealt by group, not by band: the chunks of a frequent band are many tasks' work."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)

    def whole(batches):
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
            if t.num_rows:
                last = int(np.flatnonzero(_starts(t))[-1])
                kept = t.slice(last)
                if last:
                    yield run(t.slice(0, last))
        if kept is not None:
            yield run(kept)

    return texts.mapInArrow(lean(whole), schema)


def _starts(t: pa.Table) -> np.ndarray:
    """Which rows begin a group."""
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (t.column(c).to_numpy() for c in _GROUP)], axis=0)
    return new


def _pairs(t: pa.Table, m: int, ratio: float, cls: np.ndarray):
    """Slices (i, j, equal slots) of the pairs of rows to compare: of one group, of different classes (as cls is by then) and of sizes within ratio."""
    kind, x, y, own, n = (t.column(c).to_numpy() for c in ("kind", "x", "y", "own", "n"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, m)
    bounds = np.append(np.flatnonzero(_starts(t)), len(n))
    later = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(n)) - 1
    total, lo = np.append(0, np.cumsum(later)), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), later[lo:hi])
        j = np.arange(len(i)) - (total[i] - total[lo]) + i + 1
        use = (cls[i] != cls[j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]))
        use &= np.where(kind[i] == 0, (own[i] < 0) != (own[j] < 0), (x[i] == y[i]) | (own[i] != own[j]))
        yield i[use], j[use], sig[i[use]] == sig[j[use]]
        lo = hi


def _best_pairs(texts: DataFrame, m: int, least: float, ratio: float, best: int) -> DataFrame:
    """For each text of a group the `best` of other classes whose signatures are most like its own."""

    def run(t: pa.Table) -> pa.RecordBatch:
        ids, found = t.column("doc_id").to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j, same in _pairs(t, m, ratio, t.column("class").to_numpy()):
            like = same.mean(1)
            near = like >= least
            found.append((i[near], j[near], like[near]))
        i, j, like = (np.concatenate(x) for x in zip(*found))
        i, j, like = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(like, 2)
        order = np.lexsort((ids[j], -like, i))
        i, j = i[order], j[order]
        use = np.arange(len(i)) - np.searchsorted(i, i) < best
        a, b = ids[i[use]], ids[j[use]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return _by_group(texts, run, "a long, b long").distinct()


def _bag_hashes(pool: DataFrame) -> DataFrame:
    """doc_id, n, sig, bag: sorted 32-bit hashes of (shingle, occurrence)."""

    def run(batches):
        for b in batches:
            out = []
            for value, weight in _bags(b.column("text")):
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                out.append(np.unique((mix(np.repeat(value, weight) + nth.astype(U64) * _STEP) >> U64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n", "sig")), pa.array(out, pa.binary())], ["doc_id", "n", "sig", "bag"])

    return pool.mapInArrow(lean(run), "doc_id long, n long, sig binary, bag binary")


def _all_pairs(texts: DataFrame, m: int, bands: int, width: int, least: float, threshold: float) -> DataFrame:
    """All pairs of different classes that may reach the threshold, less those that links found beside them make needless."""

    def run(t: pa.Table) -> pa.RecordBatch:
        ids, nth, cls = (t.column(c).to_numpy() for c in ("doc_id", "nth", "class"))
        bags, cls, out = [np.frombuffer(x, np.uint32) for x in t.column("bag").to_pylist()], cls.copy(), []
        for i, j, same in _pairs(t, m, threshold, cls):
            first = same[:, : bands * width].reshape(-1, bands, width).all(2).argmax(1) == nth[i]
            near = first & (same.mean(1) >= least)
            for x, y in zip(i[near], j[near]):
                if cls[x] == cls[y]:
                    continue
                both = np.intersect1d(bags[x], bags[y], assume_unique=True).size
                close = both / max(len(bags[x]) + len(bags[y]) - both, 1)
                if close >= threshold - 0.01:
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                if close >= threshold + 0.01:
                    cls[cls == cls[y]] = cls[x]
        a, b = (np.array([p[k] for p in out], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _by_group(texts, run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 24, rows: int = 5, more_slots: int = 30, rounds: int = 1) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), keep (it is that document), for each row of docs.

    A signature has bands * rows slots for the bands and more_slots that only sharpen estimates.
    """
    bounded_batches(docs.sparkSession)
    m = bands * rows + more_slots
    slack = threshold - 4 * (threshold * (1 - threshold) / m) ** 0.5
    sigs = stash(signatures(docs, m, bands, rows))
    texts = sigs.where("n > 0 and doc_id is not null")
    copies = stash(texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("text_id"), F.first("keys").alias("keys")))
    keyed = copies.select(F.col("text_id").alias("doc_id"), F.posexplode("keys").alias("nth", "band"))
    shared = keyed.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    keyed = stash(keyed.join(shared.select("band", "low"), "band"))
    free_shuffles(docs.sparkSession)
    # Only texts with a candidate are ever read again.
    heads = texts.select("doc_id", "n", "sig").join(keyed.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    pool = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(heads.hint("merge"), "doc_id"))
    free_shuffles(docs.sparkSession)
    tried = stash(keyed.where("doc_id > low").groupBy(F.col("doc_id").alias("b")).agg(F.min("low").alias("a")).select("a", "b"))
    links = stash(verify(pool, tried, threshold))
    label = components(links)
    for last in [False] * rounds + [True]:
        classed = keyed.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "nth", "doc_id", F.coalesce("label", "doc_id").alias("class"))
        signed = (_bag_hashes(pool) if last else pool.select("doc_id", "n", "sig")).dropDuplicates(["doc_id"])
        near = _chunked(classed).join(signed.hint("merge"), "doc_id")
        more = _all_pairs(near, m, bands, rows, slack, threshold) if last else _best_pairs(near, m, slack, threshold, 2)
        # The last round's pairs leave one band each, and few near enough to leave it have been tried in vain.
        more = stash(more if last else more.join(tried, ["a", "b"], "left_anti"))
        free_shuffles(docs.sparkSession)
        if more.isEmpty():
            continue
        tried = tried.unionByName(more)
        new = stash(verify(pool, more, threshold))
        free_shuffles(docs.sparkSession)
        if not new.isEmpty():
            links = links.unionByName(new)
            label = components(links)
    named = copies.join(label.withColumnRenamed("node", "text_id"), "text_id", "left").select("k1", "k2", F.coalesce("label", "text_id").alias("class_id"))
    out = sigs.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("keep"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, that of the smallest id; documents without a doc_id stay."""
    # Written first: if they are few, Spark sees it and broadcasts them rather than shuffle the texts.
    gone = stash(near_duplicates(docs, **options).where("not keep").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
