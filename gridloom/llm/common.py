"""Shared helpers of the training-data operators: tables, scratch storage, text blocks.

Text blocks are the vectorised core of the Python operators: the texts of one Arrow
batch are cut into blocks of a few megabytes, and words, hashes and windows of a whole
block are found by array operations, so no Python code runs per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once; bounds a worker's memory at about forty times this.
BLOCK_BYTES = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch storage


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of its own only where Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete a stash that no later result reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/stash-" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live DataFrame needs, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default: texts are long, and a batch is held whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return what a finished task has freed to the system; idle workers stay, and their memory counts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def spare_lasting() -> None:
    """Once in a process, exempt what lasts (modules above all) from garbage collection, which Spark's workers do in full after each task."""
    gc.freeze()


def lean(run):
    """A mapInArrow function that gives memory back at its end."""

    def wrapped(batches):
        spare_lasting()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def held_out(doc_id: str = "doc_id"):
    """True where the row must not be learned from; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, *keep: str) -> DataFrame:
    """At most max_rows training rows (doc_id, text, label): those of the smallest id hashes.

    Rows that are held out, or have a null id, text or label, never enter; where labels
    repeat a doc_id, its largest label counts.
    """
    y = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(y), "doc_id").select("doc_id", "text", "y", *keep)


# ---------------------------------------------------------------- hashing

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        y = x >> U64(30)
        y ^= x
        y *= U64(0xBF58476D1CE4E5B9)
        y ^= y >> U64(27)
        y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 1024)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.full(n, x, U64) for x in (self.base, self.inverse))
                self.up[0] = self.down[0] = 1
                np.cumprod(self.up, out=self.up)
                np.cumprod(self.down, out=self.down)
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}


class Rolling:
    """Prefix polynomial hashes of a sequence: the hash of any slice in two reads."""

    def __init__(self, symbols: np.ndarray, base: int = _PRIME):
        if base not in _POWERS:
            while len(_POWERS) > 4:
                _POWERS.pop(next(iter(_POWERS)))
            _POWERS[base] = _Powers(base)
        powers = _POWERS[base]
        up, self.down = powers.upto(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, U64)
        with np.errstate(over="ignore"):
            np.multiply(symbols, up[: len(symbols)], out=self.prefix[1:], casting="unsafe", dtype=U64)
            np.cumsum(self.prefix, out=self.prefix)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), mixed with the length."""
        with np.errstate(over="ignore"):
            return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def each(self, lo: int, hi: int, n: int) -> np.ndarray:
        """Hashes of the n symbols from each of the positions lo..hi on, as slices gives them."""
        with np.errstate(over="ignore"):
            x = self.prefix[lo + n : hi + n] - self.prefix[lo:hi]
            x *= self.down[lo:hi]
            x += U64(n * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        return mix(x)


#: A random value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

#: Longer slices have equal polynomial hashes modulo 2**64 more often than by chance (from 1,024 symbols on, for every base).
_LONG = 64


class Key:
    """The secret of one run: byte values, an odd base and a key for digests, drawn from a seed."""

    def __init__(self, seed: int):
        x = mix(np.arange(300, dtype=U64) + mix(np.array([seed], U64))[0])
        self.values, self.base, self.salt = x[:256], int(x[256]) | 1, x[257:259].tobytes()

    def word_hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of slices; those of many bytes by a keyed cryptographic digest."""
        out = Rolling(self.values[data], self.base).slices(start, end)
        for i in np.flatnonzero(end - start > _LONG):
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=self.salt).digest(), "little")
        return out


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what the number of buckets is chosen by."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(docs: DataFrame, bucket_bytes: int = 1 << 24, total: int | None = None) -> int:
    """Buckets of the hash space of about bucket_bytes of text each, two for each shuffle partition at least.

    A block of texts sends a row to each bucket, so there are 2**14 at most. total: text_bytes, where known.
    """
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-(text_bytes(docs) if total is None else total) // bucket_bytes)), 1 << 14)


# ---------------------------------------------------------------- text blocks


class Block:
    """Texts of some rows as one byte array; rows are lo..hi of the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        base = int(offsets[lo])
        self.bytes = data[base : int(offsets[hi])]
        self.offsets = (offsets[lo : hi + 1] - base).astype(np.int64)

    @property
    def n(self) -> int:
        return self.hi - self.lo


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = 0) -> Iterator[Block]:
    """Blocks of at most BLOCK_BYTES, or of one longer text; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (limit or BLOCK_BYTES), side="right")) - 1)
        yield Block(raw, offsets, lo, min(hi, len(texts)))
        lo = min(hi, len(texts))


def runs(kind: np.ndarray, offsets: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal kind other than skip, cut at text bounds."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(kind), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(kind)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(kind))
    use = kind[start] != skip
    return start[use], end[use]


#: White space that parts words: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORDS = (~SPACE).astype(np.uint8)


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row bounds (index of each text's first word) of white-space words."""
    start, end = runs(_WORDS[block.bytes], block.offsets)
    return start, end, np.searchsorted(start, block.offsets)


def window_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where size symbols of one text begin, and the text of each."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[text] + bounds[text], text


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each size consecutive values, by doubling."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
