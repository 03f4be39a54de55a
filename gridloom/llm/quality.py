"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Tokens are maximal runs of word bytes (letters, digits, bytes over 127) or of other
printable bytes; features are single tokens and pairs of neighbours (a token beside
itself is one feature, whichever token it is), hashed to 2**bits slots, and a feature's value is SCALE * count / number of features. A text's score is the
logistic function of one sparse dot product.

The model is fitted on at most `sample_rows` labelled rows (those of the smallest id
hashes) with per-coordinate FTRL-proximal updates; its size is fixed by `bits`.

Edge cases: null and empty texts have no features and score the bias; null labels and
rows without a text are not learned from; with no usable label the score is 0.5.
Repeated doc_ids are scored row by row; further columns of the tables are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BYTE_VALUE, Rolling, U64, blocks, held_out, labelled_sample, mix, runs

SCALE = 30.0

_TWICE = mix(np.array([2], U64))[0]

_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


@dataclass(frozen=True)
class Model:
    bits: int
    weights: np.ndarray
    bias: float


def features(block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a block's token n-grams, and the text of each."""
    start, end = runs(_KIND[block.bytes], block.offsets)
    h = Rolling(BYTE_VALUE[block.bytes]).slices(start, end)
    row = np.searchsorted(block.offsets, start, side="right") - 1
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * U64(3) + h[1:])
    same = row[:-1] == row[1:]
    pair[h[:-1] == h[1:]] = _TWICE
    slot = np.concatenate([h, pair[same]]) >> U64(64 - bits)
    return slot.astype(np.int64), np.concatenate([row, row[:-1][same]])


def fit(rows: list[tuple[int, np.ndarray]], bits: int = 20, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5) -> Model:
    """FTRL-proximal over (label, slots) rows in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    packed = []
    for y, slots in rows:
        f, c = np.unique(slots, return_counts=True)
        packed.append((y, f, SCALE * c / max(len(slots), 1)))
    for _ in range(epochs):
        for y, f, x in packed:
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            g = (p - y) * x
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
            gb = p - y
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * b
            nb += gb * gb
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(bits, w.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def _slots_of(bits: int):
    def run(batches):
        for batch in batches:
            ids, ys, out = batch.column("doc_id"), batch.column("y"), []
            for block in blocks(batch.column("text")):
                slot, row = features(block, bits)
                slot = slot[np.argsort(row, kind="stable")].astype(np.int32)
                out += np.split(slot, np.searchsorted(np.sort(row), np.arange(1, block.n)))
            yield pa.RecordBatch.from_arrays([ids, ys, pa.array(out, pa.list_(pa.int32()))], ["doc_id", "y", "slots"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 4000, bits: int = 20) -> Model:
    rows = labelled_sample(docs, labels, label, sample_rows).mapInArrow(_slots_of(bits), "doc_id long, y int, slots array<int>").toArrow()
    keys = mix(np.asarray(rows["doc_id"]).astype(U64))
    order = np.argsort(keys, kind="stable")
    y, slots = np.asarray(rows["y"]), rows["slots"].combine_chunks()
    off, flat = np.asarray(slots.offsets), np.asarray(slots.values)
    return fit([(int(y[i]), flat[off[i] : off[i + 1]]) for i in order], bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) with score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            parts = [np.zeros(0)]
            for block in blocks(batch.column("text")):
                slot, row = features(block, m.bits)
                count = np.maximum(np.bincount(row, minlength=block.n), 1)
                parts.append(np.bincount(row, m.weights[slot], block.n) * SCALE / count + m.bias)
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, labels, **options))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
