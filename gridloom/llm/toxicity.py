"""Toxicity: a factorisation machine over hashed terms.

Terms are lower-cased words and their prefixes of 4, 5 and 6 bytes, so that inflected
forms share evidence; each is a 64-bit hash. A text's score is the logistic function of
  w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j
with x_i 1 for each distinct term it holds; the pairwise part lets two harmless terms
weigh together what neither weighs alone.

The machine is fitted on at most `sample_rows` labelled rows (those of the smallest id
hashes), in two turns. The first gives parameters to terms that tell something alone: those
of a chi-squared statistic over 6.6 (at most `max_terms`, seen in `min_rows` rows at least). The
second looks for pairs in what the first left unexplained: over the `pair_terms` terms that split
the sample most evenly, the residual is summed over the rows that hold both terms of each pair; a
sum of over seven standard deviations that neither term shows alone gives both terms
parameters, and the machine is fitted again from there (at most `max_pairs`, the strongest). So
terms that are neutral alone and tell only beside others are learned.

Edge cases: null and empty texts have no terms and score the intercept; null labels and
rows without a text are not learned from; with no usable label, or labels of one kind
only, the score is the smoothed share of toxic labels (0.5 without any). Repeated doc_ids
are scored row by row; further columns of the tables are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BYTE_VALUE, Rolling, U64, blocks, held_out, labelled_sample, mix, runs

PREFIXES = (4, 5, 6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = 1
_WORD[128:] = 1


@dataclass(frozen=True)
class Machine:
    """terms is sorted; linear and factors follow its order."""

    terms: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray


def terms_of(block) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a block with repeats, and the text of each."""
    start, end = runs(_WORD[block.bytes], block.offsets)
    rolling = Rolling(BYTE_VALUE[_LOWER[block.bytes]])
    row = np.searchsorted(block.offsets, start, side="right") - 1
    hashes, rows = [rolling.slices(start, end)], [row]
    for k in PREFIXES:
        long = end - start > k
        hashes.append(rolling.slices(start[long], start[long] + k))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, term) once, by text and term."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _raw(machine_parts, idx: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores of n texts, and each text's factor sums."""
    w0, w, v = machine_parts
    s = np.stack([np.bincount(row, v[idx, f], n) for f in range(v.shape[1])], 1)
    q = np.bincount(row, (v[idx] ** 2).sum(1), n)
    return w0 + np.bincount(row, w[idx], n) + 0.5 * ((s**2).sum(1) - q), s


def _train(y: np.ndarray, idx: np.ndarray, first: np.ndarray, v: np.ndarray, epochs: int, rate: float, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, linear, factors) of rows idx[first[i]:first[i+1]] by mini-batch AdaGrad, from factors v."""
    n, pos, (k, rank) = len(y), int(y.sum()), v.shape
    rng = np.random.default_rng(7)
    w0, w, v = float(np.log((pos + 1) / (n - pos + 1))), np.zeros(k), v.copy()
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full((k, rank), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for batch in np.array_split(order, max(1, n // 64)):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            local = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
            ids = idx[at]
            raw, s = _raw((w0, w, v), ids, local, len(batch))
            err = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[batch]) / len(batch)
            d0 = err.sum()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            u, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, err[local], len(u)) + l2 * w[u]
            gw[u] += dw * dw
            dv = np.stack([np.bincount(back, err[local] * (s[local, f] - v[ids, f]), len(u)) for f in range(rank)], 1) + l2 * v[u]
            gv[u] += dv * dv
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= 0.5 * rate * dv / np.sqrt(gv[u])
    return w0, w, v


def pairs(residual: np.ndarray, idx: np.ndarray, row: np.ndarray, k: int, max_pairs: int, least: float = 7.0) -> list[tuple[int, int, int]]:
    """(term, term, sign) of the pairs of k terms in whose common rows the residual is far from 0, the strongest first."""
    n, spread = len(residual), max(float((residual**2).mean()), 1e-12)
    held = np.zeros((n, k), np.float32)
    held[row, idx] = 1
    df = held.sum(0)
    alone = np.abs(residual @ held) / np.sqrt(spread * np.maximum(df, 1))
    weighted = held * residual[:, None].astype(np.float32)
    out = []
    for lo in range(0, k, 512):
        sums = weighted[:, lo : lo + 512].T @ held[:, lo:]
        # Two terms share at most the rows of the rarer one: a bound from below, then the exact figure.
        bound = np.abs(sums) / np.sqrt(spread * np.maximum(np.minimum(df[lo : lo + 512, None], df[None, lo:]), 1))
        for i, j in zip(*np.nonzero(bound > 0.6 * least)):
            a, b = lo + int(i), lo + int(j)
            both = residual[(held[:, a] > 0) & (held[:, b] > 0)]
            z = abs(both.sum()) / np.sqrt(max((both**2).sum(), spread * len(both)))
            if a < b and z > least and z > max(alone[a], alone[b]) + 2:
                out.append((z, a, b, 1 if sums[i, j] > 0 else -1))
    return [x[1:] for x in sorted(out, reverse=True)[:max_pairs]]


def fit(y: np.ndarray, off: np.ndarray, flat: np.ndarray, max_terms: int = 4096, min_rows: int = 4, pair_terms: int = 4096, max_pairs: int = 64, rank: int = 4, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4) -> Machine:
    """Fit to rows (y[i], terms flat[off[i]:off[i+1]])."""
    n, pos = len(y), int(y.sum())
    none = Machine(np.zeros(0, U64), float(np.log((pos + 1) / (n - pos + 1))), np.zeros(0, np.float32), np.zeros((0, rank), np.float32))
    if pos in (0, n):
        return none
    row = np.repeat(np.arange(n), np.diff(off))
    terms, inv = np.unique(flat, return_inverse=True)
    df = np.bincount(inv, minlength=len(terms))
    expected = df * (pos / n)
    chi2 = (np.bincount(inv, y[row], len(terms)) - expected) ** 2 * n / np.maximum(expected * (1 - pos / n) * (n - df + 1e-9), 1e-9)
    often = df >= min(min_rows, max(2, n // 100))
    chi2[~often] = 0
    kept = np.sort(np.argsort(-chi2, kind="stable")[:max_terms])
    kept = kept[chi2[kept] > 6.6]

    def trained(kept: np.ndarray, v: np.ndarray):
        slot = np.full(len(terms), -1)
        slot[kept] = np.arange(len(kept))
        use = slot[inv] >= 0
        idx, at = slot[inv][use], row[use]
        parts = _train(y, idx, np.searchsorted(at, np.arange(n + 1)), v, epochs, rate, l2)
        return parts, _raw(parts, idx, at, n)[0]

    noise = np.random.default_rng(7).normal(0, 0.02, (len(terms), rank))
    parts, raw = trained(kept, noise[kept])
    # In a second turn, the pairs of terms in what is left.
    even = np.sort(np.argsort(-np.minimum(df, n - df), kind="stable")[:pair_terms])
    slot = np.full(len(terms), -1)
    slot[even] = np.arange(len(even))
    use = slot[inv] >= 0
    found = pairs(y - 1 / (1 + np.exp(-np.clip(raw, -35, 35))), slot[inv[use]], row[use], len(even), max_pairs)
    if found:
        for r, (a, b, sign) in enumerate(found):
            noise[even[a], r % rank] += 0.3
            noise[even[b], r % rank] += 0.3 * sign
        kept = np.union1d(kept, even[[x for a, b, _ in found for x in (a, b)]])
        parts, _ = trained(kept, noise[kept])
    return Machine(terms[kept], parts[0], parts[1].astype(np.float32), parts[2].astype(np.float32))


def _terms_of_sample(batches):
    for batch in batches:
        out = []
        for block in blocks(batch.column("text")):
            h, row = _distinct(*terms_of(block))
            out += np.split(h.view(np.int64), np.searchsorted(row, np.arange(1, block.n)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "y", "terms"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 6000, **options) -> Machine:
    rows = labelled_sample(docs, labels, label, sample_rows).mapInArrow(_terms_of_sample, "doc_id long, y int, terms array<long>").toArrow()
    order = np.argsort(mix(np.asarray(rows["doc_id"]).astype(U64)), kind="stable")
    terms = rows["terms"].combine_chunks().take(pa.array(order))
    return fit(np.asarray(rows["y"])[order], np.asarray(terms.offsets), np.asarray(terms.values).view(U64), **options)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs(doc_id, text) with score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = shared.value
        seen = np.zeros(1 << 20, bool)
        seen[(m.terms >> U64(44)).astype(np.int64)] = True
        for batch in batches:
            parts = [np.zeros(0)]
            for block in blocks(batch.column("text")):
                h, row = terms_of(block)
                maybe = seen[(h >> U64(44)).astype(np.int64)]
                h, row = h[maybe], row[maybe]
                at = np.searchsorted(m.terms, h)
                hit = at < len(m.terms)
                hit[hit] = m.terms[at[hit]] == h[hit]
                ids, row = _distinct(at[hit].astype(U64), row[hit])
                parts.append(_raw((m.intercept, m.linear, m.factors), ids.astype(np.int64), row, block.n)[0])
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, labels, **options))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
