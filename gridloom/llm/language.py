"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed
greedily into the longest phrases that occur in that text (plus the character that ends
the match); the language whose automaton needs the fewest phrases per character wins.

Texts are lower-cased, runs of what is not a letter become one space, and parsing
restarts every PIECE characters, so that all pieces of many texts advance together, one
array operation per character position. Training text is, for each language, at most
`sample_rows` labelled documents (those of the smallest id hashes) and `sample_chars`
characters. Every character of it counts: transitions by the most frequent characters are
tables of a fixed size in all, the others are sorted edges.

Edge cases: a text that is null or has no letter is `und` with score 0, as is every
text if no labelled text has a letter. Ties go to the smaller language name. Repeated
doc_ids are predicted row by row; null languages are not learned from; other columns
are not read. score is the share of the runner-up's phrases in the winner's and its
together (0.5: no difference; towards 1: clear), and 1 if only one language is known.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, drop_stash, held_out, lean, stash

PIECE = 256
#: Most cells of all transition tables (4 bytes each); what they do not hold is in sorted edges.
CELLS = 1 << 25
#: A language's keys are counted in 2 to this many slices.
SLICE_BITS = 12
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_AUTOMATA: dict[tuple, tuple] = {}


def normal(text: str | None) -> str:
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


class Automaton:
    """All substrings of a text: transitions by symbols under `width` in a table, by others in sorted edges; 0: none."""

    def __init__(self, text: np.ndarray, width: int):
        moves = transitions(text)
        self.table = np.zeros((len(moves), width + 1), np.uint16 if len(moves) <= 1 << 16 else np.uint32)
        edges = []
        for state, m in enumerate(moves):
            for c, to in m.items():
                if c < width:
                    self.table[state, c] = to
                else:
                    edges.append((c << 32 | state, to))
        edges = np.array(sorted(edges), np.int64).reshape(-1, 2)
        self.keys, self.to = np.append(edges[:, 0], 1 << 62), np.append(edges[:, 1], 0)

    def rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = symbol.astype(np.int64) << 32 | state
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], 0)


def transitions(text: np.ndarray) -> list[dict[int, int]]:
    """For each state of the automaton of all substrings, symbol -> state; nothing leads to the start, 0."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def automata(samples: tuple[tuple[str, str], ...]) -> tuple[list[str], np.ndarray, list[Automaton]]:
    """Names, the symbol of each character (the last: not in the samples), one automaton each."""
    if samples not in _AUTOMATA:
        _AUTOMATA.clear()
        known = _alphabet(t for _, t in samples)
        symbol = np.full(0x110000, len(known), np.int32)
        symbol[[ord(c) for c in known]] = np.arange(len(known))
        width = min(len(known), max(CELLS // (2 * sum(len(t) for _, t in samples) + 1) - 1, 0))
        tables = [Automaton(symbol[_points(t)], width) for _, t in samples]
        _AUTOMATA[samples] = ([n for n, _ in samples], symbol, tables)
    return _AUTOMATA[samples]


def _alphabet(texts) -> list[str]:
    """The characters of the samples, the most frequent first."""
    counts = Counter()
    for t in texts:
        counts.update(t)
    return sorted(counts, key=lambda c: (-counts[c], c))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def phrases(automaton: Automaton, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each row of grid (by column: the symbols of a piece), all rows in step.

    Rows must be in descending order of length.
    """
    width = automaton.table.shape[1]
    flat = automaton.table.ravel()
    common = np.minimum(grid, width - 1)
    some = (grid >= width - 1).any(1) if len(automaton.to) > 1 else np.zeros(len(grid), bool)
    state = np.zeros(len(lengths), np.int32)
    count = np.zeros(len(lengths), np.int32)
    live = np.searchsorted(-lengths, -np.arange(grid.shape[0]), side="left")
    for i in range(grid.shape[0]):
        n = live[i]
        to = flat[state[:n] * width + common[i, :n]]
        if some[i]:
            where = np.flatnonzero(grid[i, :n] >= width - 1)
            to[where] = automaton.rare(state[where], grid[i, where])
        count[:n] += to == 0
        state[:n] = to
    return count + (state > 0)


def parse_counts(texts: list[str], samples) -> np.ndarray:
    """[text, language] phrases of normalised texts."""
    names, symbol, tables = automata(samples)
    out = np.zeros((len(texts), len(names)), np.int64)
    sizes = np.array([len(t) for t in texts])
    symbols = symbol[_points("".join(texts))]
    start = np.cumsum(sizes) - sizes
    per = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(texts)), per)
    if not len(owner):
        return out
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = start[owner] + nth * PIECE
    lengths = np.minimum(PIECE, sizes[owner] - nth * PIECE)
    order = np.argsort(-lengths, kind="stable")
    at, lengths, owner = at[order], lengths[order], owner[order]
    steps = np.arange(lengths[0])[:, None]
    grid = symbols[np.minimum(at[None, :] + steps, len(symbols) - 1)]
    for j, table in enumerate(tables):
        out[:, j] = np.bincount(owner, phrases(table, grid, lengths), len(texts))
    return out


def predict(texts: list[str | None], samples) -> tuple[list[str], np.ndarray]:
    clean = [normal(t) for t in texts]
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    if not samples:
        return names, score
    lo = 0
    while lo < len(clean):
        hi, total = lo + 1, len(clean[lo])
        while hi < len(clean) and total + len(clean[hi]) <= 1 << 20:
            total += len(clean[hi])
            hi += 1
        counts = parse_counts(clean[lo:hi], samples)
        best = counts.argmin(1)
        for i in range(lo, hi):
            if clean[i]:
                row = counts[i - lo]
                names[i] = samples[best[i - lo]][0]
                rest = np.delete(row, best[i - lo]).min(initial=2**62)
                score[i] = rest / (rest + row.min())
        lo = hi
    return names, score


def learn(docs: DataFrame, sample_rows: int = 4000, sample_chars: int = 1 << 15) -> tuple[tuple[str, str], ...]:
    """(language, training text) by name, from at most sample_rows rows."""
    bounded_batches(docs.sparkSession)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = stash(known.select("doc_id", "lang", F.xxhash64("doc_id").alias("key")).withColumn("slice", F.shiftright("key", 64 - SLICE_BITS)))
    # Counts by slices of the keys tell up to where a language's sample can reach, so that a frequent language's rows are not all ranked in one task.
    below = F.sum("count").over(Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    reach = known.groupBy("lang", "slice").count().withColumn("below", F.coalesce(below, F.lit(0))).where(F.col("below") < sample_rows)
    near = known.join(F.broadcast(reach.groupBy("lang").agg(F.max("slice").alias("last"))), "lang").where("slice <= last")
    first = Window.partitionBy("lang").orderBy("key", "doc_id")
    ids = near.select("doc_id", "lang", "key").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_rows)
    rows = docs.select("doc_id", "text", "lang").where("text is not null").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def shorten(batches):  # what one document can add to a language's sample
        for b in batches:
            texts = [normal(t)[:sample_chars] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("lang"), pa.array(texts, pa.string())], ["key", "lang", "text"])

    rows = rows.select(F.xxhash64("doc_id").alias("key"), "lang", "text").mapInArrow(lean(shorten), "key long, lang string, text string").where("text <> ''")
    # Only the rows that fill a language's sample are sent.
    before = Window.partitionBy("lang").orderBy("key", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("have", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(F.col("have") < sample_chars)
    texts: dict[str, list[str]] = {}
    for key, lang, text in sorted(rows.select("key", "lang", "text").collect()):
        texts.setdefault(lang, []).append(text)
    drop_stash(known)
    return tuple((name, " ".join(texts[name])[:sample_chars]) for name in sorted(texts))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))

    def run(batches):
        for b in batches:
            names, score = predict(b.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def readable(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are in no language (`und`), all columns kept.

    Where no language could be learned, documents without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            keep = [n != "und" for n in predict(texts, shared.value)[0]] if shared.value else [bool(normal(t)) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
