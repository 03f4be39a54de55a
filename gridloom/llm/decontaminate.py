"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are compared lower-cased (ASCII) with runs of white space as one space. An item is
found where the smallest edit distance of the whole item to any part of the text is at most
(1 - similarity) of its length. How places to verify are found depends on the length:

Items under `exact_below` characters are searched exactly, so that no place is missed. An
item that may hold k errors is cut into k + 1 pieces, one of which must occur verbatim;
the parts around that piece are tried with their share of the errors, from small to large.
This holds for the shortest too: items under 1 / (1 - similarity) characters may hold no
error and match wherever they occur, inside words as well.

For longer items the CGK random walk reads a window symbol by symbol; at every step a random
bit chosen by step and symbol says whether to move on, so that two windows at a small edit
distance meet again after an edit and their embeddings have a small Hamming distance. There are
`walks` embeddings of random bits of their own, and `samplings` of each: a sampling reads one of
each STRIDE steps, and the SAMPLES symbols read are the window's hash. Windows have a fixed size, not the item's: they start at each
word of documents and items, and at each character of a stretch of more than STRETCH bytes
without a space, so undisturbed stretches anywhere in a leaked item are enough. Hits whose
embeddings agree in less than `agree` of EMBED steps are dropped, as are, for items of at least
TWO_HITS characters, those without a second hit of the item at nearly the same alignment.
The rest is verified. The target is a recall of 0.97 for random edits at the full distance;
the README states what was measured, by length. A larger `exact_below` searches more items exactly.

Items are broadcast in groups of at most `group_bytes`; further groups take further passes,
so any number of items is covered.

Edge cases: null and empty texts and items match nothing; equal items each match;
repeated doc_ids give a row for each of their texts that matches; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, U64, Block, blocks, bounded_batches, lean, mix, stash

SAMPLES, STRIDE, EMBED, STRETCH, TWO_HITS = 8, 5, 96, 24, 190
#: Items of fewer characters would be sought verbatim only: none are.
SHORT = 0
SPAN = SAMPLES * STRIDE
_FIRST, _NEAR = 5, 32
_PIECE, _SIDE, _GAP, _CHUNK = 5, 9, 256, 1 << 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACE] = 32


def normal(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a block's normalised texts, a space before and EMBED zeros after each, and each text's bounds."""
    b = _LOWER[block.bytes]
    blank = b == 32
    first = np.zeros(len(b), bool)
    first[block.offsets[:-1][block.offsets[:-1] < len(b)]] = True
    drop = blank.copy()
    drop[1:] &= blank[:-1] | first[1:]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    size = kept[block.offsets[1:]] - kept[block.offsets[:-1]]
    end = np.cumsum(size + EMBED + 1) - EMBED
    start = end - size
    out = np.zeros((end[-1] if len(end) else 0) + EMBED, np.uint8)
    out[start - 1] = 32
    shift = start - kept[block.offsets[:-1]]
    row = np.repeat(np.arange(block.n), np.diff(block.offsets))
    use = ~drop
    out[kept[:-1][use] + shift[row[use]]] = b[use]
    return out, np.stack([start, end], 1)


def window_places(text: np.ndarray) -> np.ndarray:
    """Where windows start: at each word, and at each character of a stretch of more than STRETCH bytes without a space."""
    blank = (text == 32) | (text == 0)
    word = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    size = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - word
    more = np.flatnonzero(size > STRETCH)
    if not len(more):
        return word
    n = size[more]
    inner = np.repeat(word[more] - np.cumsum(n) + n, n) + np.arange(n.sum())
    place = np.zeros(len(text), bool)
    place[word] = place[inner[text[inner] & 0xC0 != 0x80]] = True
    return np.flatnonzero(place)


class Walk:
    """Random bits of one embedding, and the steps that each of its samplings reads."""

    def __init__(self, seed: int, samplings: int):
        rng = np.random.default_rng(seed)
        self.move = rng.integers(0, 2, (EMBED, 256)).astype(np.uint8)
        # One of each STRIDE steps, another for each sampling.
        order = np.stack([rng.permutation(STRIDE) for _ in range(SAMPLES)])
        self.steps = [np.arange(SAMPLES) * STRIDE + order[:, s % STRIDE] for s in range(samplings)]

    def first(self, text: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes of the first samples of each sampling, and where the walk stands after them."""
        at = at.astype(np.intp)
        codes = [np.zeros(len(at), U64) for _ in self.steps]
        x, step = np.empty(len(at), np.uint8), np.empty(len(at), np.uint8)
        for j in range(_FIRST * STRIDE):
            np.take(text, at, out=x, mode="clip")
            for code, steps in zip(codes, self.steps):
                if j in steps[:_FIRST]:
                    code <<= U64(8)
                    code |= x
            np.take(self.move[j], x, out=step, mode="clip")
            at += step
        return codes, at

    def rest(self, sampling: int, text: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = code
        for j in range(_FIRST * STRIDE, SPAN):
            x = text.take(at, mode="clip")
            if j in self.steps[sampling]:
                key = (key << U64(8)) | x
            at = at + self.move[j].take(x, mode="clip")
        return key

    def embed(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[step, window] symbols."""
        out = np.zeros((EMBED, len(at)), np.uint8)
        for j in range(EMBED):
            x = text[np.minimum(at, len(text) - 1)]
            out[j] = x
            at = at + self.move[j][x]
        return out

    def agreeing(self, text: np.ndarray, at: np.ndarray, embedded: np.ndarray, entry: np.ndarray, least: float) -> np.ndarray:
        """Windows whose embedding agrees with that of their entry in enough steps."""
        live, same = np.arange(len(at)), np.zeros(len(at), np.int32)
        for j in range(EMBED):
            if j in (EMBED // 4, EMBED // 2):  # half-way, somewhat less is enough
                ok = same >= (least - (0.15 if j < EMBED // 2 else 0.07)) * j
                live, same, at, entry = live[ok], same[ok], at[ok], entry[ok]
            x = text[np.minimum(at, len(text) - 1)]
            same += x == embedded[j][entry]
            at = at + self.move[j][x]
        return live[same >= least * EMBED]


def _bits(n: int) -> int:
    """Bits of a table of n entries that few others meet, as small as a core's cache if n allows."""
    return min(22, max(14, int(128 * n).bit_length()))


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return (mix(code.astype(U64)) >> U64(64 - bits)).astype(np.int64)


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def fit_distance(peq: dict[str, int], m: int, text: str) -> int:
    """Smallest edit distance of a pattern of m characters to any part of text (bit-parallel)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return best


def tree(lo: int, hi: int, n: int, above: tuple = ()) -> list[tuple]:
    """Leaves of a part of an item cut into n pieces: (start, end, errors) of the piece and of all parts around it.

    A part of n pieces may hold n - 1 errors. If both halves held more than theirs, so would the
    part; so one leaf occurs exactly, with every part around it within its errors.
    """
    path = ((lo, hi, n - 1), *above)
    if n == 1:
        return [path]
    left = (n + 1) // 2
    cut = lo + (hi - lo) * left // n
    return tree(lo, cut, left, path) + tree(cut, hi, n - left, path)


class Pieces:
    """Exact approximate search: pieces found verbatim, the parts around them by bit-parallel edit distance.

    Characters are folded to 63 symbols (0: in no item), which can only add candidates.
    """

    def __init__(self, chars: list[str], most: list[int], use: list[int]):
        rank = Counter()
        for k in use:
            rank.update(chars[k])
        self.symbol = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(sorted(rank, key=lambda c: (-rank[c], c))):
            self.symbol[ord(c)] = i % 63 + 1
        seeds: dict[int, list[tuple]] = {}
        segments, steps, beside = [], [], []
        for k in use:
            code = self.symbol[_points(chars[k])]
            at: dict[tuple[int, int], int] = {}
            for path in tree(0, len(code), min(most[k] + 1, len(code))):
                inner = [p for p in path if p[1] - p[0] <= 64] or [(path[0][0], path[0][0] + 64, 0)]
                lo, hi, _ = inner[-1]
                if (lo, hi) not in at:
                    at[lo, hi] = len(segments)
                    segments.append(code[lo:hi])
                o, n = path[0][0], min(_PIECE, path[0][1] - path[0][0])
                key = 0
                for x in code[o : o + n].tolist():
                    key = key << 6 | x
                seeds.setdefault(n, []).append((key, k, o, at[lo, hi], len(steps)))
                # A part of two is told by its other piece alone.
                steps.append([(a - lo, b - a, e, o - a) for a, b, e in inner if b - a > n and e > 1])
                beside.append(self.neighbour(code, path))
        self.beside = np.array(beside, np.int64).reshape(-1, 7).T
        masks = np.zeros((len(segments), 64), U64)
        for i, x in enumerate(segments):
            for j, c in enumerate(x.tolist()):
                masks[i, c] |= U64(1 << j)
        self.masks = masks.ravel()
        # [level, piece]: offset in the segment, length, errors, place of the piece in the part; length 0: no such level.
        self.levels = np.zeros((max((len(x) for x in steps), default=0), len(steps), 4), np.int64)
        for i, x in enumerate(steps):
            for j, step in enumerate(x):
                self.levels[j, i] = step
        self.seeds = {}
        for n, rows in sorted(seeds.items()):
            table = np.array(sorted(rows), np.int64)
            seen = np.zeros(1 << _bits(len(table)), bool)
            seen[_fold(table[:, 0].astype(np.uint32), seen)] = True
            self.seeds[n] = (seen, table[:, 0].astype(np.uint32), table[:, 1:])

    @staticmethod
    def neighbour(code: np.ndarray, path: tuple) -> tuple[int, ...]:
        """(where it starts from the piece, direction, length, symbols packed outwards) of the next piece of the part.

        In a part of three, of which the piece is the single one, also (place, length, symbols) of the far piece.
        """
        a, b, _ = path[0]
        if len(path) < 2 or path[1][2] > 2:
            return 0, 1, 0, 0, 0, 0, 0
        lo, hi, errors = path[1]
        right = lo == a
        other = code[b:hi] if right else code[lo:a][::-1]
        near, far = other, other[:0]
        if errors == 2:  # the other side is two pieces, cut as tree() cuts them
            size = len(other) // 2 if right else len(other) - len(other) // 2
            near, far = other[:size], other[size:][: max(0, _SIDE - 1 - size)]
            if not len(far):  # no room to tell
                return 0, 1, 0, 0, 0, 0, 0
        near = near[:_SIDE]
        return (b - a, 1, len(near), _packed(near), len(near), len(far), _packed(far)) if right else (-1, -1, len(near), _packed(near), len(near), len(far), _packed(far))

    def plausible(self, symbols: np.ndarray, at: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether what stands beside a piece found at `at` can be the rest of its part.

        A part of two may hold one error: its other piece follows with a symbol more, less or
        another at the first difference. A part of three may hold two: then that is true of the
        next piece, or the far piece follows unchanged, shifted by two symbols at most.
        """
        off, way, n, want, place, size, far = self.beside[:, i]
        have, at = np.zeros(len(at), U64), at + off
        near = int(n.max(initial=0)) + 1
        for j in range(near):
            have |= symbols.take(at, mode="clip").astype(U64) << U64(6 * j)
            at += way
        want, n = want.view(U64), n.astype(U64) * U64(6)
        whole = (U64(1) << n) - U64(1)
        differ = (have ^ want) & whole
        low = (differ & (~differ + U64(1))).astype(np.float64)
        first = (np.maximum(np.frexp(low)[1] - 1, 0) // 6 * 6).astype(U64)
        other = differ >> first >> U64(6)
        less = ((have ^ want >> U64(6)) & whole >> U64(6)) >> first
        more = ((have >> U64(6) ^ want) & whole) >> first
        ok = (n == 0) | (differ == 0) | (other == 0) | (less == 0) | (more == 0)
        three = np.flatnonzero(~ok & (size > 0))
        if len(three):
            have, far, start, at, way = have[three], far[three].view(U64), place[three], at[three], way[three]
            for j in range(near, min(int((start + size[three]).max()) + 2, 10)):
                have |= symbols.take(at, mode="clip").astype(U64) << U64(6 * j)
                at += way
            mask = (U64(1) << (size[three].astype(U64) * U64(6))) - U64(1)
            for shift in (-2, -1, 0, 1, 2):
                ok[three] |= (have >> (np.maximum(start + shift, 0).astype(U64) * U64(6)) & mask) == far
        return ok

    def within(self, symbols: np.ndarray, at: np.ndarray, segment: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Where the part of each step occurs around its piece at `at` with its errors at most."""
        off, size, errors, lead = steps.T
        pos = at - lead - errors
        base, shift, top = segment * 64, off.astype(U64), (size - 1).astype(U64)
        pv, mv = np.full(len(at), ~U64(0)), np.zeros(len(at), U64)
        score = size.copy()
        best = score.copy()
        one = U64(1)
        for j in range(int((size + 2 * errors).max())):
            eq = self.masks[base + symbols[pos + j]] >> shift
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score += ((ph >> top) & one).view(np.int64) - ((mh >> top) & one).view(np.int64)
            np.minimum(best, score, out=best)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
        return best <= errors

    def hits(self, rows: list[str]) -> list[tuple[int, int, int]]:
        """(row, item, where the item would start) by row, item and start."""
        gap = "\0" * _GAP
        points = _points(gap + gap.join(rows) + gap)
        symbols = self.symbol[points]
        size = np.array([len(r) for r in rows], np.int64)
        first = np.cumsum(size + _GAP) - size
        if self.symbol[0]:
            for e in [0, *(first + size)]:
                symbols[e : e + _GAP] = 0
        places, pieces, key, have = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)], np.zeros(len(symbols), np.uint32), 0
        for n, (seen, keys, about) in self.seeds.items():
            while have < n:
                key = (key[: len(symbols) - have] << np.uint32(6)) | symbols[have:]
                have += 1
            live = np.concatenate([lo + np.flatnonzero(seen[_fold(key[lo : lo + _CHUNK], seen)]) for lo in range(0, len(key), _CHUNK)])
            for lo in range(0, len(live), 1 << 14):
                at, entry = _equal(keys, key[live[lo : lo + (1 << 14)]], live[lo : lo + (1 << 14)])
                for part in range(0, len(at), _CHUNK):
                    p, e = at[part : part + _CHUNK], entry[part : part + _CHUNK]
                    near = np.flatnonzero(self.plausible(symbols, p, about[e, 3]))
                    places.append(p[near])
                    pieces.append(about[e[near]])
        at, about = np.concatenate(places), np.concatenate(pieces)
        found = [np.zeros((0, 3), np.int64)]
        for lo in range(0, len(at), _CHUNK):
            p, (k, o, segment, i) = at[lo : lo + _CHUNK], about[lo : lo + _CHUNK].T
            for level in self.levels:
                check = np.flatnonzero(level[i, 1])
                if len(check):
                    keep = np.ones(len(p), bool)
                    keep[check] = self.within(symbols, p[check], segment[check], level[i[check]])
                    p, k, o, segment, i = (v[keep] for v in (p, k, o, segment, i))
            row = np.searchsorted(first, p, side="right") - 1
            found.append(np.stack([row, k, p - o - first[row]], 1))
        return np.unique(np.concatenate(found), axis=0).tolist()


def _equal(keys: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, entry of keys) of each pair of equal keys; keys ascend."""
    a = np.searchsorted(keys, key)
    same = np.flatnonzero(keys[np.minimum(a, len(keys) - 1)] == key)
    a, at = a[same], at[same]
    n = np.searchsorted(keys, key[same], "right") - a
    return np.repeat(at, n), np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


def _packed(code: np.ndarray) -> int:
    return sum(int(x) << 6 * j for j, x in enumerate(code.tolist()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _fold(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(33 - len(table).bit_length())


class Index:
    """Items and, for each sampling of each walk, their windows' hashes; the pieces of items under `exact_below` characters."""

    def __init__(self, items: list[tuple[int, str]], walks: int, samplings: int, similarity: float, agree: float, exact_below: int):
        self.agree = agree
        block = next(blocks(pa.array([t for _, t in items], pa.string()), 1 << 62))
        text, bounds = normal(block)
        raw = [bytes(text[a:b]).rstrip(b" ") for a, b in bounds]
        self.ids = [i for i, _ in items]
        self.chars = [r.decode("utf-8", "replace") for r in raw]
        self.most = [int((1 - similarity) * len(c) + 1e-9) for c in self.chars]
        self.bytes = np.array([len(r) for r in raw])
        sizes = np.array([len(c) for c in self.chars])
        exact = [k for k, n in enumerate(sizes) if 0 < n < exact_below]
        self.pieces = Pieces(self.chars, self.most, exact) if exact else None
        at = window_places(text)
        owner = np.searchsorted(bounds[:, 0], at, side="right") - 1
        ends = bounds[:, 0] + self.bytes
        use = (ends[owner] - at >= SPAN // 2 + 2) & (sizes[owner] >= exact_below)
        at, owner = at[use], owner[use]
        self.walks = []
        for seed in range(walks if len(at) else 0):
            walk, tables = Walk(seed, samplings), []
            codes, to = walk.first(text, at)
            for sampling, code in enumerate(codes):
                key = walk.rest(sampling, text, code, to)
                seen = np.zeros(1 << _bits(len(code)), bool)
                seen[_slot(code, len(seen).bit_length() - 1)] = True
                order = np.argsort(key, kind="stable")
                tables.append((seen, key[order], order))
            self.walks.append((walk, tables, walk.embed(text, at)))
        self.owner, self.offset = owner, at - bounds[owner, 0]
        self.need = np.where(sizes < TWO_HITS, 1, np.minimum(np.bincount(owner, minlength=len(items)), 2))
        self.peq = [masks(c) for c in self.chars]

    def hits(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (item, where the item would start) by item and start."""
        out = [np.zeros((0, 3), np.int64)]
        for walk, tables, embedded in self.walks:
            hits = []
            for lo in range(0, len(at), 4 * _CHUNK):
                codes, to = walk.first(text, at[lo : lo + 4 * _CHUNK])
                for sampling, (code, (seen, keys, order)) in enumerate(zip(codes, tables)):
                    near = np.flatnonzero(seen[_slot(code, len(seen).bit_length() - 1)])
                    near, entry = _equal(keys, walk.rest(sampling, text, code[near], to[near]), near)
                    hits.append(np.stack([near + lo, order[entry]], 1))
            pairs = np.unique(np.concatenate(hits), axis=0) if hits else np.zeros((0, 2), np.int64)
            for lo in range(0, len(pairs), 4 * _CHUNK):
                w, e = at[pairs[lo : lo + 4 * _CHUNK, 0]], pairs[lo : lo + 4 * _CHUNK, 1]
                near = walk.agreeing(text, w, embedded, e, self.agree)
                out.append(np.stack([self.owner[e[near]], w[near] - self.offset[e[near]], self.offset[e[near]]], 1))
        found = np.unique(np.concatenate(out), axis=0)
        line = (found[:, 0] << 40) + found[:, 1]
        together = np.searchsorted(line, line + _NEAR, "right") - np.searchsorted(line, line - _NEAR, "left")
        return np.unique(found[together >= self.need[found[:, 0]], :2], axis=0)

    def search(self, block: Block) -> list[tuple[int, int, int]]:
        """(row of the block, item, distance) of the items found in each text."""
        text, bounds = normal(block)
        found: dict[tuple[int, int], int] = {}
        if self.pieces:
            self.by_pieces([bytes(text[a:b]).decode("utf-8", "replace") for a, b in bounds], found)
        at = window_places(text) if self.walks else ()
        if len(at):
            self.by_walks(text, bounds, at, found)
        return [(row, k, d) for (row, k), d in found.items()]

    def distance(self, k: int, text: str) -> int:
        return 0 if self.chars[k] in text else fit_distance(self.peq[k], len(self.chars[k]), text)

    def by_pieces(self, rows: list[str], found: dict[tuple[int, int], int]) -> None:
        last: dict[tuple[int, int], int] = {}
        for row, k, p in self.pieces.hits(rows):
            if found.get((row, k)) == 0 or ((row, k) in last and p - last[row, k] < 16):
                continue
            last[row, k] = p
            slack = self.most[k] + 16
            d = self.distance(k, rows[row][max(0, p - slack) : max(0, p + len(self.chars[k]) + slack)])
            if d <= self.most[k] and d < found.get((row, k), 1 << 30):
                found[row, k] = d

    def by_walks(self, text: np.ndarray, bounds: np.ndarray, at: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        hits = self.hits(text, at)
        # A hit's start may lie before its text, so its row is that of any place within the item.
        last: dict[tuple[int, int], int] = {}
        for k, p in hits.tolist():
            slack = self.most[k] + 16
            middle = p + int(self.bytes[k]) // 2
            for row in {int(np.searchsorted(bounds[:, 0], x, side="right") - 1) for x in (p, middle, p + int(self.bytes[k]))}:
                if row < 0 or found.get((row, k)) == 0:
                    continue
                if (row, k) in last and p - last[row, k] < slack // 2:
                    continue
                last[row, k] = p
                a, b = max(bounds[row, 0], p - slack), min(bounds[row, 1], p + int(self.bytes[k]) + self.most[k] + slack)
                if b - a < int(self.bytes[k]) - self.most[k] * 4:
                    continue
                d = self.distance(k, bytes(text[a:b]).decode("utf-8", "replace"))
                if d <= self.most[k] and d < found.get((row, k), 1 << 30):
                    found[row, k] = d


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, walks: int = 2, samplings: int = 2, agree: float = 0.45, exact_below: int = 160, group_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, item_id, distance of the items that a document holds."""
    bounded_batches(docs.sparkSession)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        shared = docs.sparkSession.sparkContext.broadcast((sorted((r.item_id, r.text) for r in rows), walks, samplings, similarity, agree, exact_below))
        found = texts.mapInArrow(lean(_searcher(shared)), "doc_id long, item_id long, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared):
    def run(batches):
        items = shared.value
        index = Index(*items) if items[0] else None
        for batch in batches:
            rows = []
            for block in blocks(batch.column("text")) if index else ():
                rows += [(block.lo + r, index.ids[k], d) for r, k, d in index.search(block)]
            take = pa.array([r for r, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array([k for _, k, _ in rows], pa.int64()), pa.array([d for _, _, d in rows], pa.int32())],
                ["doc_id", "item_id", "distance"],
            )

    return run


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item; documents without a doc_id stay."""
    # Written first: if they are few, Spark sees it and broadcasts them rather than shuffle the texts.
    bad = stash(leaks(docs, items, **options).select(F.col("doc_id").alias("_leaked")).where("_leaked is not null").distinct())
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_leaked"], "left_anti")
