import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm.queries import vocabulary
from gridloom.llm.tokens import Tokens

TEXTS = [
    "", " ", "Plain words, don't they're I'LL 12 3.", "ÀÉ Straße ñandú µ º ª ½²", "a b\u0085c\x1cd\x0be", "日本語 text", "İstanbul ΑΣ", "é combining",
    "<|endoftext|> <|startoftext|>", "<| not special", "x" * 500, "!!! ??? --- '''s 's", "tab\tnew\nline\r\n", "\x00\x01 control", "İ", "🙂 smile 🙂",
]


def test_known_words_give_the_tokenizers_ids():
    path = vocabulary()
    plain, own = Tokenizer.from_file(path), Tokens(path, most=5)
    rng = np.random.default_rng(0)
    letters = list("abcABC éÉñ'.!, 1½\t\n st")
    texts = TEXTS + ["".join(rng.choice(letters, 60)) for _ in range(200)]
    for i in range(0, len(texts), 7):
        for text, ids in zip(texts[i : i + 7], own.ids(texts[i : i + 7])):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_each_sequence_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 50
    count = np.bincount(rng.integers(1, capacity + 1, 400), minlength=capacity + 1)
    if seed == 3:
        count[17] = 5000
    table = packing.plan(count, capacity)
    load, spans = Counter(), defaultdict(list)
    for size in np.flatnonzero(count):
        rows = table[table[:, 0] == size]
        for rank in range(count[size]):
            _, first, each, sequence, offset = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
            s, k = sequence + (rank - first) // each, (rank - first) % each
            load[s] += size
            spans[s].append((offset + k * size, size))
    for s, held in spans.items():
        at = 0
        for start, size in sorted(held):
            assert start == at
            at += size
        assert at <= capacity
    least = max(-(-int((count * np.arange(capacity + 1)).sum()) // capacity), -(-int(count[17]) // 2))  # at most two 17s fit together
    assert len(load) <= least * 1.1 + 2


def _fewest(sizes, capacity):
    """Bins of an optimal packing, by exhaustive search."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= sizes[i] and bins[b] not in bins[:b]:
                bins[b] -= sizes[i]
                go(i + 1, bins)
                bins[b] += sizes[i]
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = 20
    sizes = sorted(rng.integers(2, 16, 9).tolist(), reverse=True)
    count = np.bincount(sizes, minlength=capacity + 1)
    fixed = sum(c for c, _ in packing.reduce(count, capacity))
    rest = [int(s) for s in np.flatnonzero(count)[::-1] for _ in range(count[s])]
    assert fixed + _fewest(rest, capacity) == _fewest(sizes, capacity)


def test_dominant_pair_is_checked_against_all_sets():
    capacity = 12
    for sizes in combinations_with_replacement(range(2, 9), 5):
        count = np.bincount(sizes, minlength=capacity + 1)
        fixed = sum(c for c, _ in packing.reduce(count, capacity))
        rest = [int(s) for s in np.flatnonzero(count)[::-1] for _ in range(count[s])]
        assert fixed + _fewest(rest, capacity) == _fewest(list(sizes), capacity)


def test_round_trip(spark):
    texts = [*TEXTS, None, "word " * 9000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "same", "y"), (None, "lost", "z")], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, vocabulary()).collect()
    plain = Tokenizer.from_file(vocabulary())
    expected = Counter()
    for d, t in [*enumerate(texts), (3, "same"), (None, "lost")]:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, a in enumerate(range(0, len(ids), 4096)):
            expected[d, p, a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for start, n in sorted(held):
            assert start == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0
