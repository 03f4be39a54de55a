import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import substrings


def brute(rows, size):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, size, parts=3):
    df = spark.createDataFrame([(d, t, 1, "k", [1]) for d, t in rows], "doc_id long, text string, key int, block string, spans array<int>").repartition(parts)
    path = f"/tmp/gridloom-test-{np.random.randint(1 << 30)}"
    df.write.parquet(path)
    got = substrings.dedup(spark.read.parquet(path), size)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    return sorted((tuple(r)[:4] for r in got.collect()), key=str)


def corpus(seed, n=80):
    rng = np.random.default_rng(seed)
    passage = [[f"p{k}_{i}" for i in range(int(rng.integers(20, 60)))] for k in range(6)]
    rows = []
    for d in range(n):
        words = [str(x) for x in rng.integers(0, 40, int(rng.integers(0, 120)))]
        for _ in range(int(rng.integers(0, 3))):
            at, p = int(rng.integers(0, len(words) + 1)), passage[int(rng.integers(6))]
            a = int(rng.integers(0, 15))
            words[at:at] = p[a:]
        rows.append((d, "".join(w + [" ", "\n", "\t ", "\x0b"][int(rng.integers(4))] for w in words)))
    return rows


@pytest.mark.parametrize("seed,size", [(0, 35), (1, 35), (2, 7), (3, 20), (4, 36)])
def test_equals_brute_force(spark, seed, size):
    rows = corpus(seed)
    want = brute(rows, size)
    assert sum(w[2] for w in want) > 0
    assert run(spark, rows, size) == want


def test_edge_rows(spark):
    copy = " ".join(f"w{i}" for i in range(60))
    loop = "a b c " * 4000
    rows = [(1, None), (2, ""), (3, " \n"), (4, copy), (4, copy), (4, "x " + copy), (None, copy), (5, loop), (6, "é x " * 34), (7, " ".join(f"w{i}" for i in range(34))), (8, "lone")]
    assert run(spark, rows, 35) == brute(rows, 35)
    assert run(spark, [], 35, 1) == []


def doubling(n):
    """The a/b sequence and its complement that polynomial hashes modulo 2**64 cannot tell apart from 1,024 symbols on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_that_meet_for_every_base_remove_nothing(spark):
    x, y = doubling(1024)
    tail = " ".join(f"w{i}" for i in range(40))
    words = tail.split()
    rows = [(1, " ".join([*words[:20], x, *words[20:]])), (2, " ".join([*words[:20], y, *words[20:]]))]
    assert run(spark, rows, 35) == brute(rows, 35) and all(r[2] == 0 for r in brute(rows, 35))
    # The same sequence over words.
    rows = [(i, " ".join(t)) for i, t in enumerate(doubling(4096))]
    assert run(spark, rows, 35) == brute(rows, 35)


def test_names_that_meet_start_another_key(spark, monkeypatch):
    """Under the first key all words of a length have one name; verification finds it out."""
    real, used = substrings.Key, []

    class Weak(real):
        def __init__(self, seed):
            super().__init__(seed)
            used.append(seed)
            self.weak = seed == 1

        def word_hashes(self, data, start, end):
            return (end - start).astype(np.uint64) if self.weak else super().word_hashes(data, start, end)

    Weak.__module__ = "__main__"  # sent to the workers whole
    monkeypatch.setattr(substrings, "Key", Weak)
    rows = corpus(7, 40) + [(100, " ".join("abcdefgh"[i % 8] for i in range(50))), (101, " ".join("ijklmnop"[i % 7] for i in range(50)))]
    assert run(spark, rows, 35) == brute(rows, 35)
    assert 2 in used


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 500):
        names, more = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**32, n).astype(np.uint32)
        assert all((a == b).all() for a, b in zip(substrings._unpack_names(substrings._pack_names(names, more), True), (names, more)))
        assert (substrings._unpack_names(substrings._pack_names(names, None), False)[0] == names >> np.uint64(24) << np.uint64(24)).all()
        for step in (3, 70000):
            places = np.cumsum(rng.integers(1, step, n))
            assert (substrings._unpack_places(substrings._pack_places(places)) == places).all()
    assert substrings.levels(35) == [9, 18, 35]
