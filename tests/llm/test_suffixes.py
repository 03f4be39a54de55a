import hashlib

import numpy as np
import pytest

from gridloom.llm import suffixes


def brute(rows, size):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - size + 1):
                w = b[i : i + size]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        off = np.zeros(len(b) + 2, bool)
        if d is not None:
            for i in range(len(b) - size + 1):
                if least[b[i : i + size]] < d:
                    off[1 + i : 1 + i + size] = True
        kept = bytes(x for x, o in zip(b, off[1:]) if not o)
        out.append((d, len(b), int(off.sum()), int((off[1:] & ~off[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, size, tmp_path, parts=3):
    df = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id long, text string, key int, bucket string, want int").repartition(parts)
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    got = suffixes.dedup(spark.read.parquet(path), size)
    return sorted((tuple(r)[:5] for r in got.collect()), key=str)


def corpus(seed, n=70):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("abcdé 日"), n))
    passages = [text(int(rng.integers(40, 300))) for _ in range(5)]
    rows = []
    for _ in range(n):
        t = text(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(5))]
            a = int(rng.integers(0, 60))
            t += p[a : a + int(rng.integers(30, 300))] + text(int(rng.integers(0, 50)))
        rows.append((int(rng.integers(0, 3 * n)), t))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed, tmp_path):
    rows = corpus(seed)
    want = brute(rows, 50)
    assert sum(w[2] for w in want) > 500
    assert run(spark, rows, 50, tmp_path) == want


def test_hot_anchors_split_by_window(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    rows = corpus(2, 60)
    assert run(spark, rows, 50, tmp_path) == brute(rows, 50)


def test_edge_rows(spark, tmp_path):
    copy = "The quick brown fox jumps over the lazy dog, twice over, and once more: " * 2
    rows = [(1, None), (2, ""), (3, "short"), (9, copy), (4, copy), (4, copy), (4, "x" + copy), (None, copy), (5, "ab" * 5000), (6, "ab" * 300), (7, copy[:49]), (8, copy[:50] + "é")]
    assert run(spark, rows, 50, tmp_path) == brute(rows, 50)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], 50, tmp_path, 1) == []


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    at = rng.permutation(500)
    group = np.sort(rng.integers(0, 4, 500))
    s = suffixes.Suffixes(data, 40)
    order = suffixes.merge_sort(s, at, group)
    raw = bytes(s.data)
    want = sorted(range(500), key=lambda i: (group[i], raw[at[i] : at[i] + 40], i))
    assert order.tolist() == want
    gone = suffixes.windows_to_remove(data, at, group, np.arange(500) % 7, 8)
    best = {}
    for i in range(500):
        k = (group[i], raw[at[i] : at[i] + 8])
        best[k] = min(best.get(k, 9), i % 7)
    assert gone.tolist() == [i % 7 > best[group[i], raw[at[i] : at[i] + 8]] for i in range(500)]


def test_colliding_hashes_are_verified(monkeypatch):
    """With every hash equal, byte comparison still tells windows apart."""
    data = np.frombuffer(b"abcdefgh" b"abcdefgh" b"abcdefgx", np.uint8)
    s = suffixes.Suffixes(data, 8)
    monkeypatch.setattr(s.rolling, "raw", lambda a, b: np.zeros(len(a), np.uint64))
    assert s.equal(np.array([0, 0]), np.array([8, 16])).tolist() == [True, False]


@pytest.mark.parametrize("parts", [1, 3])
def test_spans_that_meet_by_hash_are_not_removed(spark, tmp_path, monkeypatch, parts):
    """Within one block (one partition) and between blocks."""
    seeds, real = [], suffixes.Key

    def weak(seed):  # under seed 1 all bytes but `a` look alike
        seeds.append(seed)
        k = real(seed)
        if seed == 1:
            k.values = np.where(np.arange(256) == 97, k.values, k.values[0])
        return k

    monkeypatch.setattr(suffixes, "Key", weak)
    marks = np.random.default_rng(3).integers(0, 2, 400)
    rows = [(i, "".join("a" if m else x for m in marks)) for i, x in enumerate("xyz")] + corpus(4, 20)
    assert run(spark, rows, 50, tmp_path, parts) == brute(rows, 50)
    assert 2 in seeds


def test_doubling_sequences_are_told_apart(spark, tmp_path):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("bc"[b] for b in bits)), (3, "".join("cd"[b] for b in bits))]
    assert run(spark, rows, 50, tmp_path) == brute(rows, 50)


def test_spans_with_neither_side_in_common_are_not_sorted(spark):
    """Documents that share an anchor, but no 35 bytes with it, send nothing to the suffix sort."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    common = text(24)
    rows = [(i, text(100) + common + text(100)) for i in range(40)]
    near = text(60)
    near = [(50, text(80) + near + text(80)), (51, text(80) + near[:55] + text(80))]

    def wants(rows):
        docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, key long")
        return {r.want for r in suffixes._judged(suffixes._anchored(docs, 50, 2, suffixes.Key(1))).collect()}

    assert wants(rows) == set()
    assert suffixes.OPEN in wants(rows + near)


def test_parts_and_rounds_do_the_whole_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 1)
    monkeypatch.setattr(suffixes, "HOT", 3)
    made, real = [], suffixes.stash

    def counted(df):
        out = real(df)
        made.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(suffixes, "stash", counted)
    rows = corpus(6, 60)
    assert run(spark, rows, 50, tmp_path) == brute(rows, 50)
    texts = [n for columns, n in made if "text" in columns]
    assert len(texts) == suffixes.PARTS and max(texts) < sum(texts) / 2
    assert len([n for columns, n in made if columns == ["_id", "_key", "starts", "counts"]]) > 1


@pytest.mark.parametrize("seed", range(3))
def test_sides_lose_no_window(seed):
    """Spans with an equal window have an equal side."""
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2400] = data[:400]
    key, _, _, start, count, anchor, sides = suffixes.spans(data, np.array([0, 1500, 4000]), 50, suffixes.Key(seed))
    at = {}
    for i in range(len(start)):
        for p in range(start[i], start[i] + count[i]):
            at.setdefault(data[p : p + 50].tobytes(), []).append(i)
    pairs = {(a, b) for v in at.values() for a in v for b in v if a != b}
    assert pairs
    assert all(key[a] == key[b] and any(s[a] and s[a] == s[b] for s in sides) for a, b in pairs)


def test_only_suffixes_alike_in_their_first_bytes_are_merged(monkeypatch):
    """Comparisons by hash are what the sort costs: none where eight bytes tell, none between groups."""
    pairs, real = [], suffixes.Suffixes.less
    monkeypatch.setattr(suffixes.Suffixes, "less", lambda self, a, *rest: pairs.append(len(a)) or real(self, a, *rest))
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    at = rng.permutation(2900)
    s = suffixes.Suffixes(data, 50)
    order = suffixes.merge_sort(s, at, np.zeros(2900, np.int64))
    assert order.tolist() == sorted(range(2900), key=lambda i: data[at[i] : at[i] + 50].tobytes())
    assert sum(pairs) == 0
    # Beginnings in common: groups of 1 to 40, and what is merged is still told apart by hash.
    size = np.arange(1, 41)
    group, start = np.repeat(np.arange(40), size), np.arange(820) * 60
    data = rng.integers(97, 99, 820 * 60 + 60).astype(np.uint8)
    data[start[:, None] + np.arange(40)] = 120
    order = suffixes.merge_sort(suffixes.Suffixes(data, 50), start, group)
    assert order.tolist() == sorted(range(820), key=lambda i: (group[i], data[start[i] : start[i] + 50].tobytes(), i))
    assert 0 < sum(pairs) < 820 * 21


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_spans_do_not_depend_on_chunks(monkeypatch, chunk):
    rng = np.random.default_rng(chunk)
    data = rng.integers(97, 100, 1500).astype(np.uint8)
    data[300:500] = 97  # equal hashes: the first counts
    offsets = np.array([0, 0, 49, 49, 99, 400, 400, 1100, 1150, 1199, 1500, 1500])
    want = suffixes.spans(data, offsets, 50, suffixes.Key(1))
    text, start, count, anchor = want[2:6]
    windows = np.concatenate([np.arange(s, s + n) for s, n in zip(start, count)])
    assert windows.tolist() == [p for a, z in zip(offsets, offsets[1:]) for p in range(a, z - 49)]
    assert (offsets[text] <= start).all() and (start + count + 49 <= offsets[text + 1]).all()
    assert (start + count - 1 <= anchor).all() and (anchor + suffixes.KEY <= start + 50).all()
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    got = suffixes.spans(data, offsets, 50, suffixes.Key(1))
    assert all((x == y).all() for x, y in zip((*want[:6], *want[6]), (*got[:6], *got[6])))
