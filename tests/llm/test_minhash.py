import gc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import minhash
from gridloom.llm.common import U64, blocks, lean
from gridloom.llm.graph import components


def bag(text):
    w = (text or "").replace("\n", " ").lower().split()
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def brute(rows, threshold=0.8):
    ids = sorted({i for i, t in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, bag(t)) for i, t in rows if i is not None and bag(t)]
    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if jaccard(a, b) >= threshold:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = []
    for i in range(n):
        if i % 3 and rows:
            words = rows[int(rng.integers(len(rows)))][1].split(" ")
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = word()
        else:
            words = [word() for _ in range(int(rng.integers(30, 120)))]
        rows.append((i, " ".join(words)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n int, sig string").repartition(3)


def test_classes_equal_brute_force(spark):
    rows = corpus(0)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.keep} == set(want.values())
    assert 1 < len({*want.values()}) < len(want)


def test_repeated_shingles_count(spark):
    rows = [(0, "a b c d e " * 40), (1, "a b c d e " * 38), (2, "a b c d e " * 20), (3, "one two three"), (4, "One TWO three"), (5, "one two")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}


def test_edge_rows(spark):
    long = "the same long text " * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (5, long), (None, long), (6, "x"), (7, "x")]
    got = sorted(((r.doc_id, r.class_id, r.keep) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (None, None, True), (6, 6, True), (7, 6, False)], key=str)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    m, n = 2000, 60
    value = rng.integers(0, 2**63, n).astype(U64)
    a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
    row = np.repeat([0, 1], n)
    weight = np.concatenate([a, b])
    use = weight > 0
    sig = minhash.bag_minhash(row[use], np.concatenate([value, value])[use], weight[use], 2, m)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 5 * (truth * (1 - truth) / m) ** 0.5


def test_stars_and_chunks_lose_no_pair(spark, monkeypatch):
    """A chain of texts in which only neighbours are near."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 150])) for i in range(30)]
    assert len(set(brute(rows).values())) == 1
    assert {r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {0}


def test_bands_of_many_chunks_lose_no_pair(spark, monkeypatch):
    """One class fills its bands but for a few texts; chunks of three texts."""
    monkeypatch.setattr(minhash, "CHUNK", 3)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = corpus(4, 40)
    for i in range(40):
        words = list(base)
        for _ in range(i % 4 if i < 25 else 3 + i % 3):
            words[int(rng.integers(120))] = f"x{int(rng.integers(1000))}"
        rows.append((100 + i, " ".join(words)))
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == brute(rows)


def test_few_tasks(spark):
    """Every shuffle costs a task for each partition, however few its rows: 920 tasks here while band keys, signatures and groups were made twice, 690 since."""
    docs, context = frame(spark, corpus(0)), spark.sparkContext
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    context.setJobGroup("few tasks", "test_few_tasks")
    try:
        minhash.near_duplicates(docs).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("few tasks") for s in status.getJobInfo(job).stageIds}
    assert 0 < sum(status.getStageInfo(s).numCompletedTasks for s in stages) < 800


def test_workers_do_not_collect_what_lasts(spark):
    """A full collection after each task went through every module's objects."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()] * len(b))], ["n"])

    assert min(r.n for r in spark.range(8).mapInArrow(lean(run), "n long").collect()) > 10_000


def test_groups_of_a_band_are_dealt_and_whole(spark, monkeypatch):
    """One band of 60 classes: its chunks are several tasks' work; batches of 7 rows cut groups."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    classed = spark.createDataFrame([(1, 0, i, min(i, 60)) for i in range(100)], "band long, nth int, doc_id long, class long")
    monkeypatch.setattr(minhash, "CHUNK", 9)
    spark.conf.set(key, 7)
    try:
        rows = minhash._chunked(classed)
        want = {tuple(r)[:-1]: r["count"] for r in rows.groupBy(*minhash._GROUP).count().collect()}

        def run(t):
            at = np.append(np.flatnonzero(minhash._starts(t)), t.num_rows)
            columns = [pa.array(t.column(c).to_numpy()[at[:-1]]) for c in minhash._GROUP]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(at))], [*minhash._GROUP, "n"])

        got = minhash._by_group(rows, run, "band long, kind int, x int, y int, n long").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, was)
    assert len(got) == len(want) > 20 and {tuple(r)[:4]: r.n for r in got} == want
    assert len({r.task for r in got}) > 1


def test_sequences_that_polynomial_hashes_confuse(spark):
    """Texts and words of the a/b doubling sequence and its complement are different texts."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join(x[i] for i in bits) for x in ("ab", "ba"))
    rows = [(1, " ".join("pq"[i] for i in bits)), (2, " ".join("qp"[i] for i in bits)), (3, f"one two {a} three"), (4, f"one two {b} three"), (5, a), (6, b)]
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == brute(rows)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 40) if i % 10] + [(int(a), int(b)) for a, b in rng.integers(100, 140, (25, 2)) if a != b]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_cut_between_texts():
    texts = pa.array(["ab", None, "", "c" * 10, "d"])
    assert [(b.lo, b.hi, bytes(b.bytes)) for b in blocks(texts, 3)] == [(0, 3, b"ab"), (3, 4, b"c" * 10), (4, 5, b"d")]
