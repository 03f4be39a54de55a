import numpy as np

from gridloom.llm import search


def brute(rows, k=5, every=50):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, id int")
    return sorted(tuple(r) for r in search.top_k(df, **kw).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # copies: ties
    rows += [(5000, None), (5050, [None] + [0.0] * 7), (5051, [float("nan")] * 8), (5100, [float("inf")] * 8), (5150, [1.0, 2.0]), (None, [0.0] * 8)]
    assert run(spark, rows, group_rows=64, query_rows=4) == brute(rows)
    assert run(spark, rows, bits=2) == brute(rows)


def test_few_rows_and_large_values(spark):
    rows = [(0, [1e12, -1e12]), (1, [3e12, 1.0]), (2, [0.0, 0.0])]
    got = run(spark, rows)
    want = [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in brute(rows)]
    assert got == want
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_copies_near_copies_and_crowded_groups(spark):
    rng = np.random.default_rng(2)
    near = [(int(i), [100.0 + float(x) for x in rng.integers(0, 3, 6) / 256] + [-900.0]) for i in range(300)]  # in one cell of 8 bits
    same = [(i, [0.5] * 7) for i in range(300, 420)] + [(300, [0.5] * 7)] * 9 + [(350, [0.5] * 7)] * 3
    twice = [(50, [0.25] * 7), (51, [0.25] * 7), (51, [0.75] * 7)]
    rows = near + same + twice
    # A repeated query id is asked once, with its smallest vector.
    asked = {}
    for i, v in rows:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    want = []
    for q in sorted(asked):
        scores = sorted((-sum(a * b for a, b in zip(whole(asked[q]), whole(v))), i) for i, v in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert run(spark, rows, most=8) == want
    assert run(spark, rows, group_rows=32, query_rows=2, most=5) == want
    assert run(spark, rows, bits=3) == want


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    for scale in (50, 5000, 10**12):
        x, q = (np.floor(rng.normal(0, scale, (n, 9))) for n in (200, 20))
        for bits in (2, 8):
            code, low, step = search.approximate(x, bits)
            for i, mine, lower, upper in search.in_reach(q, np.arange(20), code, low, step, np.arange(200), np.zeros(200, bool), 200):
                exact = np.array([sum(int(a) * int(b) for a, b in zip(q[i], x[j])) for j in mine], float).clip(-(2.0**63), 2.0**63)  # as scores are held
                assert i not in mine and (lower <= exact + 1e-6).all() and (upper >= exact - 1e-6).all()
