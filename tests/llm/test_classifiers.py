import math
import re

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import common, quality, toxicity

NASTY = ["moron", "scumlike", "scumming"]


def corpus(seed=0, n=400):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, 40))
        bad, rough = i % 4 == 0, i % 5 == 0
        if bad:
            words[int(rng.integers(40))] = NASTY[i % 3]
        if rough:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(not rough), int(bad)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t, _, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, q, x, "no") for i, _, q, x in rows], "doc_id long, quality int, toxic int, text string")
    return docs, labels


@pytest.mark.parametrize("module,label", [(quality, 2), (toxicity, 3)])
def test_held_out_rows_are_told_apart(spark, module, label):
    rows = corpus()
    truth = {r[0]: r[label] for r in rows}
    got = module.classify(*frames(spark, rows)).collect()
    assert len(got) == len(rows)
    test = [r for r in got if r.held_out]
    assert len(test) > 40
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_rows(spark, module):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "word " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one, none.limit(0)):
        got = module.classify(docs, labels).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert module.classify(docs.limit(0), one).count() == 0


def test_pairs_of_terms_weigh_more_than_their_sum():
    """A factorisation machine learns that two terms are toxic only together."""
    rng = np.random.default_rng(2)
    y, off, flat = [], [0], []
    for i in range(1200):
        a, b = bool(rng.integers(2)), bool(rng.integers(2))
        terms = [t for t, on in ((1, a), (2, b)) if on] + [10 + int(rng.integers(5))]
        y.append(int(a and b))
        flat += sorted(terms)
        off.append(len(flat))
    m = toxicity.fit(np.array(y), np.array(off), np.array(flat, np.uint64), epochs=60)
    at = {int(t): i for i, t in enumerate(m.terms)}
    linear = lambda *t: m.intercept + sum(m.linear[at[x]] for x in t)
    both = linear(1, 2) + m.factors[at[1]] @ m.factors[at[2]]
    assert linear(1) < 0 and linear(2) < 0 < both


def agreement(seed, n, noise, words):
    """Label 1 exactly if both or neither of terms 1 and 2 occur: each alone is neutral."""
    rng = np.random.default_rng(seed)
    y, off, flat = [], [0], []
    for _ in range(n):
        a, b = bool(rng.integers(2)), bool(rng.integers(2))
        terms = sorted(set((100 + rng.integers(0, words, noise)).tolist()) | ({1} if a else set()) | ({2} if b else set()))
        y.append(int(a == b))
        flat += terms
        off.append(len(flat))
    return np.array(y), np.array(off), np.array(flat, np.uint64)


@pytest.mark.parametrize("noise,words", [(5, 20), (100, 1000)])
def test_pairs_of_terms_that_are_neutral_alone_are_learned(noise, words):
    m = toxicity.fit(*agreement(1, 4000, noise, words))
    assert {1, 2} <= set(m.terms.tolist())
    y, off, flat = agreement(2, 800, noise, words)
    at = np.minimum(np.searchsorted(m.terms, flat), len(m.terms) - 1)
    known = m.terms[at] == flat
    raw, _ = toxicity._raw((m.intercept, m.linear, m.factors), at[known], np.repeat(np.arange(800), np.diff(off))[known], 800)
    assert ((raw > 0) == y).mean() > 0.98


def test_shuffled_labels_show_no_pairs():
    y, off, flat = agreement(3, 3000, 50, 400)
    rng = np.random.default_rng(0)
    idx = np.unique(flat, return_inverse=True)[1]
    assert toxicity.pairs(rng.permutation(y) - y.mean(), idx, np.repeat(np.arange(3000), np.diff(off)), idx.max() + 1, 64) == []


# ---------------------------------------------------------------- scalar twins

M = 1 << 64


def twin_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def twin_hash(word):
    raw = sum(int(common.BYTE_VALUE[b]) * pow(common._PRIME, i, M) for i, b in enumerate(word)) + len(word) * 0xD6E8FEB86659FD93
    return twin_mix(raw % M)


TEXTS = ["", "Moron! the moronic, MORON", "a bc def ghij klmno pqrstu", "été 日本語 x1 x1", "!!! ??? !!!", "word " * 30 + "12,5%"]


def test_toxicity_equals_a_scalar_twin(spark):
    rng = np.random.default_rng(5)
    words = [re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()) for t in TEXTS]
    terms = [{twin_hash(w) for w in ws} | {twin_hash(w[:k]) for w in ws for k in (4, 5, 6) if len(w) > k} for ws in words]
    known = sorted(set().union(*terms))[::2]
    m = toxicity.Machine(np.array(known, np.uint64), -0.3, rng.normal(size=len(known)).astype(np.float32), rng.normal(0, 0.5, (len(known), 3)).astype(np.float32))
    at = {t: i for i, t in enumerate(known)}
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), m).collect()}
    for d, own in enumerate(terms):
        ids = sorted(at[t] for t in own if t in at)
        raw = m.intercept + sum(float(m.linear[i]) for i in ids)
        raw += sum(float(np.dot(m.factors[i].astype(float), m.factors[j].astype(float))) for i in ids for j in ids if i < j)
        assert math.isclose(got[d], 1 / (1 + math.exp(-raw)), rel_tol=1e-5)


def twin_slots(text, bits):
    tokens = [twin_hash(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-\x7f]+", text.encode())]
    pairs = [twin_mix(2) if a == b else twin_mix((a * 3 + b) % M) for a, b in zip(tokens, tokens[1:])]
    return [h >> (64 - bits) for h in tokens + pairs]


def twin_fit(rows, bits, epochs, alpha, beta, l1, l2):
    """FTRL-proximal, one coordinate after the other."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(zi, ni, least):
        return 0.0 if abs(zi) <= least else -(zi - math.copysign(least, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for y, slots in rows:
            x = {f: quality.SCALE * slots.count(f) / max(len(slots), 1) for f in set(slots)}
            w = {f: weight(z.get(f, 0.0), n.get(f, 0.0), l1) for f in x}
            b = -bias[0] / ((beta + math.sqrt(bias[1])) / alpha + 0)
            p = 1 / (1 + math.exp(-(b + sum(w[f] * x[f] for f in x))))
            for f in x:
                g = (p - y) * x[f]
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[f]
                n[f] = old + g * g
            g = p - y
            bias = [bias[0] + g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / alpha * b, bias[1] + g * g]
    return {f: weight(z[f], n[f], l1) for f in z}, -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)


def test_quality_equals_a_scalar_twin(spark):
    bits, rng = 12, np.random.default_rng(6)
    texts = TEXTS + [" ".join(rng.choice(["ok", "bad", "BUY", "now", "!!", "fine"], 12)) for _ in range(20)]
    rows = [(int(rng.integers(2)), twin_slots(t, bits)) for t in texts]
    m = quality.fit([(y, np.array(s, np.int64)) for y, s in rows], bits, epochs=2)
    weights, bias = twin_fit(rows, bits, 2, 0.5, 1.0, 0.3, 0.5)
    assert math.isclose(m.bias, bias, rel_tol=1e-6) and sum(w != 0 for w in weights.values()) > 5
    assert np.allclose([m.weights[f] for f in weights], list(weights.values()), rtol=1e-5, atol=1e-6)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for d, (_, slots) in enumerate(rows):
        raw = bias + sum(weights.get(f, 0.0) for f in slots) * quality.SCALE / max(len(slots), 1)
        assert math.isclose(got[d], 1 / (1 + math.exp(-raw)), rel_tol=1e-4)


def test_ids_with_remainder_zero_are_never_learned(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic")
    a = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.classify(docs, flipped).collect()}
