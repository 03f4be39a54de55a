import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import decontaminate


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join((text or "").replace("\x0b", " ").replace("\x0c", " ").split())) if text else ""


def fit(pattern, text):
    """Smallest edit distance to any part of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def brute(docs, items, similarity=0.8):
    out = set()
    for d, t in docs:
        t = normal(t)
        for i, p in items:
            p = normal(p)
            if not p or not t:
                continue
            if len(p) < decontaminate.SHORT:
                if f" {p} " in f" {t} ":
                    out.add((d, i, 0))
            elif (x := fit(p, t)) <= int((1 - similarity) * len(p) + 1e-9):
                out.add((d, i, x))
    return out


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(n))


def edited(rng, text, rate):
    out = []
    for c in text:
        if rng.random() < rate:
            kind = rng.integers(3)
            out += [[], ["z"], [c, "y"]][kind]
        else:
            out.append(c)
    return "".join(out)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, item_id int, distance string").repartition(2),
        spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int"),
    )


def test_distance_of_parts():
    rng = np.random.default_rng(0)
    for _ in range(60):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (int(rng.integers(1, 30)), int(rng.integers(0, 60))))
        assert decontaminate.fit_distance(decontaminate.masks(p), len(p), t) == fit(p, t)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    items = [(i, sentence(rng, int(rng.integers(12, 40))).capitalize()) for i in range(20)] + [(100, "Short item."), (101, "é")]
    docs = []
    for d in range(120):
        text = sentence(rng, 60)
        if d % 2:
            item = items[int(rng.integers(20))][1]
            text += " " + edited(rng, item, (0, 0.02, 0.05, 0.1)[d // 2 % 4]).replace(" ", "  \n" if d % 3 else " ") + " " + sentence(rng, 40)
        docs.append((d, text))
    docs += [(200, "a short ITEM. here é"), (201, "short items. é."), (202, items[3][1]), (203, items[4][1][:30])]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(*frames(spark, docs, items)).collect()}
    want = brute(docs, items)
    assert len(want) > 50
    assert {g[:2] for g in got} <= {w[:2] for w in want}
    assert len({g[:2] for g in got}) >= 0.95 * len(want)
    assert len(got & want) >= 0.95 * len(want)


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    item = sentence(rng, 30)
    docs = [(1, None), (2, ""), (3, " "), (4, item), (4, item), (4, "other"), (None, item), (5, "word " * 50000 + item), (6, "x")]
    items = [(1, item), (2, item), (3, None), (4, ""), (None, item)]
    d, i = frames(spark, docs, items)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(d, i).collect()), key=str)
    assert got == sorted([(a, b, 0) for a in (4, 4, None, 5) for b in (1, 2)], key=str)
    assert got == sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(d, i, group_bytes=100).collect()), key=str)
    kept = decontaminate.clean(d, i)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "6", "None"]
    assert decontaminate.leaks(d.limit(0), i).count() == decontaminate.leaks(d, i.limit(0)).count() == 0


def _planted(rng, length, rate):
    """Items of a length cut from sentences, each edited and planted in a document of its own."""
    items = [(i, sentence(rng, length)[: length + i % 9].strip()) for i in range(40)]
    return items, [(i, f"{sentence(rng, 20)} {edited(rng, t, rate)} {sentence(rng, 20)}") for i, t in items]


def test_recall_by_length_at_the_full_distance(spark):
    rng = np.random.default_rng(3)
    for length in (42, 60, 82, 170):
        for rate in (0.05, 0.1, 0.15, 0.19):
            items, docs = _planted(rng, length, rate)
            want = {(i, i, x) for (i, t), (_, p) in zip(docs, items) if (x := fit(normal(p), normal(t))) <= int(0.2 * len(normal(p)) + 1e-9)}
            got = {tuple(r) for r in decontaminate.leaks(*frames(spark, docs, items)).collect()}
            assert len(want) > 10
            assert len(want & got) >= (1 if length < 160 else 0.97) * len(want), (length, rate)


def test_text_without_spaces(spark):
    rng = np.random.default_rng(4)
    han = lambda n: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 900, n))
    items = [(i, han(n)) for i, n in enumerate((12, 30, 80, 200, 240))]
    docs = [(i, han(150) + t + han(90)) for i, t in items]
    docs += [(10 + i, han(150) + t[: len(t) // 3] + "\u3042" + t[len(t) // 3 + 1 :] + han(90)) for i, t in items]
    got = {tuple(r) for r in decontaminate.leaks(*frames(spark, docs, items)).collect()}
    assert got == {(i, i, 0) for i, _ in items} | {(10 + i, i, 1) for i, _ in items}


def test_short_items_with_errors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    items = [(n, sentence(rng, 12)[:n].strip()) for n in range(3, 40)] + [(50, "What is the boiling point?"), (51, "nul\0 item here")]
    docs = [(d, sentence(rng, 12) + '"' + edited(rng, items[d % 39][1], (0, 0.05, 0.15)[d % 3]) + "), " + sentence(rng, 9)) for d in range(117)]
    docs += [(200, 'He asked: "What is the boiling point?"'), (201, "what is teh boiling point"), (202, "(nul\0 itemhere)")]
    want = {(d, i, x) for d, t in docs for i, p in items if (x := fit(normal(p), normal(t))) <= int(0.2 * len(normal(p)) + 1e-9)}
    assert {(200, 50, 0), (201, 50, 3), (202, 51, 1)} <= want
    assert {tuple(r) for r in decontaminate.leaks(*frames(spark, docs, items)).collect()} == want


def edited(rng, text, share):
    chars = list(text)
    for _ in range(int(share * len(text))):
        i = int(rng.integers(len(chars)))
        kind = int(rng.integers(3))
        if kind == 0:
            chars[i] = "abcdefgh "[int(rng.integers(9))]
        elif kind == 1:
            chars.insert(i, "abcdefgh "[int(rng.integers(9))])
        else:
            del chars[i]
    return "".join(chars)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvw"), int(rng.integers(2, 9)))) for _ in range(n))


@pytest.mark.parametrize("words", [32, 45, 70])
def test_recall_at_the_full_distance(words):
    """Items of 160 characters and more with a fifth of their characters edited at random."""
    rng = np.random.default_rng(words)
    items = [(k, prose(rng, words).strip()) for k in range(100)]
    items = [(k, t) for k, t in items if len(t) >= 160]
    rows = [prose(rng, 30) + " " + edited(rng, t, 0.2) + " " + prose(rng, 30) for _, t in items]
    index = decontaminate.Index(items, 2, 2, 0.8, 0.45, 160)
    found = {(block.lo + r, k) for block in decontaminate.blocks(pa.array(rows)) for r, k, _ in index.search(block)}
    true = [i for i, (_, t) in enumerate(items) if decontaminate.fit_distance(decontaminate.masks(t), len(t), rows[i]) <= int(0.2 * len(t) + 1e-9)]
    assert len(true) > 70 and sum((i, i) in found for i in true) >= 0.95 * len(true)


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_pieces_miss_nothing(similarity):
    """Short items of few letters among texts of the same letters: the filters drop no true place."""
    rng = np.random.default_rng(int(similarity * 10))
    text = lambda n: "".join(rng.choice(list("abcd "), n)).strip() or "a"
    items = [(k, " ".join(text(int(rng.integers(2, 90))).split())) for k in range(60)]
    items = [(k, t) for k, t in items if t]
    rows = [" ".join((text(60) + edited(rng, items[int(rng.integers(len(items)))][1], 1 - similarity) + text(60)).split()) for _ in range(60)]
    index = decontaminate.Index(items, 1, 1, similarity, 0.45, 160)
    found = {(block.lo + r, k): d for block in decontaminate.blocks(pa.array(rows)) for r, k, d in index.search(block)}
    want = {}
    for i, row in enumerate(rows):
        for k, (_, t) in enumerate(items):
            d = decontaminate.fit_distance(decontaminate.masks(t), len(t), row)
            if d <= int((1 - similarity) * len(t) + 1e-9):
                want[i, k] = d
    assert len(want) > 60 and set(found) == set(want)
