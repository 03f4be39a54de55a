import numpy as np

from gridloom.llm import language


def count_phrases(text, sample):
    """Phrases of a text cut into pieces: longest matches, each with the character that ends it."""
    n = 0
    for a in range(0, len(text), language.PIECE):
        piece, i = text[a : a + language.PIECE], 0
        while i < len(piece):
            k = 1
            while i + k <= len(piece) and piece[i : i + k] in sample:
                k += 1
            i += k
            n += 1
    return n


def test_parse_equals_brute_force():
    rng = np.random.default_rng(0)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    samples = (("x", make("abcde ", 300)), ("y", make("defgh ", 200)))
    texts = [make("abcdefgh ß", n) for n in (1, 5, 255, 256, 257, 700)] + [""]
    got = language.parse_counts(texts, samples)
    assert got.tolist() == [[count_phrases(t, s) for _, s in samples] for t in texts]


def docs(spark):
    rng = np.random.default_rng(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["ción", "os", "que"]}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(int(rng.integers(3, 40)))), lang, "s"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_languages(spark):
    rows, df = docs(spark)
    got = {r.doc_id: r for r in language.identify(df).collect()}
    test = [r for r in rows if got[r[0]].held_out]
    assert len(test) > 20
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark):
    _, df = docs(spark)
    odd = spark.createDataFrame([(1000, None, "aa", ""), (1001, "", "bb", ""), (1002, "123 !! _", "cc", ""), (1003, "kalo " * 30000, None, ""), (None, "kalomi", "aa", ""), (7, "x", "aa", ""), (1004, "日本", None, "")], df.schema)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df.unionByName(odd)).collect()]
    assert len(got) == 247
    by = {i: (p, s) for i, p, s in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[1003][0] == by[None][0] == "aa"
    assert by[1004][0] in ("aa", "bb", "cc")
    assert sum(i == 7 for i, _, _ in got) == 2
    assert {r.lang_pred for r in language.identify(odd.where("lang is null")).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_every_character_counts():
    rng = np.random.default_rng(6)
    han = [chr(0x4E00 + i) for i in range(3000)]
    samples = tuple((n, "".join(rng.choice(han[lo : lo + 1500], 4000))) for n, lo in (("aa", 0), ("bb", 700), ("cc", 1500)))
    texts = ["".join(rng.choice(han, n)) for n in (3, 10, 300)] + [t[50:60] for _, t in samples]
    got = language.parse_counts(texts, samples)
    assert got.tolist() == [[count_phrases(t, s) for _, s in samples] for t in texts]
    assert language.predict(texts[3:], samples)[0] == ["aa", "bb", "cc"]


def test_sparse_edges_equal_the_table(monkeypatch):
    rng = np.random.default_rng(7)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    samples = (("x", make("abcde ", 300)), ("y", make("defgh ", 200)))
    texts = [make("abcdefgh ß", n) for n in (1, 5, 256, 700)]
    want = [[count_phrases(t, s) for _, s in samples] for t in texts]
    for cells in (0, 3000, 5000):
        monkeypatch.setattr(language, "CELLS", cells)
        language._AUTOMATA.clear()
        assert language.parse_counts(texts, samples).tolist() == want


def test_every_language_gets_its_sample(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list("abcdefg"), 400)), "often") for i in range(400)]
    rows += [(1000 + i, "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 400)), f"rare{i % 9}") for i in range(360)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=20, sample_chars=6000)
    assert {n: len(t) for n, t in learned} == {n: 6000 for n in ["often", *(f"rare{i}" for i in range(9))]}
