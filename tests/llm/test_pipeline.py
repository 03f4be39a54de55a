import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm.queries import QUERIES, vocabulary
from tests.llm import test_decontaminate, test_language, test_minhash, test_personal


def masked(text):
    spans = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in test_personal.brute(text)))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, -b)
    return out + text[at:]


def corpus(rng):
    syllables = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ung", "ein", "ver"]}
    items = [(i, " ".join("".join(rng.choice(syllables["aa"], 3)) for _ in range(25))) for i in range(3)]
    rows = []
    for i in range(120):
        lang = ["aa", "bb"][i % 2]
        words = ["".join(rng.choice(syllables[lang], 3)) for _ in range(int(rng.integers(30, 80)))]
        if i % 10 == 3:
            words[5:5] = items[i % 3][1].split(" ")
        if i % 10 == 4:
            words[7:7] = [f"user{i}@mail.example.org", "4041894974608795"]
        rows.append((i, " ".join(words), lang))
    rows += [(200 + i, rows[i * 7][1] + (" kalomi" if i % 2 else ""), rows[i * 7][2]) for i in range(12)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 !?", "aa")]
    return rows, items


def expected(rows, items):
    docs = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    classes = test_minhash.brute(docs)
    docs = [(i, t) for i, t in docs if classes[i] == i]
    bad = {d for d, _, _ in test_decontaminate.brute(docs, items)}
    plain, out = Tokenizer.from_file(vocabulary()), []
    for i, t in docs:
        if i not in bad:
            ids = np.array([*plain.encode(masked(t), add_special_tokens=False).ids, 1], "<u4")
            out.append((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items = corpus(np.random.default_rng(0))
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_run_equals_brute_force(spark, tables):
    at, rows, items = tables
    got = corpus_pipeline.run(spark, at).collect()
    want = expected(rows, items)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 60 < len(want) < 120


def test_stages_return_the_columns_of_documents(spark, tables):
    at, rows, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    extra = docs.withColumn("label", docs.lang).withColumn("keep", docs.n_chars)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, at)
        assert dict(out.dtypes) == dict(extra.dtypes), name
        assert stage(spark, extra.limit(0), at).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_queries_are_numbered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert test_language is not None
