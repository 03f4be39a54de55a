import hashlib
import re

import numpy as np

from gridloom.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


TEXTS = [
    None, "", "no data", "a@b.c", "a@b.c%d@e.f x@y z@.q a.b@c-d.e-f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4041894974608795",
    "4041 8949 7460 8795 and 4041-8949-7460-8796", "+1 (988) 555-2485 +1 2 +123456789012345678", "é🙂 mail bosbt.42@mail8.example.com é +49 30 1234567, 10.0.0.1!",
    "5 - 12 3", "9" * 30000, "1 " * 30000, "a" * 100000 + "@", "x@" * 2000, "a@b" + ".c" * 20000, "0.0.0.0" * 50, "+1" + "2 " * 9000, "4111111111111111 4111111111111111",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(texts)], "doc_id long, text string, key string, more int")


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    alphabet = list("a1@.+ -()0é9")
    texts = TEXTS + ["".join(rng.choice(alphabet, 60)) for _ in range(400)]
    got = {r.doc_id: r for r in personal.report(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), repr(t)[:200]
        assert [got[i][f"n_{k}"] for k in personal.KINDS] == [sum(s.startswith(k) for s in spans) for k in personal.KINDS]
        assert set(spans) <= set(got[i].spans.split(",")) | {""} or spans == []


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please write to user{i}@host{i}.org for details {i}" for i in range(12)]
    texts += ["please write to someone(at)host44771.org for details", "the year was 199044 for once", "order 12345 please"]
    got = {r.doc_id: r.spans for r in personal.report(frame(spark, texts)).collect()}
    start = texts[12].index("someone")
    assert got[12] == f"email:{start}:{texts[12].index(' for')}"
    assert got[13] == got[14] == ""
    assert got[0].count(":") == 2


def test_redaction_keeps_columns_and_rows(spark):
    df = frame(spark, ["mail a@b.c now", None, "plain", "1.2.3.4", "x"]).unionByName(frame(spark, ["second text of id 0 +1 (988) 555-2485"]))
    got = personal.redact(df)
    assert got.columns == df.columns
    assert sorted(str(r.text) for r in got.collect()) == sorted(["mail [email] now", "None", "plain", "[ip]", "x", "second text of id 0 [phone]"])


def test_plan_is_native(spark, capsys):
    personal.report(frame(spark, ["a@b.c"])).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_empty_table(spark):
    assert personal.report(frame(spark, ["a"]).limit(0)).count() == 0
