"""op10 against a plain reading of the base patterns, and the added kinds."""

import hashlib
import re

from kinlink.llm import op10_private as m

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fine(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def base(text):
    return [(k, x.start(), x.end()) for k, p in BASE.items() for x in p.finditer(text or "") if fine(k, x.group())]


HARD = [
    "a@b.c_d@e.f x@y..z q@w.e. me.you+x@mail-1.co.uk@z.org", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 5 4111111111111111",
    "4111  1111 1111 1111 41111111111111111111111 0000000000000000", "+1 (609) 555-7932 +12345 ++4412345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é😀 ünï a@b.de 😀 +49 30 1234567 ", "", None, "@" * 50, "1" * 40000, "a" * 40000 + "@", "1.1." * 5000,
    "-4111111111111111- 4111111111111111a", "user@host.com,1.2.3.4;+15551234567\n4111111111111111", "9" * 19 + " 1", "+" * 3000, "+1" + " " * 9000, "a@b.c" * 200,
]


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, _t int")


def test_base_spans(spark):
    docs = rows_of(spark, HARD)
    got = {r["doc_id"]: r for r in m.find(docs).collect()}
    for k, t in enumerate(HARD):
        mine = [(kind, s["start"], s["end"]) for kind in m.BASE for s in got[k][kind]]
        assert mine == base(t), (t or "")[:80]


def test_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = m.op10_private(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        want = base(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in m.BASE] == [sum(x[0] == k for x in want) for k in m.BASE]
        assert r["spans"].startswith(text)


def test_added_kinds_need_checksum_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "iban DE88 3704 0044 0532 0130 00 ok", "GB82WEST12345698765432", "my ssn is 123-45-6789.", "part no 123-45-6789", "123-45-6789", "ssn 000-12-3456"]
    got = {r["doc_id"]: r for r in m.find(rows_of(spark, texts)).collect()}
    assert [(s["start"], s["end"]) for s in got[0]["iban"]] == [(5, 32)]
    assert not got[1]["iban"] and len(got[2]["iban"]) == 1
    assert [len(got[k]["ssn"]) for k in (3, 4, 5, 6)] == [1, 0, 0, 0]


def test_redact(spark):
    docs = rows_of(spark, ["mail a@b.cd now", None, "call +1 (609) 555-7932!", "x 4111111111111112 y", "", "4111111111111111 is card"])
    out = {r["doc_id"]: r for r in m.redact(docs).collect()}
    assert [out[k]["text"] for k in range(6)] == ["mail <EMAIL> now", None, "call <PHONE>!", "x 4111111111111112 y", "", "<CARD> is card"]
    assert m.redact(docs).schema == docs.schema


def test_many_spans_in_one_text(spark):
    """More than one chunk, and thousands of chunks' worth in little time."""
    import time

    texts = ["é a%d@b.cd " % k + "x" * (k % 7) for k in range(700)]
    got = m.find(rows_of(spark, ["".join(texts), "".join(texts[:256]), "".join(texts[:257])])).collect()
    for r, n in zip(sorted(got, key=lambda r: r["doc_id"]), (700, 256, 257), strict=True):
        assert [("email", s["start"], s["end"]) for s in r["email"]] == base("".join(texts[:n]))
    long = " ".join("a@b.cd" for _ in range(100_000))
    began = time.time()
    found = m.find(rows_of(spark, [long])).first()["email"]
    assert len(found) == 100_000 and found[-1]["end"] == len(long) and time.time() - began < 60


def test_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["email"])) for r in m.find(docs).collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]


def test_empty_and_native(spark):
    docs = rows_of(spark, ["a@b.cd"]).limit(0)
    assert m.find(docs).count() == 0 and m.redact(docs).count() == 0
    plan = m.find(rows_of(spark, HARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
