"""Pieces against the sentencepiece library."""

import hashlib
import random

import sentencepiece

from kinlink.llm import op04_pieces as m
from tests.llm.util import awkward, documents


def library():
    return sentencepiece.SentencePieceProcessor(model_file=m.default_model())


def test_odd_strings_equal_the_library():
    coder, sp, rng = m.prefix_table(m.default_model()), library(), random.Random(5)
    parts = ["▁", " ", "  ", "\n", "a", "the", "ing", "\t", "中", "é", "́", "😀", "<s>", "<0x0A>", "</s>", "0", "12", "!!", " ▁", "\x00", "€", "ß", "İ", "\r\n", "�", "ー", "   ", "tion", "<unk>", "​", "\xa0", "².", "»,"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        ids = sp.encode(s)
        assert coder.encode(s) == ids, s
        assert coder.decode(ids) == sp.decode(ids), s
        assert coder.document(s) == (len(ids), ",".join(map(str, ids)), sp.decode(ids)), s


def test_long_words_are_linear():
    coder, sp = m.prefix_table(m.default_model()), library()
    for s in ("a" * 30000, " " * 5000, "abc中" * 8000, "x" + " " * 40 + "y", "thing" * 9000):
        assert coder.encode(s) == sp.encode(s)


def test_quick_test_of_neighbours_equals_the_definition():
    coder, rng = m.prefix_table(m.default_model()), random.Random(2)
    assert coder.ordered
    some = rng.sample(sorted(p for p in coder.ids if 1 <= len(p) <= 6 and p.isascii()), 400)
    for a in some[:200]:
        for b in rng.sample(some, 20):
            assert coder.stays(a, b) == (coder.merged(a + b) == [a, b]), (a, b)


def test_caches_that_overflow(monkeypatch):
    monkeypatch.setattr(m, "KEPT", 20)
    coder, sp = m.PrefixTable(m.default_model()), library()
    for k in range(60):
        s = " ".join(f"w{k}x{j}" for j in range(7))
        assert coder.document(s)[1] == ",".join(map(str, sp.encode(s)))


def test_table_and_awkward_rows(spark, sf):
    sp = library()
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), documents(spark, awkward())):
        rows = m.encode_documents(docs, m.default_model(), with_ids=True, with_text=True).collect()
        want = sorted((str(r["doc_id"]), *facts(sp, r["text"] or "")) for r in docs.collect())
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
        assert all(len(r["ids"]) == r["n_tokens"] and sp.decode(r["ids"]) == r["decoded"] for r in rows)
    assert m.encode_documents(docs.limit(0), m.default_model()).count() == 0


def facts(sp, text):
    ids = sp.encode(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))
