"""Token counts: against the tokenizer itself, over block borders, and hand-made files."""

import uuid

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from kinlink.llm import op02_tokens as m
from tests.llm.util import awkward, documents


def test_counts_equal_the_tokenizer(spark, sf):
    encode = m.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    want = sorted(len(encode(r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = m.op2_token_counts(spark, sf).collect()
    assert sorted(r["n_tokens"] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["ordinal"], r["start"], r["n_tokens"]))
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(rows, rows[1:], strict=False))


def test_written_in_order_and_awkward(spark, tmp_path):
    rows = awkward()
    docs = documents(spark, rows).coalesce(1)
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    m.write_flat(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path)
    encode = m.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    for block in (7, 1000, 1 << 21):
        got = m.counts(spark, path, block=block).orderBy("ordinal").collect()
        assert [r["n_tokens"] for r in got] == [len(encode(r["text"] or "")) for r in docs.collect()]


def test_hand_made_files(spark, tmp_path):
    files = {"a": [m.EOD, 1, 2, m.EOD, m.EOD, 3], "b": [5] * 9, "c": [m.EOD], "d": [], "e": [0x50C4, 0xC450, 0x50C4, m.EOD]}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    for block in (1, 2, 4, 100):
        rows = m.counts(spark, f"file://{tmp_path}", block=block).select(F.substring_index("file", "/", -1).alias("f"), "ordinal", "start", "n_tokens").collect()
        got = sorted(tuple(r) for r in rows)
        assert got == sorted([("a", 0, 0, 0), ("a", 1, 1, 2), ("a", 2, 4, 0), ("a", 3, 5, 1), ("b", 0, 0, 9), ("c", 0, 0, 0), ("e", 0, 0, 1), ("e", 1, 2, 1)])
