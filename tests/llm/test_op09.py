"""The mix against a plain reading of its rules."""

import hashlib

import pytest

from kinlink.llm import op09_mixture as m
from tests.llm.util import awkward, documents

BLANKS = " \t\n\x0b\x0c\r"


def size(text):
    for c in BLANKS[1:]:
        text = (text or "").replace(c, " ")
    return len([w for w in (text or "").split(" ") if w])


def plain(rows):
    """target and number taken of each source by resharing until none is above its cap, and by sorting hashes."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return sizes, target
        full |= over


@pytest.mark.parametrize("few", [10_000, 0])
def test_targets_and_takes(spark, sf, monkeypatch, few):
    monkeypatch.setattr(m, "FEW_SOURCES", few)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    sizes, target = plain(rows)
    source, length = {i: s for i, _, s in rows}, {i: size(t) for i, t, _ in rows}
    got = m.mix(docs).collect()
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == length[r["doc_id"]] and r["source_size"] == sizes[s]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(length[i] for i in source if source[i] == s) / 2 + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, m.mix(docs).collect()))


def test_thresholds_are_nested(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    less = {r["doc_id"]: r["taken"] for r in m.mix(docs).collect()}
    monkeypatch.setattr(m, "BUDGET", 1.7)
    assert all(r["taken"] >= less[r["doc_id"]] for r in m.mix(docs).collect())


def test_hash(spark):
    got = spark.createDataFrame([(17,), (None,)], "doc_id long").select(m.hashed()).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(x).hexdigest()[:12], 16) for x in (b"17", b"")]


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    got = m.mix(docs).collect()
    sizes, target = plain([(r[0], r[1], r[3]) for r in rows])
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {round(r["target"], 4) for r in got} == {round(t, 4) for t in target.values()}
    out = m.mixed(docs)
    assert out.schema == docs.schema
    assert out.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert m.mix(docs.limit(0)).count() == 0 and m.mixed(docs.limit(0)).count() == 0
    blank = documents(spark, [(1, None, "en", "s"), (2, "", "en", None)])
    assert [(r["size"], r["target"], r["taken"]) for r in m.mix(blank).collect()] == [(0, 0.0, 0)] * 2
