"""Near copies against all pairs by brute force, with hot groups and awkward rows."""

import random
import re

import numpy as np
import pytest

from kinlink.llm import op08_copies as m
from kinlink.llm.graph import components
from tests.llm.util import WORDS, awkward, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """component of every id by all pairs."""
    sets, parent = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_copies(n, seed, edits):
    """n edited copies of one text, and copies of copies, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(120)]
    out = [base]
    for _ in range(n - 1):
        t = list(rng.choice(out))
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


def check(spark, rows):
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = m.cluster(docs).collect()
    want = brute([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])


@pytest.mark.parametrize("stars", [0, 1, 3])
def test_groups_equal_brute_force(spark, monkeypatch, stars):
    """With few rounds the blocks do the work, with small blocks in many pairs of blocks."""
    monkeypatch.setattr(m, "STARS", stars)
    monkeypatch.setattr(m, "BLOCK", 16)
    texts = near_copies(90, 1, 7) + near_copies(40, 2, 12) + ["same words in this row"] * 30
    rng = random.Random(0)
    ids = rng.sample(range(1000), len(texts))
    check(spark, list(zip(ids, texts, strict=True)))


def test_table(spark, sf):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = {r["doc_id"]: r for r in m.cluster(docs).collect() if r["doc_id"] is not None}
    assert got[100]["n_shingles"] == got[101]["n_shingles"] == got[102]["n_shingles"] == 0 and got[101]["kept"]
    assert got[103]["n_shingles"] == 1 and got[105]["n_shingles"] == 1
    assert got[107]["component_id"] == got[108]["component_id"] == 5
    kept = m.one_of_each(docs)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2
    assert 3 in ids and 107 not in ids and 100 in ids and 101 in ids


def test_empty_table(spark):
    assert m.cluster(documents(spark, awkward()).limit(0)).count() == 0


def test_shingles_equal_the_definition():
    for t in ["", " \t", "a", "A b\x0bc", "a b c d e", "a b c d e a b c d e f", "é É ß " * 30, "x" * 999, "a b c d e f g"]:
        assert len(m.shingles(t)) == len(shingles(t)), t
    assert (m.shingles("A B c d e f") == m.shingles("a b\tc\nd e  f")).all()
    assert len(np.intersect1d(m.shingles("a b c d e f"), m.shingles("b c d e f g"))) == 1


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for j in (0.75, 0.9):
        n = 4000
        shared = int(2 * n * j / (1 + j))
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - shared :])
            with np.errstate(over="ignore"):
                (_, oa, wa), (_, ob, wb) = m.signature(a), m.signature(b)
            diff = [np.bitwise_count(m.bits([x]) ^ m.bits([y])).sum(axis=1, dtype=np.int64) for x, y in ((oa, ob), (wa, wb))]
            assert m.possible(np.array([len(a)]), np.array([len(b)]), *diff)[0]
            assert diff[1][0] <= len(np.setxor1d(a, b))  # never more bits than differences


def test_components(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_texts_of_one_id_are_all_searched_and_tied(spark):
    a, b, c, d = (" ".join(f"{k}{w}" for w in range(100)) for k in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, b + " end")]  # classes tied through a doc_id that is not their smallest
    rows += [(20, c), (20, d), (21, c + " end"), (22, d + " end")]  # and through one that is
    got = {r["doc_id"]: r["component_id"] for r in m.cluster(documents(spark, [(k, t, "en", "s") for k, t in rows])).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 20: 20, 21: 20, 22: 20}
