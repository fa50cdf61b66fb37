"""Quality: held-out accuracy, awkward rows, and that nothing but the text counts."""

import numpy as np

from kinlink.llm import op01_quality as m
from tests.llm.util import awkward, documents, fold


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in m.op1_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(got[i]["held_out"] == (fold(i, 3) == 1) for i in got)
    held = [i for i in labels if got[i]["held_out"]]
    assert len(held) > 50
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_awkward_rows(spark):
    rows = awkward()
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(100, 1), (1, None), (None, 0)], "doc_id long, quality int")
    out = m.classify(documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(r["score"] is not None for r in out)
    one = {r["score"] for r in out if r["doc_id"] in (100, 101)}
    assert len(one) == 1  # null and empty texts are alike


def test_empty_tables_and_no_labels(spark):
    docs, none = documents(spark, awkward()), spark.createDataFrame([], "doc_id long, quality int")
    assert m.classify(docs.limit(0), none).count() == 0
    assert {r["predicted"] for r in m.classify(docs, none).collect()} == {1}
    assert m.accepted(docs, none).count() == docs.count()


def test_accepted_keeps_columns_and_agrees(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = m.accepted(docs, labels)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in m.classify(docs, labels).filter("predicted = 1").collect()}


def density(x, rows, pooled, prior):
    """Log density of a shrunk Gaussian and its prior, by inverse and determinant, without factors or scaling tricks."""
    d = x.shape[1]
    own = np.cov(rows.T, bias=True).reshape(d, d)
    cov = (1 - m.POOL) * own + m.POOL * pooled
    cov = (1 - m.ROUND) * cov + m.ROUND * np.eye(d) * np.trace(cov) / d
    z = x - rows.mean(0)
    return np.log(prior) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z)


def test_scores_equal_direct_densities(spark):
    """Whole path against Gaussian densities over the same statistics, in units of the pooled deviation."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    text = lambda y: " ".join(("#" * rng.integers(1, 4) if not y and rng.random() < 0.3 else word(rng.integers(1, 9 - 3 * y)).capitalize()) + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.integers(5, 80)))
    rows = [(k, text(k % 2), "en", "s") for k in range(150)] + [(500 + k, text(k % 2), "en", "s") for k in range(30)]
    labels = [(k, k % 2) for k in range(150)]
    got = {r["doc_id"]: r["score"] for r in m.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([m.statistics(t) for _, t, _, _ in rows])
    learn = np.array([i for i, (k, _) in enumerate(labels) if fold(k, 3) != 1])
    y = np.array([labels[i][1] for i in learn])
    centred = np.concatenate([x[learn][y == c] - x[learn][y == c].mean(0) for c in (0, 1)])
    scale = np.sqrt(np.maximum(centred.var(0), 1e-12))  # a statistic that never varies has no scale
    z, pooled = x / scale, np.cov((centred / scale).T, bias=True)
    one, zero = (density(z, z[learn][y == c], pooled, (y == c).mean()) for c in (1, 0))
    gap = one - zero
    want = 1 / (1 + np.exp(-np.sign(gap) * np.log1p(np.abs(gap))))
    assert np.allclose([got[r[0]] for r in rows], want, atol=1e-6)


def test_one_labelled_row_of_a_class_is_learnt_from(spark):
    docs = documents(spark, [(k, "word " * (k + 1) + "#" * (k % 3), "en", "s") for k in range(12)])
    ids = [k for k in range(12) if fold(k, 3) != 1]
    labels = spark.createDataFrame([(k, int(k == ids[-1])) for k in ids], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in m.classify(docs, labels).collect()}
    assert len(set(got.values())) > 1 and got[ids[-1]] > got[ids[0]]
