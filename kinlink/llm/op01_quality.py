"""Quality of texts by a regularised quadratic discriminant.

Each text gives a short vector of transformed statistics (logarithms of counts, square roots of shares). For each
class the mean and covariance come from labelled rows; a covariance is shrunk towards the pooled one and then
towards a multiple of the identity, so that it can always be factored. A score is the difference of the two
Mahalanobis log densities, by Cholesky factors computed once, plus the difference of log priors, passed through a
compressed logistic function. Only sums leave the executors: the model is a few vectors and triangles.

Null and empty texts: the statistics of an empty text, scored as any other. Null doc_id: hashed as the empty text.
Rows of labels whose quality is not 0 or 1 are not learned from; several label rows of a document all count. With
no labelled row of a class every score is 0.5 plus nothing, and predicted is 1 (nothing is rejected unlearned).
Very long texts are measured whole. Repeated rows: one result each. Empty tables: empty results. Extra columns are
ignored; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import bound_batches, remainder, spread, table, written

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
STOPS = b".,;:?'\"()-"
BLANK = b" \t\n\r\x0b\x0c"
OTHER = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in STOPS)
WIDE = bytes(range(128, 256))
NAMES = ("chars", "words", "lines", "word_length", "line_words", "distinct", "distinct_lines", "upper", "digit", "stop", "other", "blank", "wide", "short", "long_share", "most_other")
#: Shrinkage towards the pooled covariance, then towards the identity.
POOL, ROUND = 0.3, 0.05
#: Words' worth of even evidence added to shares, so that very short texts are not extreme.
EASE = 8


def statistics(text: str) -> list[float]:
    """The vector of NAMES for one text."""
    data = text.encode()
    n = len(data)
    total = n + EASE * 10

    def share(kind: bytes) -> float:
        return (n - len(data.translate(None, kind))) / total

    words = data.split()
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x]
    nw, nl, nd = max(len(words), 1), max(len(lines), 1), max(len(distinct), 1)
    blank, upper = share(BLANK), share(UPPER)
    signs = [data.count(c) for c in b"#$%&*|!<>{}="]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        np.log1p((1 - blank) * n / nw), np.log1p(nw / nl),
        np.sqrt((len(distinct) + EASE) / (nw + EASE)), np.sqrt((len(set(lines)) + EASE) / (nl + EASE)),
        np.sqrt(upper), np.sqrt(share(DIGIT)), np.sqrt(share(STOPS)), np.sqrt(share(OTHER)), np.sqrt(blank), np.sqrt(share(WIDE)),
        np.log1p(sum(map(len, distinct)) / nd), np.log1p(n / nl), np.sqrt(max(signs) / (nw + EASE)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[float(v) for v in statistics(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    bound_batches(docs.sparkSession)
    return spread(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        d = sums.shape[1]
        self.ready = bool((counts > 0).all())
        if not self.ready:
            return
        means = sums / counts[:, None]
        within = [squares[c] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = (within[0] + within[1]) / counts.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        self.means = means / self.scale
        pooled = pooled / np.outer(self.scale, self.scale)
        self.inverse, self.constant = [], []
        for c in (0, 1):
            own = within[c] / counts[c] / np.outer(self.scale, self.scale)
            cov = (1 - POOL) * own + POOL * pooled
            cov = (1 - ROUND) * cov + ROUND * np.eye(d) * max(np.trace(cov) / d, 1e-9)
            factor = np.linalg.cholesky(cov)
            self.inverse.append(np.linalg.inv(factor))
            self.constant.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, at least 0.5 where class 1 is likelier. The logarithm keeps far rows apart."""
        if not self.ready:
            return np.full(len(x), 0.5)
        logs = []
        for c in (0, 1):
            z = (x / self.scale - self.means[c]) @ self.inverse[c].T
            logs.append(self.constant[c] - 0.5 * (z * z).sum(1))
        gap = logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.sign(gap) * np.log1p(np.abs(gap))))


def fitted(rows: DataFrame) -> Discriminant:
    """rows: y (0 or 1) and x. Each batch gives one row of sums for each class; these are summed by Spark."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(0)
                q[c] += own.T @ own
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    parts = rows.select(F.col("y").cast("int").alias("y"), "x").mapInArrow(run, "k long, v double")
    width = 2 + 2 * d + 2 * d * d
    flat = np.zeros(width)
    for k, v in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():  # width numbers, whatever the input
        flat[k] = v
    return Discriminant(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score, predicted for each row of statistics."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def learned(stats: DataFrame, labels: DataFrame, held_out: int | None = 1, folds: int = 3) -> Discriminant:
    """The model from labelled rows, without those of the held-out fold."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).filter("y in (0, 1)")
    if held_out is not None:
        y = y.filter(remainder("doc_id", folds) != held_out)
    return fitted(stats.join(y, "doc_id").select("y", "x"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = written(features(docs), "statistics")
    out = scored(stats, learned(stats, labels))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject. Texts are measured once to learn, in narrow rows, and again in place, so that no text is shuffled."""
    model = learned(written(features(docs), "statistics"), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t or "") for t in b.column(at).to_pylist()], dtype=float)
                yield b.filter(pa.array(model.score(x) >= 0.5))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
