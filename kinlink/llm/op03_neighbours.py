"""Approximate nearest neighbours by a permutation index.

Some vectors serve as pivots. A vector is represented by its PREFIX nearest pivots in order; a pivot's inverted file
holds the vectors that name it, with the weight PREFIX minus position. The files of a block of vectors are written
once, with the block. The footrule distance of two representations, with absent pivots at position PREFIX, is a
constant minus twice the sum of the smaller weights over shared pivots, so one pass over the files of a query's own
pivots ranks the vectors posted there; the other files are not read. The best SHARE of a block, ties included, is
reranked by the cosine of the original vectors in double precision.

Pivots are the first PIVOTS distinct vectors among SAMPLE rows whose hashed ids come first, a bounded sample; every row
is indexed. Null vectors, empty ones, zero vectors, and such with null or non-finite components take no part, nor do
rows with a null vec_id. Vectors meet those of their own length, and each length has its own pivots. Rows that repeat
a vec_id are candidates of their own; a query is asked once, with the least of its vectors. Ties go to the smaller
vec_id. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.blocks import Found, first, search, usable
from kinlink.llm.common import table, written

PIVOTS, PREFIX, SAMPLE = 512, 64, 2048
#: Share of a block that is reranked, and the least number.
SHARE, LEAST = 0.05, 200
#: The most frequent lengths get pivots from the sample; a rarer one has one pivot a block, so that all its rows are reranked.
LENGTHS = 16
K, EVERY = 5, 50


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length: at most PIVOTS distinct unit vectors, for at most LENGTHS lengths."""
    sized = rows.select("vec_id", F.size("v").alias("d"))
    common = [r["d"] for r in sized.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()]
    out = {}
    for d in common:
        place = (F.xxhash64("vec_id"), F.col("vec_id"), F.col("v"))
        picked = written(rows.filter(F.size("v") == d).orderBy(*place).limit(SAMPLE), "sample").orderBy(*place).collect()  # collected at once, each partition would send so many
        seen = list(dict.fromkeys(tuple(r["v"]) for r in picked))[:PIVOTS]
        out[d] = unit(np.array(seen, dtype=np.float64))
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge components neither vanish nor overflow."""
    if not m.size:
        return m
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def order(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each row, nearest first, ties to the earlier pivot."""
    many = min(PREFIX, len(centres))
    out = np.empty((len(m), many), np.int32)
    for a in range(0, len(m), 1024):
        far = -(m[a : a + 1024] @ centres.T)
        if many < len(centres):
            near = np.sort(np.argpartition(far, many - 1, axis=1)[:, :many], axis=1)
            turn = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
            out[a : a + 1024] = np.take_along_axis(near, turn, axis=1)
        else:
            out[a : a + 1024] = np.argsort(far, axis=1, kind="stable")
    return out


def files(matrix: np.ndarray, centres: np.ndarray) -> list[np.ndarray]:
    """The inverted files of a block: where each pivot's starts, the rows posted, their weights, in order of pivot and row."""
    named = order(unit(matrix), centres)
    n, many = named.shape
    weights = np.broadcast_to((many - np.arange(many)).astype(np.uint8), named.shape).ravel()
    turn = np.argsort(named.ravel(), kind="stable")
    starts = np.searchsorted(named.ravel()[turn], np.arange(len(centres) + 1))
    return [starts, (turn // many).astype(np.uint16 if n <= 1 << 16 else np.int32), weights[turn]]


class PermutationIndex:
    """A block opened for queries."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, posted: list[np.ndarray], centres: np.ndarray, k: int):
        self.ids, self.unit, self.centres, self.k = ids, unit(matrix), centres, k
        self.starts, self.rows, self.weights = posted

    def find(self, query_ids: np.ndarray, vectors: np.ndarray, least: np.ndarray) -> Found:
        q, out = unit(vectors), []
        many = max(LEAST, int(SHARE * len(self.ids)))
        for at, named in enumerate(order(q, self.centres)):
            shared = np.zeros(len(self.ids), np.int32)
            for place, p in enumerate(named):
                a, b = self.starts[p], self.starts[p + 1]
                shared[self.rows[a:b]] += np.minimum(self.weights[a:b], len(named) - place)
            shared[self.ids == query_ids[at]] = -1
            cut = np.partition(shared, -many)[-many] if many < len(shared) else 0
            rows = np.flatnonzero(shared >= max(cut, 0))
            near = self.unit[rows] @ q[at]
            bar = least[at]
            if len(near) > self.k:
                bar = max(bar, np.partition(near, -self.k)[-self.k])
            rows = rows[near >= bar - 1e-9]  # the product's rounding depends on a row's place, so the best are measured again one by one
            out.append(first(np.full(len(rows), at), self.ids[rows], (self.unit[rows] * q[at]).sum(axis=1), self.k))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def neighbours(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    rows = usable(embeddings, nonzero=True)
    centres = pivots(rows)
    own = lambda m: centres[m.shape[1]] if m.shape[1] in centres else unit(m[:1])
    return search(rows, every, k, "double", lambda m: files(m, own(m)), lambda ids, m, posted: PermutationIndex(ids, m, posted, own(m), k).find)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
