"""Exact top-k by integer inner product with an impact-ordered index, score at a time.

Components x become floor(256 * x). In a block every dimension's postings fall in LEVELS segments by value, about as
many in each; the index keeps each posting's segment and each segment's least and largest value. For a query the
impact of a segment is the most that one of its postings adds above the least contribution of its dimension; impacts
are quantised to BANDS bands of the largest one, and bands are processed in falling order over all dimensions. So in
each dimension the segments are processed from the best end on, and a posting that is not yet processed adds at most
what the next segment may add. A row's bound is what its processed postings add and, for each dimension that has not
reached the row, the most that is left there; processing a segment lowers the bounds of the rows in it and beyond it
by exact amounts. This is done for a slice of queries at once, one product for the segments of one turn.

After the bands that hold a share SHARES of the postings, the rows whose bound reaches a query's k-th best score known
so far (in earlier blocks of the task, or of the k rows with the best bounds here) are the possible members. They are
scored again exactly, ties included, if they are at most SPARE of the block; else processing goes on. When every
posting is processed the bounds are the scores. Sums of integers are exact in float32 below 2**24 and in float64
below 2**53; beyond that the bounds are lifted by more than any rounding, and exact scores are of 64-bit integers.

Null vectors, empty ones and such with null or non-finite components take no part, nor do rows with a null vec_id.
Vectors meet those of their own length. Rows that repeat a vec_id are candidates of their own; a query is asked once,
with the least of its vectors. Ties go to the smaller vec_id. Empty tables give empty results. Extra columns are
ignored. Scores that could leave 64 bits raise an OverflowError.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.blocks import Found, first, search, usable
from kinlink.llm.common import table

SCALE, K, EVERY = 256, 5, 50
#: Segments of a dimension, bands of impact of a query.
LEVELS, BANDS = 8, 64
#: Shares of a block's postings after which the bounds are looked at, and the share of its rows that may be rescored.
SHARES, SPARE = (0.6, 0.8, 1.0), 0.1
#: Queries that are processed at once, and components that are gathered at once to rescore rows.
SLICE, GATHER = 256, 1 << 21


def integers(matrix: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * matrix)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise OverflowError("components leave 64 bits")
    return x.astype(np.int64)


def segments(matrix: np.ndarray) -> list[np.ndarray]:
    """Of a block: the segment of each posting, and the least and largest value and the size of each segment (empty ones: those of the next)."""
    v = integers(matrix)
    ordered = np.sort(v, axis=0)
    cuts = ordered[len(v) * np.arange(1, LEVELS) // LEVELS]
    level = np.zeros(v.shape, np.uint8)
    for c in cuts:
        level += v >= c
    least, most, sizes = np.empty((LEVELS, v.shape[1]), np.int64), np.empty((LEVELS, v.shape[1]), np.int64), np.empty((LEVELS, v.shape[1]), np.int64)
    for s in range(LEVELS):
        inside = level == s
        sizes[s] = inside.sum(axis=0)
        least[s], most[s] = np.where(inside, v, ordered[-1]).min(axis=0), np.where(inside, v, ordered[0]).max(axis=0)
    return [level, least, most, sizes]


class ImpactIndex:
    """A block opened for queries."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, index: list[np.ndarray], k: int):
        self.ids, self.k, self.values = ids, k, integers(matrix)
        _, self.least, self.most, self.sizes = index
        self.reach = np.maximum(np.abs(self.values.min(axis=0)), np.abs(self.values.max(axis=0)))
        self.cuts: dict[tuple, np.ndarray] = {}

    def lowered(self, turn: int, falling: bool, dtype: type) -> np.ndarray:
        """By how much each posting's bound falls when the segment of this turn is processed, per unit of a weight; signed like the values."""
        if (turn, falling, dtype) not in self.cuts:
            v, n = self.values, LEVELS
            if falling:  # positive weights: segments from the largest values down; a posting counts as the cut until it is processed
                cut = lambda t: np.maximum(v, self.most[: n - t].max(axis=0)) if t < n else v
            else:
                cut = lambda t: np.minimum(v, self.least[t:].min(axis=0)) if t < n else v
            self.cuts[turn, falling, dtype] = np.ascontiguousarray((cut(turn + 1) - cut(turn)).T.astype(dtype))
        return self.cuts[turn, falling, dtype]

    def find(self, query_ids: np.ndarray, vectors: np.ndarray, least: np.ndarray) -> Found:
        found = [self.slice(query_ids[a : a + SLICE], integers(vectors[a : a + SLICE]), least[a : a + SLICE]) for a in range(0, len(query_ids), SLICE)]
        return tuple(np.concatenate([f[k] + (a * SLICE if k == 0 else 0) for a, f in enumerate(found)]) for k in range(3))

    def slice(self, query_ids: np.ndarray, w: np.ndarray, least: np.ndarray) -> Found:
        n, d = self.values.shape
        largest = (np.abs(w).astype(np.float64) @ self.reach.astype(np.float64)).max(initial=0)
        if largest >= 2.0**63 * (1 - 1e-9):
            raise OverflowError("scores leave 64 bits")
        sums = 2 * largest  # what is processed and what is open never add up to more
        dtype = np.float32 if sums < 2**24 else np.float64
        slack = 0.0 if sums < 2**53 else sums * (d + 2) * LEVELS * 2.0**-50
        up = w >= 0
        # impact[q, turn, j]: the most above the dimension's least that the segment of this turn adds
        rising, fall = (self.most[::-1] - self.least.min(axis=0)).astype(np.float64), (self.most.max(axis=0) - self.least).astype(np.float64)
        impact = np.where(up[:, None], w[:, None] * rising, -w[:, None] * fall)
        impact = np.maximum.accumulate(impact[:, ::-1], axis=1)[:, ::-1]  # empty segments never come before full ones of more impact
        sizes = np.where(up[:, None], self.sizes[::-1], self.sizes)
        most = impact.max(axis=(1, 2))
        band = np.floor(impact * (BANDS / np.where(most > 0, most, 1))[:, None, None]).astype(np.int64).clip(0, BANDS - 1)
        share = np.stack([np.where(band >= b, sizes, 0).sum(axis=(1, 2)) for b in range(BANDS)], axis=1) / (n * d)
        # every posting of every dimension counts as the dimension's best until its segment is processed
        start = np.where(up, w * self.most.max(axis=0), w * self.least.min(axis=0)).astype(np.float64).sum(axis=1)
        bound = np.repeat(start.astype(dtype)[:, None], n, axis=1)
        done, left, out = np.zeros(w.shape, np.int64), np.arange(len(w)), []
        for s in SHARES:
            upto = (share[left] >= s).sum(axis=1) - 1 if s < 1 else np.zeros(len(left), np.int64)
            todo = (band[left] >= upto[:, None, None]).sum(axis=1)
            for turn in range(LEVELS):
                now = (done[left] <= turn) & (turn < todo)
                for falling in (True, False):
                    weights = np.where(now & (up[left] == falling), w[left], 0).astype(dtype)
                    if weights.any():
                        bound += weights @ self.lowered(turn, falling, dtype)
            done[left] = todo
            reach = bound + slack
            reach[query_ids[left][:, None] == self.ids] = -np.inf
            known = np.maximum(least[left], self.kth(reach, w[left]))
            may = reach >= known[:, None]
            may[reach == -np.inf] = False
            ready = (may.sum(axis=1) <= max(SPARE * n, 4 * self.k)) | (s >= 1)
            out.append(self.rescored(left[ready], w, may[ready]))
            left, bound = left[~ready], bound[~ready]
            if not len(left):
                break
        at, rows, scores = (np.concatenate([o[k] for o in out]) for k in range(3))
        return first(at, self.ids[rows], scores, self.k)

    def kth(self, reach: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each query the k-th best exact score among the k rows with the best bounds: a score that k rows reach."""
        if reach.shape[1] <= self.k:
            return np.full(len(w), np.iinfo(np.int64).min)
        best = np.argpartition(reach, -self.k, axis=1)[:, -self.k :]
        scores = np.einsum("qkj,qj->qk", self.values[best], w)
        scores[np.take_along_axis(reach, best, axis=1) == -np.inf] = np.iinfo(np.int64).min
        return scores.min(axis=1)

    def rescored(self, queries: np.ndarray, w: np.ndarray, may: np.ndarray) -> Found:
        """Exact scores of the possible rows; of each part of them the k best."""
        at, rows = np.nonzero(may)
        step, out = max(1, GATHER // max(w.shape[1], 1)), []
        for a in range(0, len(at), step):
            q, r = queries[at[a : a + step]], rows[a : a + step]
            out.append((q, r, np.einsum("ij,ij->i", self.values[r], w[q])))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))


def top(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    return search(usable(embeddings, nonzero=False), every, k, "long", segments, lambda ids, m, index: ImpactIndex(ids, m, index, k).find)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over w)::int as rank, vec_id, score from pairs
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 5
"""
