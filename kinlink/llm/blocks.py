"""Vectors packed in blocks: a block is one row that holds its ids, its matrix and the index built over them.

Blocks are cut from the partitions as they are read, so an index is built without a shuffle and written once. Every
block of queries meets every block of the index, as the searches here have a stated query set against all rows; only
the best few of each meeting go on. Index blocks are dealt to at most GROUPS groups, query blocks to slices of about
SLICE_BYTES; a cell is a slice and a group, and one task. It reads the slice's queries, then the group's blocks one
after another. Blocks are copied to their cells by number, never by a join, so none is ever sent through the driver.
Vectors of different lengths have no common measure; each length is packed and searched among its own.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import arrow, written

#: Rows of an index block, of a query block; bytes of a batch from which a block is cut.
INDEX_ROWS, QUERY_ROWS, BLOCK_BYTES = 8192, 1024, 32 << 20
#: Groups of the index blocks of a length at most; bytes of query vectors that a task holds, beside one block.
GROUPS, SLICE_BYTES = 64, 32 << 20
PACKED = "part int, d int, n int, ids binary, matrix binary, built binary"

#: The k best of a block for several queries: positions of the queries, vec_ids, scores.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
Build = Callable[[np.ndarray], list[np.ndarray]]


def usable(embeddings: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part: not empty, without null or non-finite components, and not zero if so asked."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        fine = fine & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def stored(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def loaded(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return [z[k] for k in z.files]


def narrow(m: np.ndarray) -> bytes:
    """The matrix in single precision where that loses nothing, as for tables of floats; else in double."""
    with np.errstate(over="ignore"):
        half = m.astype(np.float32)
    return (half if np.array_equal(half, m) else np.ascontiguousarray(m)).tobytes()


def wide(data: pa.Buffer, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data.size == 4 * n * d else np.float64).reshape(n, d).astype(np.float64)


def packed(rows: DataFrame, size: int, build: Build | None = None) -> DataFrame:
    """Blocks of at most size rows of one length d, with a uid; build makes the arrays of a block's index from its matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            ids, sizes = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(b.column(1).offsets.to_numpy())
            flat, starts = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                m = flat[starts[own][:, None] + np.arange(d)] if len(own) < len(ids) else flat.reshape(len(ids), d)
                index = stored(build(m)) if build else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([d], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([narrow(m)]), pa.array([index])],
                    names=["part", "d", "n", "ids", "matrix", "built"],
                )
                k += 1

    with arrow(rows.sparkSession, size, BLOCK_BYTES):
        return written(rows.select("vec_id", "v").mapInArrow(run, PACKED).withColumn("uid", F.monotonically_increasing_id()), "blocks")


def search(rows: DataFrame, every: int, k: int, kind: str, build: Build | None, opened: Callable) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by every.

    opened(ids, matrix, arrays of build) opens a block and returns find(query_ids, matrix, least) -> Found, the k best
    for each query without its own vec_id; least has each query's k-th best score so far in this task, or the least
    value there is, and worse rows may be left out. kind: SQL type of the score, long or double. A vec_id that repeats
    is asked once, with the least of its vectors, shorter ones first. The result is written.
    """
    spark = rows.sparkSession
    index = packed(rows, INDEX_ROWS, build)
    blocks = written(index.select("uid", "d").withColumn("block", F.row_number().over(Window.partitionBy("d").orderBy("uid")) - 1), "numbers")  # one narrow row for each INDEX_ROWS rows
    ask = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("d"), "v")).alias("s")).select("vec_id", "s.v")
    parts = max(1, -(-blocks.count() * INDEX_ROWS // (every * QUERY_ROWS)))
    asked = packed(ask.repartition(parts, "vec_id"), QUERY_ROWS)
    before = F.sum(F.col("n") * F.col("d") * 8).over(Window.partitionBy("d").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    slices = written(asked.select("uid", "d", F.floor(F.coalesce(before, F.lit(0)) / SLICE_BYTES).cast("int").alias("slice")), "slices")
    lengths = blocks.groupBy("d").agg(F.ceil(F.count("*") / GROUPS).alias("per"), F.count("*").alias("many")).join(slices.groupBy("d").agg((F.max("slice") + 1).alias("slices")), "d")
    lengths = lengths.withColumn("groups", F.ceil(F.col("many") / F.col("per")))
    offset = F.coalesce(F.sum(F.col("groups") * F.col("slices")).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = written(lengths.select("d", "per", "groups", "slices", offset.alias("offset")), "lengths")  # a row for each length
    cells = lengths.agg(F.max(F.col("offset") + F.col("groups") * F.col("slices"))).first()[0] or 1

    def copied(of: DataFrame, numbers: DataFrame, own, others: str, turn: int) -> DataFrame:
        """The blocks once for each cell they belong to: own is a block's own part of the cell's number, others names the other part's count."""
        cell = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(others) - 1), lambda x: (F.col("offset") + own(x)).cast("int"))).alias("cell")
        where = written(numbers.join(lengths, "d").select("uid", cell), "cells")
        return of.join(where, "uid").select("cell", F.lit(turn).alias("turn"), "uid", "d", "ids", "matrix", "built")

    queries = copied(asked, slices, lambda x: F.col("slice") * F.col("groups") + x, "groups", 0)
    targets = copied(index, blocks, lambda x: x * F.col("groups") + F.floor(F.col("block") / F.col("per")), "slices", 1)
    meetings = queries.union(targets).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "turn", "uid")
    dtype = np.dtype(np.int64 if kind == "long" else np.float64)
    worst = np.iinfo(dtype).min if kind == "long" else -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []  # the queries of a cell and the k best scores of each, over the blocks that it has seen
        for b in batches:
            for at_cell, turn, _, d, *data in zip(*b.columns):
                ids, matrix, built = (x.as_buffer() for x in data)
                ids = np.frombuffer(ids, np.int64)
                matrix = wide(matrix, len(ids), d.as_py())
                if at_cell.as_py() != cell:
                    cell, held = at_cell.as_py(), []
                if not turn.as_py():
                    held.append((ids.copy(), matrix, np.full((len(ids), k), worst, dtype)))
                    continue
                find = opened(ids, matrix, loaded(built) if built.size else [])
                for asks, vectors, top in held:
                    at, found, scores = find(asks, vectors, top.min(axis=1))
                    place = np.concatenate([np.arange(n) for n in np.bincount(at, minlength=len(asks))]) if len(at) else at
                    new = np.full((len(asks), k), worst, dtype)
                    new[at, place] = scores
                    both = np.concatenate([top, new], axis=1)
                    both.sort(axis=1)
                    top[:] = both[:, -k:]
                    yield pa.RecordBatch.from_arrays([pa.array(asks[at], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.from_numpy_dtype(dtype))], names=["query_id", "vec_id", "score"])

    with arrow(spark, 1, BLOCK_BYTES):
        found = meetings.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")


def first(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> Found:
    """The k best of each query (at), best first, ties to the smaller id; in order of the queries."""
    order = np.lexsort((ids, -scores, at))
    at = at[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    order, at = order[place < k], at[place < k]
    return at, ids[order], scores[order]
